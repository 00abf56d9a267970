"""Two epochs with full covariances: S-transformation to reference stations and the test of congruency, a campaign a group.

differences: keys.., i (station:x), v; cofactors: keys.., i, j, v, of the differences; positions: keys.., station, x, y, z, reference."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.functions import distributions as dist
from meridian.operators.matrices import STACK_NUMBERS, beginnings, whole_groups


def datum_basis(names: list[str], position: dict[str, tuple[float, float, float]], defect: tuple[str, ...]) -> np.ndarray:
    """Columns of what a datum can do to coordinates: translations x, y, z, rotation about the vertical, scale; about the mean position."""
    part = [n.rpartition(":") for n in names]
    at = np.array([position.get(s, (0.0, 0.0, 0.0)) for s, _, _ in part])
    centre = np.array(list(position.values())).mean(0) if position else np.zeros(3)
    rel, axis = at - centre, np.array(["xyz".index(c) for _, _, c in part])
    columns = []
    for d in defect:
        if d == "rotation":
            columns.append(np.select([axis == 0, axis == 1], [-rel[:, 1], rel[:, 0]], 0.0))
        elif d == "scale":
            columns.append(rel[np.arange(len(names)), axis])
        else:
            columns.append((axis == "xyz".index(d)).astype(float))
    return np.stack(columns, 1) if columns else np.zeros((len(names), 0))


def s_transformed(v: np.ndarray, q: np.ndarray, basis: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences and cofactors in the datum in which the chosen components have no share of the basis: S = I - G (G'EG)^-1 G'E."""
    if not basis.shape[1]:
        return v, q
    held = basis * chosen[:, None]
    s = np.eye(len(v)) - basis @ np.linalg.solve(held.T @ basis, held.T)
    return s @ v, s @ q @ s.T


@lru_cache(maxsize=4096)
def _critical(confidence: float, h: int, dof: int) -> float:
    return dist.f_quantile(confidence, h, dof) if dof > 0 else dist.chi2_quantile(confidence, h)


OUT = "i string, v double, variance double, omega double, h int, statistic double, critical double, congruent boolean"


def _campaigns(differences: DataFrame, cofactors: DataFrame, positions: DataFrame, meta: DataFrame, by: list[str]) -> DataFrame:
    """All that campaigns have, as rows of one table: 0 differences, 1 cofactors, 2 positions, 3 pooled factor and degrees of freedom."""
    none = lambda t: F.lit(None).cast(t)
    rows = differences.select(*by, F.lit(0).alias("what"), "i", none("string").alias("j"), F.col("v"), *(none("double").alias(c) for c in "xyz"), none("boolean").alias("reference"))
    rows = rows.unionByName(cofactors.select(*by, F.lit(1).alias("what"), "i", "j", "v", *(none("double").alias(c) for c in "xyz"), none("boolean").alias("reference")))
    rows = rows.unionByName(positions.select(*by, F.lit(2).alias("what"), F.col("station").alias("i"), none("string").alias("j"), none("double").alias("v"), "x", "y", "z", "reference"))
    rows = rows.unionByName(meta.select(*by, F.lit(3).alias("what"), none("string").alias("i"), none("string").alias("j"), F.col("pooled").cast("double").alias("v"), F.col("dof").cast("double").alias("x"), none("double").alias("y"), none("double").alias("z"), none("boolean").alias("reference")))
    return rows


class _Campaign:
    """One campaign's differences in the order of their names, with cofactors, datum basis and reference components."""

    def __init__(self, t: pd.DataFrame, defect: tuple[str, ...]):
        d = t[t.what == 0].sort_values("i")
        self.names = d.i.tolist()
        if len(set(self.names)) != len(self.names):
            raise ValueError("a station comes twice in an epoch")
        at = {n: k for k, n in enumerate(self.names)}
        entries = t[(t.what == 1) & t.i.isin(at) & t.j.isin(at)]
        self.q = np.zeros((len(at), len(at)))
        self.q[entries.i.map(at), entries.j.map(at)] = entries.v
        place = t[t.what == 2]
        position = {s: (x, y, z) for s, x, y, z in zip(place.i, place.x.fillna(0), place.y.fillna(0), place.z.fillna(0), strict=True)}
        self.reference = set(place.i[place.reference == True])  # noqa: E712
        self.stations = np.array([n.rpartition(":")[0] for n in self.names], object)
        self.chosen = np.array([s in self.reference for s in self.stations], bool)
        self.basis = datum_basis(self.names, position, defect)
        self.v = d.v.to_numpy(float)
        head = t[t.what == 3].iloc[0]
        self.pooled, self.dof = float(head.v), int(head.x)

    def tested(self, omega: float, h: int, confidence: float) -> tuple[float, float, bool]:
        """Statistic, critical value and whether it holds."""
        statistic = omega / (h * self.pooled) if self.dof > 0 and h else omega
        critical = _critical(confidence, h, self.dof) if h else np.nan
        return statistic, critical, bool(statistic <= critical)


def _each(rows: DataFrame, by: list[str], kinds: dict[str, str], one, out: str) -> DataFrame:
    """Whole campaigns, many a group. `one` gives the rows of a campaign, as tuples after its keys."""
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*by, *(x.split()[0] for x in out.split(", "))]

    def many(t: pd.DataFrame) -> pd.DataFrame:
        found = [(*(own[b].iloc[0] for b in by), *row) for _, own in t.groupby(by, sort=False) for row in one(own)]
        return pd.DataFrame(found, columns=columns, dtype=object)

    return rows.withColumn("deal", F.pmod(F.xxhash64(*by), F.lit(parts))).groupBy("deal").applyInPandas(many, ", ".join(f"{b} {kinds[b]}" for b in by) + ", " + out)


class _Stacks:
    """The campaigns of a table of whole ones, as a _Campaign has one: differences of all of them in the order of their names."""

    def __init__(self, t: pa.Table, by: list[str], defect: tuple[str, ...]):
        t = t.combine_chunks()
        new = beginnings(t, by)
        self.first_row = np.concatenate(([0], np.flatnonzero(new)))
        group, what = np.cumsum(new), t["what"].to_numpy()
        number = lambda name: t[name].combine_chunks().to_numpy(zero_copy_only=False)
        own, entry, place, head = (np.flatnonzero(what == k) for k in range(4))
        text = lambda name, rows: t[name].combine_chunks().take(pa.array(rows))
        if text("i", own).null_count:
            raise ValueError("a difference has no name")
        self.labels = pc.unique(text("i", own)).sort()
        many = max(len(self.labels), 1)
        key = group[own] * many + self._codes(self.labels, text("i", own))
        order = np.argsort(key, kind="stable")
        self.key, own = key[order], own[order]
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("a station comes twice in an epoch")
        self.group, self.code, self.v = group[own], self.key % many, number("v")[own]
        self.first = np.searchsorted(self.group, np.arange(len(self.first_row) + 1))
        self.size = np.diff(self.first)
        # cofactors, by the places of their differences; others are of no difference
        ends = [self._codes(self.labels, text(c, entry)) for c in "ij"]
        at = [np.searchsorted(self.key, group[entry] * many + c) for c in ends]
        found = np.logical_and(*((c >= 0) & (np.append(self.key, -1)[x] == group[entry] * many + c) for x, c in zip(at, ends, strict=True)))
        self.entry_group, self.q = group[entry][found], number("v")[entry][found]
        self.p, self.k = (x[found] - self.first[self.entry_group] for x in at)
        # the last position that a station has
        part = [n.rpartition(":") for n in self.labels.to_pylist()]
        axis = np.array(["xyz".index(c) for _, _, c in part], np.int64)[self.code]
        named = pa.array([s for s, _, _ in part], self.labels.type)
        stations = pc.unique(pa.concat_arrays([named, text("i", place)]))
        every = len(stations) + 1
        station = self._codes(stations, named)[self.code]
        seat = self._codes(stations, text("i", place))
        seat = group[place] * every + np.where(seat < 0, every - 1, seat)
        whose = self.group * every + station
        self.chosen = np.isin(whose, seat[text("reference", place).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)])
        self.basis = np.zeros((len(self.v), len(defect)))
        if defect:
            seats, last = np.unique(seat[::-1], return_index=True)
            xyz = np.stack([number(c)[place].astype(float) for c in "xyz"], 1)[::-1][last]
            xyz[np.isnan(xyz)] = 0.0
            of = seats // every
            count = np.maximum(np.bincount(of, minlength=len(self.size)), 1)
            centre = np.stack([np.bincount(of, xyz[:, c], len(self.size)) / count for c in range(3)], 1)
            seen = np.searchsorted(seats, whose)
            known = np.append(seats, -1)[seen] == whose
            rel = np.where(known[:, None], np.concatenate((xyz, np.zeros((1, 3))))[np.where(known, seen, len(xyz))], 0.0) - centre[self.group]
            for column, d in enumerate(defect):
                if d == "rotation":
                    self.basis[:, column] = np.select([axis == 0, axis == 1], [-rel[:, 1], rel[:, 0]], 0.0)
                elif d == "scale":
                    self.basis[:, column] = rel[np.arange(len(rel)), axis]
                else:
                    self.basis[:, column] = axis == "xyz".index(d)
        heads, row = np.unique(group[head], return_index=True)
        dof = number("x")[head][row].astype(float)
        if len(heads) < len(self.size) or np.isnan(dof).any():
            raise ValueError("a campaign has no pooled factor and degrees of freedom")
        self.pooled, self.dof = number("v")[head][row].astype(float), dof.astype(np.int64)

    @staticmethod
    def _codes(values: pa.Array, of: pa.Array) -> np.ndarray:
        """The place of each text among the values; -1 for nulls and others."""
        return pc.fill_null(pc.index_in(of, value_set=values, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def alike(self) -> Iterator[tuple[np.ndarray, int]]:
        """Campaigns with as many differences and as many reference components, and the number of these."""
        reference = np.bincount(self.group, self.chosen, len(self.size)).astype(np.int64)
        for n, m in np.unique(np.stack((self.size, reference), 1)[self.size > 0], axis=0).tolist():
            own = np.flatnonzero((self.size == n) & (reference == m))
            for some in np.array_split(own, max(1, len(own) * n * n // STACK_NUMBERS)):
                yield some, m


def congruency(differences: DataFrame, cofactors: DataFrame, positions: DataFrame, meta: DataFrame, by: list[str], defect: tuple[str, ...] = (), confidence: float = 0.95) -> DataFrame:
    """(keys.., i, v, variance; omega, h, statistic, critical, congruent of the campaign): differences in the datum of the reference
    stations, and d'Q^-1 d over these against F(h, dof), or chi-square(h) without degrees of freedom. meta: keys.., pooled, dof.
    Campaigns of one size are tested together, in stacks of matrices."""
    rows = _campaigns(differences, cofactors, positions, meta, by).dropna(subset=by)
    kinds, columns = dict(rows.dtypes), [x.split()[0] for x in OUT.split(", ")]

    def tested(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = _Stacks(t, by, defect)
        for some, m in c.alike():
            n = int(c.size[some[0]])
            own = c.first[some][:, None] + np.arange(n)
            slot = np.full(len(c.size), -1)
            slot[some] = np.arange(len(some))
            use = slot[c.entry_group] >= 0
            q = np.zeros((len(some), n, n))
            q[slot[c.entry_group[use]], c.p[use], c.k[use]] = c.q[use]
            v, basis, chosen = c.v[own], c.basis[own], c.chosen[own]
            if defect:  # s_transformed() of each
                held = (basis * chosen[:, :, None]).transpose(0, 2, 1)
                s = np.eye(n) - basis @ np.linalg.solve(held @ basis, held)
                v, q = (s @ v[:, :, None])[:, :, 0], s @ q @ s.transpose(0, 2, 1)
            at = np.argsort(~chosen, axis=1, kind="stable")[:, :m]
            of = q[np.arange(len(some))[:, None, None], at[:, :, None], at[:, None, :]]
            # the reference components have lost what the datum takes, so their cofactors have that rank defect
            values, vectors = np.linalg.eigh(0.5 * (of + of.transpose(0, 2, 1)))
            keep = values > 1e-10 * np.maximum(values.max(1, initial=0.0), 1e-300)[:, None]
            part = (vectors.transpose(0, 2, 1) @ np.take_along_axis(v, at, 1)[:, :, None])[:, :, 0]
            omega, h = np.where(keep, part * part / np.where(keep, values, 1.0), 0.0).sum(1), keep.sum(1)
            pooled, dof = c.pooled[some], c.dof[some]
            scaled = (dof > 0) & (h > 0)
            if (scaled & (pooled == 0)).any():
                raise ZeroDivisionError("a pooled factor is zero")
            statistic = np.where(scaled, omega / np.where(scaled, h * pooled, 1.0), omega)
            pairs, which = np.unique(np.stack((h, dof), 1), axis=0, return_inverse=True)
            critical = np.array([_critical(confidence, a, b) if a else np.nan for a, b in pairs.tolist()])[which.ravel()]
            variance = np.einsum("kii->ki", q)
            whole = [np.repeat(x, n) for x in (omega, h, statistic, critical, statistic <= critical)]
            keys = [t[b].combine_chunks().take(pa.array(np.repeat(c.first_row[some], n))) for b in by]
            floats = lambda x: pa.array(np.ascontiguousarray(x).ravel(), pa.float64(), from_pandas=True)
            ready = [c.labels.take(pa.array(c.code[own].ravel())), floats(v), floats(variance), floats(whole[0]), pa.array(whole[1].astype(np.int32)), floats(whole[2]), floats(whole[3]), pa.array(whole[4])]
            yield pa.RecordBatch.from_arrays([*keys, *ready], names=[*by, *columns])

    out = whole_groups(rows, by, tested, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", " + OUT)
    types = dict(differences.dtypes)
    return out.select(*(F.col(b).cast(types[b]).alias(b) for b in by), *columns)


class _Block:
    """The reference block of a campaign, which loses stations one by one. With P the inverse of its cofactors (to which the square of the datum
    basis B is added, so that they have one), Omega is d'Pd less what the datum takes, g' M^-1 g with M = B'PB and g = B'Pd. A
    station that leaves changes all of these by its own rows only, so nothing is inverted anew."""

    def __init__(self, c: _Campaign):
        self.d, self.b = c.v[c.chosen], c.basis[c.chosen]
        self.stations = c.stations[c.chosen]
        q = c.q[np.ix_(c.chosen, c.chosen)]
        scale = np.trace(q) / max(len(q), 1)
        self.b = self.b / np.maximum(np.linalg.norm(self.b, axis=0), 1e-300) if self.b.size else self.b
        self.p = np.linalg.inv(q + scale * self.b @ self.b.T) if len(q) else q

    def without(self, station: str) -> tuple[float, int] | None:
        """Omega and its rank without a station; None if what is left does not define the datum or nothing is left to test."""
        out = self.stations == station
        pd_, pb = self.p @ self.d, self.p @ self.b
        if out.any():
            half = np.linalg.solve(self.p[np.ix_(out, out)], np.concatenate((pd_[out, None], pb[out]), 1))
            lost = float(pd_[out] @ half[:, 0])
            g, m = self.b.T @ pd_ - pb[out].T @ half[:, 0], self.b.T @ pb - pb[out].T @ half[:, 1:]
        else:
            lost, g, m = 0.0, self.b.T @ pd_, self.b.T @ pb
        rest = self.b[~out]
        h = int((~out).sum()) - self.b.shape[1]
        if h < 1 or rest.shape[1] and np.linalg.matrix_rank(rest) < rest.shape[1]:
            return None
        taken = float(g @ np.linalg.solve(m, g)) if len(g) else 0.0
        return max(float(self.d @ pd_) - lost - taken, 0.0), h

    def remove(self, station: str) -> None:
        out = self.stations == station
        cross = self.p[np.ix_(~out, out)]
        self.p = self.p[np.ix_(~out, ~out)] - cross @ np.linalg.solve(self.p[np.ix_(out, out)], cross.T)
        self.d, self.b, self.stations = self.d[~out], self.b[~out], self.stations[~out]


LOCALISED = "step int, station string, omega double, h int, statistic double, critical double, share double, congruent boolean"


def localised(differences: DataFrame, cofactors: DataFrame, positions: DataFrame, meta: DataFrame, by: list[str], defect: tuple[str, ...] = (), confidence: float = 0.95) -> DataFrame:
    """(keys.., step, station, omega, h, statistic, critical, share, congruent): the test of the reference block, with the station that leaves it
    next and what Omega loses with it; the one without which Omega is least, the first by name of equal ones. The last step has no
    station: its block is congruent, or too small to lose one. Inputs are those of congruency()."""

    def one(t: pd.DataFrame) -> list[tuple]:
        c = _Campaign(t, defect)
        block, out = _Block(c), []
        while (now := block.without("")) is not None:
            statistic, critical, holds = c.tested(*now, confidence)
            left = {} if holds else {s: x[0] for s in sorted(set(block.stations)) if (x := block.without(s)) is not None}
            worst = min(left, key=left.get) if left else None
            out.append((len(out), worst, *now, statistic, critical, now[0] - left[worst] if left else None, holds))
            if worst is None:
                break
            block.remove(worst)
        return out

    return _each(_campaigns(differences, cofactors, positions, meta, by), by, dict(differences.dtypes), one, LOCALISED)


ANALYSED = "station string, role string, status string, omega double, h int, statistic double, critical double, significant boolean"


def deformation(differences: DataFrame, cofactors: DataFrame, positions: DataFrame, meta: DataFrame, by: list[str], defect: tuple[str, ...] = (), confidence: float = 0.95) -> DataFrame:
    """(keys.., station, role, status, omega, h, statistic, critical, significant): each station's movement in the datum of the reference block, with
    the whole cofactors of its components. A campaign whose block is not congruent, or defines no datum, is not analysed: its status is
    `unstable_reference` or `no_reference`, its results are null, and localised() names the stations that moved."""

    def one(t: pd.DataFrame) -> list[tuple]:
        c = _Campaign(t, defect)
        now = _Block(c).without("")
        status = "no_reference" if now is None else "analysed" if c.tested(*now, confidence)[2] else "unstable_reference"
        v, q = s_transformed(c.v, c.q, c.basis, c.chosen) if now is not None else (c.v, c.q)
        out = []
        for s in sorted(set(c.stations)):
            own = np.flatnonzero(c.stations == s)
            result = (None,) * 5
            if status == "analysed":
                values, vectors = np.linalg.eigh(q[np.ix_(own, own)])
                keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
                part = vectors[:, keep].T @ v[own]
                omega, h = float((part * part / values[keep]).sum()), int(keep.sum())
                statistic, critical, holds = c.tested(omega, h, confidence)
                result = (omega, h, statistic, critical, not holds) if h else (omega, h, None, None, None)
            out.append((s, "reference" if s in c.reference else "object", status, *result))
        return out

    return _each(_campaigns(differences, cofactors, positions, meta, by), by, dict(differences.dtypes), one, ANALYSED)
