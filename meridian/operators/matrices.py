"""Matrices in long form, many at once: rows (keys.., i, j, v), symmetric ones with both halves; vectors (keys.., i, v)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators.network import connected_components

#: Numbers in a stack of matrices.
STACK_NUMBERS = 1 << 18


def sub_block(matrix: DataFrame, labels: list[str]) -> DataFrame:
    return matrix.where(F.col("i").isin(labels) & F.col("j").isin(labels))


def correlation(matrix: DataFrame, by: list[str]) -> DataFrame:
    """v / sqrt(v_ii v_jj)."""
    d = matrix.where("i = j")
    first, second = d.select(*by, "i", F.col("v").alias("vi")), d.select(*by, F.col("i").alias("j"), F.col("v").alias("vj"))
    return matrix.join(first, [*by, "i"]).join(second, [*by, "j"]).withColumn("v", F.col("v") / F.sqrt(F.col("vi") * F.col("vj"))).drop("vi", "vj")


def quadratic_form(matrix: DataFrame, vector: DataFrame, by: list[str], rows: DataFrame | None = None) -> DataFrame:
    """(keys.., v): v' M v, over the chosen rows (keys.., i) where given."""
    own = vector if rows is None else vector.join(rows, [*by, "i"], "left_semi")
    left, right = own.select(*by, "i", F.col("v").alias("a")), own.select(*by, F.col("i").alias("j"), F.col("v").alias("b"))
    return matrix.join(left, [*by, "i"]).join(right, [*by, "j"]).groupBy(*by).agg(F.sum(F.col("v") * F.col("a") * F.col("b")).alias("v"))


def product_diagonal(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """(keys.., i, v): the diagonal of a product, without the product."""
    b = second.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("b"))
    return first.join(b, [*by, "i", "j"]).groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("b")).alias("v"))


def _square(rows: pd.DataFrame) -> tuple[list, np.ndarray]:
    names = sorted(set(rows.i) | set(rows.j))
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    m[rows.i.map(at), rows.j.map(at)] = rows.v
    return names, m


def beginnings(t: pa.Table, by: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; nulls are equal."""
    new = np.zeros(t.num_rows, bool)
    for b in by:
        code = pc.dictionary_encode(t[b].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def whole_groups(rows: DataFrame, by: list[str], of: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `of` gives of tables of whole groups, many at once. Rows are dealt and sorted by the keys and pass through a task in batches, so that
    it holds one batch and the group in which that ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            new = np.flatnonzero(beginnings(pa.Table.from_batches([*before, batch]), by)[len(before) :])
            if len(new):
                last = int(new[-1])
                whole = pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
                if whole.num_rows:
                    yield from of(whole)
                batch = batch.slice(last)
            held.append(batch)
        if held:
            yield from of(pa.Table.from_batches(held))

    dealt = rows.repartition(*by).sortWithinPartitions(*by) if by else rows.repartition(1)
    return dealt.mapInArrow(run, schema)


def _inverses(matrix: DataFrame, by: list[str], diagonal: bool) -> DataFrame:
    own = [f for f in matrix.schema if f.name in (*by, "i", "j")[: len(by) + 2 - diagonal]]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def inverted(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        i, j = t["i"].combine_chunks(), t["j"].combine_chunks()
        ends = pa.concat_arrays([i, j.cast(i.type)])
        if ends.null_count:
            raise ValueError("an entry has no row or no column")
        new = beginnings(t, by)
        group, first_row = np.cumsum(new), np.concatenate(([0], np.flatnonzero(new)))
        # the places of each matrix's labels, in their order
        labels = pc.unique(ends).sort()
        code = pc.index_in(ends, value_set=labels).to_numpy()
        known, of = np.unique(np.tile(group, 2) * len(labels) + code, return_inverse=True)
        first = np.searchsorted(known, np.arange(len(first_row) + 1) * len(labels))
        size = np.diff(first)
        p, q = (of - first[np.tile(group, 2)]).reshape(2, -1)
        v = t["v"].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
        for n in np.unique(size).tolist():
            alike = np.flatnonzero(size == n)
            for some in np.array_split(alike, max(1, len(alike) * n * n // STACK_NUMBERS)):
                slot = np.full(len(size), -1)
                slot[some] = np.arange(len(some))
                use = slot[group] >= 0
                m = np.zeros((len(some), n, n))
                m[slot[group[use]], p[use], q[use]] = v[use]
                m = np.linalg.inv(m)
                name = known[first[some][:, None] + np.arange(n)] % len(labels)
                name_i, name_j = (name, name) if diagonal else (np.repeat(name, n), np.tile(name, (1, n)))
                value = np.einsum("kii->ki", m) if diagonal else m
                of_rows = pa.array(np.repeat(first_row[some], value.size // len(some)))
                ready = {"i": labels.take(pa.array(name_i.ravel())), "j": labels.take(pa.array(name_j.ravel())).cast(j.type)}
                columns = [ready[f.name] if f.name in ready else t[f.name].combine_chunks().take(of_rows) for f in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value.ravel(), from_pandas=True)], names=[*(f.name for f in own), "v"])

    return whole_groups(matrix.select(*by, "i", "j", "v"), by, inverted, f"{names}, v double")


def inverse(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Inverses of the matrices, each small enough for a task; those of a batch are inverted in stacks of one size."""
    return _inverses(matrix, by, False)


def inverse_diagonal(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(keys.., i, v): the diagonals of the inverses."""
    return _inverses(matrix, by, True)


def weight_entries(observations: DataFrame, covariances: DataFrame) -> DataFrame:
    """(network_id, i, j, v): weights of observations. What is correlated, over any number of steps, has the inverse of its block;
    other rows have 1 / variance. covariances: network_id, obs_a, obs_b, covariance, each pair once."""
    edges = covariances.select("network_id", F.col("obs_a").alias("a"), F.col("obs_b").alias("b"))
    tied = edges.select("network_id", F.explode(F.array("a", "b")).alias("station")).distinct()
    blocks = connected_components(tied, edges).select("network_id", F.col("station").alias("obs"), F.col("component").alias("block"))
    both = covariances.select("network_id", F.col("obs_a").alias("i"), F.col("obs_b").alias("j"), F.col("covariance").alias("v"))
    both = both.unionByName(both.select("network_id", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    diagonal = observations.join(blocks, ["network_id", "obs"]).select("network_id", "block", F.col("obs").alias("i"), F.col("obs").alias("j"), F.col("variance").alias("v"))
    entries = both.join(blocks.withColumnRenamed("obs", "i"), ["network_id", "i"]).select("network_id", "block", "i", "j", "v").unionByName(diagonal)
    alone = observations.join(blocks, ["network_id", "obs"], "left_anti").select("network_id", F.col("obs").alias("i"), F.col("obs").alias("j"), (1.0 / F.col("variance")).alias("v"))
    return inverse(entries, ["network_id", "block"]).select("network_id", "i", "j", "v").unionByName(alone)


def zero_rounded(matrix: DataFrame, by: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Variances that rounding made negative become zero, with their rows and columns; raises for a variance below -tolerance times
    the largest."""
    d = matrix.where("i = j")
    largest = d.groupBy(*by).agg(F.max(F.abs("v")).alias("top"))
    low = d.join(largest, by).where("v < 0").select(*by, F.when(F.col("v") < -tolerance * F.col("top"), F.raise_error(F.lit("a variance is negative beyond rounding"))).otherwise(F.col("i")).alias("i"))
    gone = low.distinct()
    hit = matrix.join(gone.withColumn("a", F.lit(True)), [*by, "i"], "left").join(gone.select(*by, F.col("i").alias("j"), F.lit(True).alias("b")), [*by, "j"], "left")
    return hit.withColumn("v", F.when(F.col("a") | F.col("b"), 0.0).otherwise(F.col("v"))).select(matrix.columns)


def from_printed(matrix: DataFrame, by: list[str], half_width: float) -> DataFrame:
    """(keys.., i, j, v, conditioned): covariances read from print. Eigenvalues that n * half_width of the last digit can explain are
    clipped to zero; a matrix that is negative beyond that is refused, and one without negative eigenvalues stays as it is."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matrix.schema if f.name in (*by, "i", "j"))
    columns = [f.name for f in matrix.schema if f.name in (*by, "i", "j")]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        labels, m = _square(rows)
        m = 0.5 * (m + m.T)
        values, vectors = np.linalg.eigh(m)
        if values[0] < -len(labels) * half_width:
            raise ValueError("a printed covariance is negative beyond its rounding")
        clipped = bool(values[0] < 0)
        if clipped:
            m = (vectors * np.maximum(values, 0)) @ vectors.T
        i, j = np.divmod(np.arange(m.size), len(labels))
        out = pd.DataFrame({b: rows[b].iloc[0] for b in by} | {"i": [labels[k] for k in i], "j": [labels[k] for k in j], "v": m.ravel(), "conditioned": clipped})
        return out[[*columns, "v", "conditioned"]]

    return matrix.groupBy(*by).applyInPandas(one, f"{names}, v double, conditioned boolean")
