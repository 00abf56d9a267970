"""Networks and matrices of tables that are larger than a task."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.operators import adjustment, builders, congruency, matrices

N = 5


def levelled(spark, rows, slopes=False):
    """Differences between five stations, of which s0 is held, in two networks; a second type of few rows."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    i, j = F.col("id") % N, (F.col("id") + 1 + F.col("id") % 3) % N
    value = 3.0 * (j - i) + 0.01 * h
    obs = spark.range(rows).select(F.lit("n").alias("network_id"), F.concat(F.lit("o"), F.col("id")).alias("obs"), F.lit("HEIGHT_DIFFERENCE").alias("type"), F.concat(F.lit("s"), i).alias("at"), F.concat(F.lit("s"), j).alias("to"), F.lit(None).cast("string").alias("third"), value.alias("value"), (1e-4 * (1 + F.col("id") % 7)).alias("variance"), F.lit(None).cast("string").alias("setup"))
    more = [("n", "h2", "HEIGHT", "s2", None, None, 6.01, 1e-8, None), ("m", "1", "HEIGHT_DIFFERENCE", "a", "b", None, 2.0, 1.0, None), ("m", "2", "HEIGHT_DIFFERENCE", "a", "b", None, 3.0, 1.0, None)]
    stations = [("n", f"s{k}", 0.0, 0.0, 0.0, k == 0) for k in range(N)] + [("m", "a", 0.0, 0.0, 1.0, True), ("m", "b", 0.0, 0.0, 0.0, False)]
    return spark.createDataFrame(stations, "network_id string, station string, x double, y double, z double, fixed boolean"), obs.unionByName(spark.createDataFrame(more, obs.schema))


def test_repeated_observations_of_a_large_network_are_merged(spark, monkeypatch):
    """a network of more rows than a task should hold goes there as its distinct quantities, and every row has its results."""
    real, most = adjustment._task, 200

    def bounded(t, *more):
        if t.num_rows > most:
            raise MemoryError(f"{t.num_rows} rows in a task")
        return real(t, *more)

    monkeypatch.setattr(adjustment, "_task", bounded)
    rows = adjustment.GROUP_ROWS + 1
    stations, obs = levelled(spark, rows)
    out = adjustment.adjust(stations, obs, "height_1d", influence=True)
    own = obs.where("network_id = 'n'").toPandas()
    a = np.zeros((len(own), N))
    at, to = own["at"].str[1:].astype(int), own["to"].str[1:].astype(float)
    a[np.arange(len(own)), at] = np.where(own["type"] == "HEIGHT", 1.0, -1.0)
    two = np.flatnonzero(own["type"] != "HEIGHT")
    a[two, to[two].astype(int)] = 1.0
    a, w = a[:, 1:], 1.0 / own.variance.to_numpy()
    q = np.linalg.inv(a.T @ (a * w[:, None]))
    z = q @ (a.T @ (w * own.value))
    assert [r.z for r in out["stations"].where("network_id = 'n'").orderBy("station").collect()] == pytest.approx([0.0, *z], abs=1e-9)
    got = out["residuals"].where("network_id = 'n'").toPandas().set_index("obs").loc[own.obs]
    v = a @ z - own.value.to_numpy()
    assert len(got) == rows + 1
    for name, want in (("residual", v), ("weight", w), ("weighted", w * v), ("redundancy", 1.0 - w * np.einsum("ri,ij,rj->r", a, q, a)), ("influence", w * np.linalg.norm(a @ q, axis=1))):
        assert np.allclose(got[name], want, rtol=1e-7, atol=1e-9), name
    s = {r.network_id: r for r in out["statistics"].collect()}
    assert (s["n"].rows, s["n"].unknowns, s["n"].dof) == (rows + 1, N - 1, rows + 2 - N)
    assert s["n"].vpv == pytest.approx(float(w @ v**2), rel=1e-9) and (s["m"].rows, s["m"].vpv) == (2, pytest.approx(0.5))
    assert {(r.i, r.j): r.q for r in out["cofactors"].where("network_id = 'n'").collect()} == pytest.approx({(f"s{i + 1}:z", f"s{j + 1}:z"): q[i, j] for i in range(N - 1) for j in range(N - 1)}, abs=1e-12)


def test_merging_changes_no_result(spark, monkeypatch):
    """distances with offsets, angles and null and infinite entries, merged and not; a network that fails has nulls either way."""
    names = "network_id string, obs string, type string, at string, to string, third string, value double, variance double, setup string, height_offset double"
    place = {"A": (0.0, 0.0, 0.0), "B": (100.0, 0.0, 5.0), "C": (20.0, 90.0, -3.0), "P": (55.0, 40.0, 12.0)}
    stations = [("n", s, *(x + 0.03 * (s == "P") for x in p), s != "P") for s, p in place.items()] + [("k", "A", 0.0, 0.0, 0.0, True)]
    rows = [("k", "1", "SLOPE_DISTANCE", "A", "Z", None, 2.0, 1.0, None, None)]
    for k in range(24):
        s = "ABC"[k % 3]
        d = np.array(place["P"]) - place[s]
        off = (None, 0.0, 1.5)[k // 3 % 3]
        rows.append(("n", f"s{k}", "SLOPE_DISTANCE", s, "P", None, float(np.linalg.norm(d + [0, 0, off or 0.0])) + 0.001 * (k % 5 - 2), 1e-6 * (1 + k % 4) if k else float("inf"), None, off))
        rows.append(("n", f"z{k}", "ZENITH_ANGLE", s, "P", None, float(np.arctan2(np.hypot(d[0], d[1]), d[2])) + 1e-5 * (k % 3 - 1), 1e-9, None, None))
    found = []
    for most in (adjustment.GROUP_ROWS, 10):
        monkeypatch.setattr(adjustment, "GROUP_ROWS", most)
        out = adjustment.adjust(spark.createDataFrame(stations, "network_id string, station string, x double, y double, z double, fixed boolean"), spark.createDataFrame(rows, names), "local_3d")
        found.append([sorted(map(tuple, out[t].collect()), key=str) for t in ("stations", "cofactors", "residuals", "statistics")])
    for one, two in zip(*found, strict=True):
        assert len(one) == len(two)
        for x, y in zip(one, two, strict=True):
            assert all(a == b or a == pytest.approx(b, rel=1e-6, abs=1e-10) for a, b in zip(x, y, strict=True)), (x, y)
    assert len(found[0][2]) == 49 and ("k", "1", None) in [r[:3] for r in found[1][2]]


def test_level_network_of_many_lines(spark):
    """lines between few stations are merged, whichever technique they are of."""
    lines = spark.range(adjustment.GROUP_ROWS + 10).select(F.col("id").alias("line"), F.concat(F.lit("S"), F.col("id") % 3).alias("from"), F.concat(F.lit("S"), (F.col("id") + 1) % 3).alias("to"), ((F.col("id") + 1) % 3 - F.col("id") % 3 + 0.003).alias("height_difference"), F.lit(1e-4).alias("variance"))
    stations, obs = builders.level_network(lines, spark.createDataFrame([("S0", 0.0, 0.0)], "station string, height double, variance double"))
    more = spark.createDataFrame([("levelling", "1", "S0", "S1", 2.0, 1e-12)], "network_id string, obs string, at string, to string, value double, variance double")
    out = adjustment.adjust(stations, builders.add_height_differences(obs, more, "trigonometric"), "height_1d")
    assert {r.station: r.z for r in out["stations"].collect()} == pytest.approx({"S0": 0.0, "S1": 2.0, "S2": 2.5}, abs=2e-2)
    assert out["statistics"].first().rows == adjustment.GROUP_ROWS + 11


def test_level_network_evaluates_lines_once(spark):
    """the stations and the observations of a network come from one evaluation of its lines."""
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return n

    lines = spark.createDataFrame([(k, "S0", "S1", 1.0 + 0.01 * k, 1e-4) for k in range(8)], "line long, from string, to string, height_difference double, variance double").withColumn("line", F.udf(counted, "long")("line"))
    distinct = lines.groupBy("line").agg(*(F.first(c).alias(c) for c in ("from", "to", "height_difference", "variance")))
    stations, obs = builders.level_network(distinct, spark.createDataFrame([("S0", 0.0, 0.0)], "station string, height double, variance double"))
    out = adjustment.adjust(stations, obs, "height_1d")
    assert {r.station: r.z for r in out["stations"].collect()} == pytest.approx({"S0": 0.0, "S1": 1.035}) and seen.value == 8


def test_inverses_of_many_matrices(spark):
    """matrices of several sizes and keys, one longer than a batch, in any order of entries; missing keys are keys."""
    r = np.random.default_rng(3)
    want, rows = {}, []
    for k in range(60):
        n = (1, 2, 3, 7)[k % 4] if k else 130
        m = r.normal(size=(n, n)) + 3 * n * np.eye(n)
        names = [f"{'zyx'[c % 3]}{c}" for c in range(n)]
        key = (None if k == 1 else k // 2, "ab"[k % 2])
        inverted = np.linalg.inv(m)
        want |= {(*key, names[a], names[b]): inverted[a, b] for a in range(n) for b in range(n)}
        rows += [(*key, names[a], names[b], float(m[a, b])) for a in range(n) for b in range(n)]
    matrix = spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "k int, part string, i string, j string, v double")
    got = {tuple(x[:4]): x.v for x in matrices.inverse(matrix, ["k", "part"]).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    diagonal = matrices.inverse_diagonal(matrix, ["k", "part"])
    assert diagonal.columns == ["k", "part", "i", "v"]
    assert {tuple(x[:3]): x.v for x in diagonal.collect()} == pytest.approx({(k, p, i): v for (k, p, i, j), v in want.items() if i == j}, rel=1e-9)
    numbered = matrices.inverse(matrix.where("k = 0 and part = 'a'").select(F.expr("cast(substring(i, 2) as int)").alias("j"), F.expr("cast(substring(j, 2) as bigint)").alias("i"), "v"), [])
    assert numbered.dtypes == [("j", "int"), ("i", "bigint"), ("v", "double")] and numbered.count() == 130 * 130
    assert matrices.inverse(matrix.limit(0), ["k", "part"]).collect() == []


def test_many_small_matrices_are_inverted_together(spark):
    """a task makes a call a batch, not a call a matrix."""
    seen = spark.sparkContext.accumulator(0)
    entries = spark.range(20_000).select(F.col("id").alias("k"), F.explode(F.array(F.struct(F.lit("p").alias("i"), F.lit("p").alias("j"), (F.col("id") + 2.0).alias("v")), F.struct(F.lit("p").alias("i"), F.lit("q").alias("j"), F.lit(1.0).alias("v")), F.struct(F.lit("q").alias("i"), F.lit("p").alias("j"), F.lit(1.0).alias("v")), F.struct(F.lit("q").alias("i"), F.lit("q").alias("j"), F.lit(2.0).alias("v")))).alias("e")).select("k", "e.*")

    def counted(t):
        seen.add(1)
        yield from (pa.RecordBatch.from_arrays([pa.array([t.num_rows])], names=["n"]),)

    found = matrices.whole_groups(entries, ["k"], counted, "n long").agg(F.sum("n")).first()[0]
    assert found == 80_000 and seen.value < 40
    out = matrices.inverse_diagonal(entries, ["k"]).where("i = 'q'").agg(F.count("*"), F.sum(F.abs(F.col("v") - (F.col("k") + 2) / (2 * F.col("k") + 3)))).first()
    assert out[0] == 20_000 and out[1] < 1e-6


CAMPAIGNS = {"differences": "site string, campaign long, i string, v double", "cofactors": "site string, campaign long, i string, j string, v double", "positions": "site string, campaign long, station string, x double, y double, z double, reference boolean", "meta": "site string, campaign long, pooled double, dof int"}


def campaigns(many, axes):
    """Campaigns of two to seven stations, with stations that are no reference, have no position or are not in the differences."""
    r = np.random.default_rng(len(axes))
    rows = {k: [] for k in CAMPAIGNS}
    for k in range(many):
        key, n = ("ab"[k % 2], k // 2), 2 + k % 6 + 2 * bool(len(axes) > 1)
        names = [f"{s}:{c}" for s in (f"S{j * 7 % 10}" for j in range(n)) for c in axes]
        a = r.normal(size=(len(names), len(names)))
        q = a @ a.T / len(names) + np.eye(len(names))
        rows["differences"] += [(*key, i, float(r.normal() * (1 + k % 4))) for i in names]
        rows["cofactors"] += [(*key, names[i], names[j], float(q[i, j])) for i in range(len(names)) for j in range(len(names))] + [(*key, "S0:" + axes[0], "gone:x", 5.0), (*key, None, "S0:x", 1.0)]
        known = names[:: len(axes)][: n - (k % 5 == 1)]
        rows["positions"] += [(*key, i[:-2], *(float(x) for x in r.normal(size=2) * 100), None, j < n - k % 3 if j else True) for j, i in enumerate(known)] + [(*key, "gone", 50.0, 5.0, 1.0, True)]
        rows["meta"].append((*key, 0.5 + k % 3, k % 4 * 5))
    return rows


@pytest.mark.parametrize(("axes", "defect"), [("z", ()), ("xy", ("x", "y", "rotation")), ("xyz", ("x", "y", "z", "scale"))])
def test_campaigns_are_tested_together(spark, monkeypatch, axes, defect):
    """campaigns of a batch are tested in stacks; each has what it has on its own."""
    rows = campaigns(90, axes)
    want = {}
    for site, campaign, pooled, dof in rows["meta"]:
        own = lambda kind: [x[2:] for x in rows[kind] if x[:2] == (site, campaign)]  # noqa: B023, E731
        values = dict(own("differences"))
        names = sorted(values)
        entries = {(i, j): v for i, j, v in own("cofactors")}
        q = np.array([[entries[i, j] for j in names] for i in names])
        places = {s: (x or 0.0, y or 0.0, z or 0.0) for s, x, y, z, _ in own("positions")}
        reference = {x[0] for x in own("positions") if x[-1]}
        chosen = np.array([n[:-2] in reference for n in names])
        v, q = congruency.s_transformed(np.array([values[n] for n in names]), q, congruency.datum_basis(names, places, defect), chosen)
        omega = v[chosen] @ np.linalg.pinv(q[np.ix_(chosen, chosen)], 1e-10, hermitian=True) @ v[chosen]
        h = int(chosen.sum()) - len(defect)
        statistic, critical = omega / (h * pooled) if dof and h else omega, congruency._critical(0.95, h, dof) if h else None
        want |= {(site, campaign, n): (v[k], q[k, k], omega, h, statistic, critical, bool(h and statistic <= critical)) for k, n in enumerate(names)}

    def alone(*args):
        raise AssertionError("a campaign is taken on its own")

    monkeypatch.setattr(congruency, "_Campaign", alone)
    tables = [spark.createDataFrame(rows[k], s).repartition(3) for k, s in CAMPAIGNS.items()]
    out = congruency.congruency(*tables, ["site", "campaign"], defect)
    assert out.columns == ["site", "campaign", "i", "v", "variance", "omega", "h", "statistic", "critical", "congruent"]
    got = {tuple(r[:3]): tuple(r[3:]) for r in out.collect()}
    assert got.keys() == want.keys() and {x[-1] for x in want.values()} == {True, False}
    for k, one in got.items():
        for a, b in zip(one, want[k], strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-6, abs=1e-7), (k, one, want[k])


def test_campaigns_that_cannot_be_tested(spark):
    """what was refused is refused, and campaigns without references are not congruent."""
    def run(**other):
        rows = campaigns(4, "z") | other
        return congruency.congruency(*(spark.createDataFrame(rows[k], s) for k, s in CAMPAIGNS.items()), ["site", "campaign"]).collect()

    rows = campaigns(4, "z")
    with pytest.raises(Exception, match="twice in an epoch"):
        run(differences=rows["differences"] + rows["differences"][:1])
    with pytest.raises(Exception, match="no pooled factor"):
        run(meta=rows["meta"][1:])
    none = run(positions=[(*p[:-1], False) for p in rows["positions"]])
    assert len(none) == len(rows["differences"]) and {(r.omega, r.h, r.critical, r.congruent) for r in none} == {(0.0, 0, None, False)}
    assert run(differences=[], cofactors=[]) == []
    assert {r.site for r in run(differences=[(None, *x[1:]) if x[0] == "b" else x for x in rows["differences"]])} == {"a"}
