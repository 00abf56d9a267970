"""Localisation and deformation with full covariances against new inverses a step, and batches whose failures are rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.functions import distributions as dist
from meridian.operators import batch, congruency

DEFECTS = [("x", "y"), ("x", "y", "rotation"), ()]


def campaigns():
    r = np.random.default_rng(11)
    out = {}
    for n, (moved, defect) in enumerate([((), 0), (("S2",), 1), (("S1", "S4"), 1), (("S0", "O0"), 0), (("O1",), 2)]):
        names = [f"S{k}" for k in range(6)] + ["O0", "O1"]
        at = {s: (r.uniform(0, 100), r.uniform(0, 100)) for s in names}
        half = r.normal(0, 1e-3, (16, 16))
        q = half @ half.T + 1e-7 * np.eye(16)
        d = np.linalg.cholesky(q) @ r.normal(0, 1, 16) + np.tile([0.3, -0.2], 8) * bool(DEFECTS[defect])
        for s in moved:
            d[2 * names.index(s) : 2 * names.index(s) + 2] += [0.05, -0.04]
        out[f"c{n}"] = names, at, d, q, DEFECTS[defect], 30 if n % 2 else 0
    return out


def quadratic(names, at, d, q, defect, block):
    """Omega and rank in the datum of the block, by S-transformation and a pseudo-inverse."""
    label = [f"{s}:{c}" for s in names for c in "xy"]
    basis = congruency.datum_basis(label, {s: (*at[s], 0.0) for s in names}, defect)
    chosen = np.array([x.partition(":")[0] in block for x in label])
    if defect and np.linalg.matrix_rank(basis[chosen]) < basis.shape[1]:
        return None
    v, w = congruency.s_transformed(d, q, basis, chosen)
    own = w[np.ix_(chosen, chosen)]
    h = int(chosen.sum()) - len(defect)
    return (float(v[chosen] @ np.linalg.pinv(own, rcond=1e-10) @ v[chosen]), h) if h > 0 else None


def critical(h, dof):
    return dist.f_quantile(0.95, h, dof) if dof else dist.chi2_quantile(0.95, h)


def expected(names, at, d, q, defect, dof):
    block, steps = {s for s in names if s[0] == "S"}, []
    while (now := quadratic(names, at, d, q, defect, block)) is not None:
        statistic = now[0] / now[1] if dof else now[0]
        holds = statistic <= critical(now[1], dof)
        left = {} if holds else {s: x[0] for s in sorted(block) if (x := quadratic(names, at, d, q, defect, block - {s}))}
        worst = min(left, key=left.get) if left else None
        steps.append((len(steps), worst, *now, statistic, holds))
        if worst is None:
            return steps
        block = block - {worst}
    return steps


def tables(spark, found):
    d = [(c, f"{s}:{x}", float(v)) for c, (names, _, d, *_) in found.items() for (s, x), v in zip([(s, x) for s in names for x in "xy"], d, strict=True)]
    q = [(c, f"{names[i // 2]}:{'xy'[i % 2]}", f"{names[j // 2]}:{'xy'[j % 2]}", float(q[i, j])) for c, (names, _, _, q, *_) in found.items() for i in range(16) for j in range(16)]
    p = [(c, s, *at[s], 0.0, s[0] == "S") for c, (names, at, *_) in found.items() for s in names]
    m = [(c, 1.0, x[-1]) for c, x in found.items()]
    return (
        spark.createDataFrame(d, "campaign string, i string, v double"), spark.createDataFrame(q, "campaign string, i string, j string, v double"),
        spark.createDataFrame(p, "campaign string, station string, x double, y double, z double, reference boolean"), spark.createDataFrame(m, "campaign string, pooled double, dof int"),
    )


@pytest.mark.parametrize("defect", DEFECTS)
def test_localisation_by_downdates(spark, defect):
    found = {c: x for c, x in campaigns().items() if x[4] == defect}
    got = {}
    for r in congruency.localised(*tables(spark, found), ["campaign"], defect).orderBy("campaign", "step").collect():
        got.setdefault(r.campaign, []).append(r)
    for c, x in found.items():
        want = expected(*x)
        assert [(r.step, r.station, r.h, r.congruent) for r in got[c]] == [(s, w, h, holds) for s, w, _, h, _, holds in want]
        assert [r.omega for r in got[c]] == pytest.approx([w[2] for w in want], rel=1e-5)
        assert [r.statistic for r in got[c]] == pytest.approx([w[4] for w in want], rel=1e-5)
        assert [r.critical for r in got[c]] == pytest.approx([critical(w[3], x[5]) for w in want])
        losses = [a[2] - b[2] for a, b in zip(want, want[1:], strict=False)]
        assert [r.share for r in got[c] if r.station] == pytest.approx(losses, rel=1e-4, abs=1e-6)
    if defect == DEFECTS[1]:
        assert {r.station for r in got["c1"]} - {None} == {"S2"} and {r.station for r in got["c2"]} - {None} == {"S1", "S4"}


def test_deformation_of_objects(spark):
    defect = ("x", "y")
    found = {c: x for c, x in campaigns().items() if x[4] == defect}
    got = {(r.campaign, r.station): r for r in congruency.deformation(*tables(spark, found), ["campaign"], defect).collect()}
    stable = expected(*found["c0"])[0][-1]
    for c, (names, at, d, q, _, dof) in found.items():
        for s in names:
            row = got[c, s]
            assert row.role == ("reference" if s[0] == "S" else "object")
            if c == "c3":  # S0 moved
                assert (row.status, row.omega, row.significant) == ("unstable_reference", None, None)
            elif stable:
                label = [f"{s}:{x}" for s in names for x in "xy"]
                basis = congruency.datum_basis(label, {s: (*at[s], 0.0) for s in names}, defect)
                v, w = congruency.s_transformed(d, q, basis, np.array([x[0] == "S" for x in label]))
                k = 2 * names.index(s)
                omega = float(v[k : k + 2] @ np.linalg.inv(w[k : k + 2, k : k + 2]) @ v[k : k + 2])
                assert row.status == "analysed" and row.h == 2 and row.omega == pytest.approx(omega, rel=1e-5)
                assert row.significant == (row.statistic > critical(2, dof))
    bare = tables(spark, found)
    none = congruency.deformation(bare[0], bare[1], bare[2].withColumn("reference", F.lit(False)), bare[3], ["campaign"], defect)
    assert {r.status for r in none.collect()} == {"no_reference"}


def test_batches_keep_failures_as_rows(spark):
    def work(row):
        if row["x"] is None:
            raise batch.DomainError("no_value", f"key {row['k']}")
        if row["x"] == 13:
            raise ZeroDivisionError
        return {"half": row["x"] / 2.0}

    tasks = spark.createDataFrame([(k, None if k % 10 == 3 else k) for k in range(100) if k != 13], "k long, x long").repartition(5)
    report = batch.run_batch(tasks, "k", work, "half double", accept=lambda v: v["half"] >= 5)
    rows = {r.k: r for r in report.collect()}
    assert len(rows) == report.count() == 99
    assert rows[23].outcome == "FAILED" and (rows[23].code, rows[23].detail, rows[23].value) == ("no_value", "key 23", None)
    assert rows[4].outcome == "REJECTED" and rows[4].value.half == 2.0 and rows[40].outcome == "SUCCEEDED" and rows[40].value.half == 20.0
    assert all(r.seconds >= 0 for r in rows.values())
    assert {(r.outcome, r["code"]): r["keys"] for r in batch.summary(report).collect()} == {("SUCCEEDED", None): 81, ("FAILED", "no_value"): 9, ("REJECTED", "rejected"): 9}
    with pytest.raises(Exception, match="ZeroDivisionError"):  # a fault of the program is no key's failure
        batch.run_batch(spark.createDataFrame([(1, 13)], "k long, x long"), "k", work, "half double").collect()
    assert batch.run_batch(tasks.limit(0), "k", work, "half double").collect() == []
