"""External reliability and variance components against whole matrices in NumPy."""

import math

import numpy as np
import pytest

from meridian.operators import adjustment, gauss_newton
from test_operators import NONE, OBS, STATIONS, braced, close


def design(stations, rows, at, free):
    """A of distances and azimuths, and the unknowns' places."""
    place = {(s, c): k for k, (s, c) in enumerate((s, c) for _, s, _, _, _, held in stations if not held for c in "xy")}
    a = np.zeros((len(rows), len(place)))
    for i, (_, _, kind, s, t, *_) in enumerate(rows):
        dx, dy = at[t][0] - at[s][0], at[t][1] - at[s][1]
        d = math.hypot(dx, dy)
        partial = (dx / d, dy / d) if kind == "HORIZONTAL_DISTANCE" else (dy / d**2, -dx / d**2)
        for c, v in zip("xy", partial, strict=True):
            if (t, c) in place:
                a[i, place[t, c]] += v
            if (s, c) in place:
                a[i, place[s, c]] -= v
    return a, place


def inverse(a, weight, at, place, free):
    n = a.T @ np.diag(weight) @ a
    if not free:
        return np.linalg.inv(n)
    x, y = (np.array([at[s][k] for s, _ in place]) for k in (0, 1))
    is_x = np.array([c == "x" for _, c in place])
    basis = np.stack([is_x, ~is_x, np.where(is_x, -(y - y[is_x].mean()), x - x[is_x].mean())], 1).astype(float)
    basis, _ = np.linalg.qr(basis)
    return np.linalg.inv(n + basis @ basis.T) - basis @ basis.T


def run(spark, monkeypatch, stations, rows, defect, dense, **more):
    """Through Spark, or for level blocks the same in this process."""
    if dense:
        return adjustment._estimated(spark.createDataFrame(stations, STATIONS), spark.createDataFrame(rows, OBS), "plane_2d", defect, None, 1, False, **more)
    monkeypatch.setattr(gauss_newton, "DENSE", 0)
    parts = more.get("parts", ())
    own = [(0, "g", s, NONE, NONE, NONE, NONE, NONE, NONE, x, y, z, f, NONE, NONE) for _, s, x, y, z, f in stations]
    own += [(1, "g", a, b, NONE, k, NONE, v, w, NONE, NONE, NONE, NONE, o, k) for _, o, k, a, b, _, v, w, _ in rows]
    table = spark.createDataFrame(own, ", ".join(f"{n} {t}" for n, t in adjustment._IN.items()) + ", fullname string, part string").toArrow()
    return adjustment._task(table, "plane_2d", defect, 1, False, more.get("influence", False), parts).to_pylist()


def mixed(k, free):
    stations, rows = braced(k, free)
    at = {s: (x, y) for _, s, x, y, _, _ in stations}
    r = np.random.default_rng(9)
    more = [("g", "z" + o, "AZIMUTH", s, t, NONE, math.atan2(at[t][0] - at[s][0], at[t][1] - at[s][1]) + r.normal(0, 1e-5), 1e-10, NONE) for _, o, _, s, t, *_ in rows[::3]]
    return stations, rows, rows + more


@pytest.mark.parametrize("free", [False, True])
@pytest.mark.parametrize("dense", [True, False])
def test_external_reliability(spark, monkeypatch, free, dense):
    stations, rows = braced(6, free)
    out = run(spark, monkeypatch, stations, rows, ("x", "y", "rotation") if free else (), dense, influence=True)
    if dense:
        at = {r.station: (r.x, r.y) for r in out["stations"].collect()}
        got = {r.obs: r.influence for r in out["residuals"].collect()}
    else:
        at = {r["a"]: (r["x"], r["y"]) for r in out if r["what"] == 0}
        got = {r["a"]: r["z"] for r in out if r["what"] == 1}
    a, place = design(stations, rows, at, free)
    weight = np.array([1 / r[7] for r in rows])
    q = inverse(a, weight, at, place, free)
    expected = np.linalg.norm(q @ a.T @ np.diag(weight), axis=0)
    assert np.allclose([got[r[1]] for r in rows], expected, rtol=1e-5)


def test_external_effects_are_null_without_redundancy(spark):
    stations = spark.createDataFrame([("n", "A", 0.0, 0.0, 1.0, True), ("n", "B", 0.0, 0.0, 0.0, False), ("n", "C", 0.0, 0.0, 0.0, False)], STATIONS)
    rows = [("1", "A", "B", 10.0, 1.0), ("2", "A", "B", 10.1, 4.0), ("3", "B", "C", 1.0, 1.0)]
    obs = spark.createDataFrame([("n", o, "HEIGHT_DIFFERENCE", a, b, NONE, v, w, NONE) for o, a, b, v, w in rows], OBS)
    out = {r.obs: r for r in adjustment.reliability(adjustment.adjust(stations, obs, "height_1d", influence=True)["residuals"]).collect()}
    assert out["3"].external_effect is None and out["3"].minimal_detectable_bias is None
    for o, share in (("1", 0.8), ("2", 0.2)):  # B and C both move
        assert close(out[o].influence, share * math.sqrt(2), 1e-9)
        assert close(out[o].external_effect, out[o].influence * out[o].minimal_detectable_bias, 1e-9)


def test_influence_of_correlated_observations(spark):
    stations = spark.createDataFrame([("n", "A", 0.0, 0.0, 1.0, True), ("n", "B", 0.0, 0.0, 0.0, False), ("n", "C", 0.0, 0.0, 0.0, False)], STATIONS)
    rows = [("1", "A", "B", 10.0, 2.0), ("2", "A", "C", 10.1, 3.0), ("3", "B", "C", 0.2, 1.0)]
    obs = spark.createDataFrame([("n", o, "HEIGHT_DIFFERENCE", a, b, NONE, v, w, NONE) for o, a, b, v, w in rows], OBS)
    cov = spark.createDataFrame([("n", "1", "2", 0.9)], "network_id string, obs_a string, obs_b string, covariance double")
    got = {r.obs: r.influence for r in adjustment.adjust(stations, obs, "height_1d", covariances=cov, influence=True)["residuals"].collect()}
    a = np.array([[1.0, 0], [0, 1], [-1, 1]])
    p = np.linalg.inv(np.array([[2.0, 0.9, 0], [0.9, 3, 0], [0, 0, 1]]))
    assert np.allclose([got["1"], got["2"], got["3"]], np.linalg.norm(np.linalg.inv(a.T @ p @ a) @ a.T @ p, axis=0))


def whole_estimate(stations, rows, at, free, residual):
    """One round by whole matrices."""
    a, place = design(stations, rows, at, free)
    weight = np.array([1 / r[7] for r in rows])
    p = np.diag(weight)
    q = inverse(a, weight, at, place, free)
    m = p @ (np.diag(1 / weight) - a @ q @ a.T) @ p
    kinds = ("AZIMUTH", "HORIZONTAL_DISTANCE")
    v = [np.diag([1 / w if r[2] == k else 0.0 for w, r in zip(weight, rows, strict=True)]) for k in kinds]
    normal = np.array([[0.5 * np.trace(m @ x @ m @ y) for y in v] for x in v])
    right = np.array([0.5 * residual @ p @ x @ p @ residual for x in v])
    return normal, right


@pytest.mark.parametrize("free", [False, True])
@pytest.mark.parametrize("dense", [True, False])
def test_traces_of_groups(spark, monkeypatch, free, dense):
    stations, _, rows = mixed(5, False)
    if free:  # distances of two kinds of weight, as azimuths would hold the rotation
        stations, _, _ = mixed(5, True)
        rows = [(*r[:7], r[7] * (1 + k % 2), NONE) for k, r in enumerate(braced(5, True)[1])]
    parts = ("AZIMUTH", "HORIZONTAL_DISTANCE")
    more = {"part": "type", "parts": parts} if dense else {"parts": parts}
    out = run(spark, monkeypatch, stations, rows, ("x", "y", "rotation") if free else (), dense, **more)
    if dense:
        at = {r.station: (r.x, r.y) for r in out["stations"].collect()}
        v = {r.obs: r.residual for r in out["residuals"].collect()}
        traces = [(r.k, r.j, r.both, r.once, r.rows) for r in out["traces"].collect() if r.rows]
    else:
        at = {r["a"]: (r["x"], r["y"]) for r in out if r["what"] == 0}
        v = {r["a"]: r["v"] for r in out if r["what"] == 1}
        traces = [(r["a"], r["b"], r["v"], r["w"], r["x"]) for r in out if r["what"] == 4 and r["x"]]
    normal, _ = whole_estimate(stations, rows, at, free, np.array([v[r[1]] for r in rows]))
    got = np.zeros((2, 2))
    for k, j, both, once, n in traces:
        got[parts.index(k), parts.index(j)] += 0.5 * both + (0.5 * n - once) * (k == j)
    assert np.allclose(got, normal, rtol=1e-5, atol=1e-7)


def test_variance_components_of_two_networks(spark):
    """The fixed point of the same rounds by whole matrices, over both networks together."""
    nets = {}
    for name, k in (("g", 5), ("h", 4)):
        stations, _, rows = mixed(k, False)
        nets[name] = [(name, *s[1:]) for s in stations], [(name, *r[1:]) for r in rows]
    st = spark.createDataFrame([s for x, _ in nets.values() for s in x], STATIONS)
    ob = spark.createDataFrame([r for _, y in nets.values() for r in y], OBS)
    found = {r.type: r for r in adjustment.variance_components(st, ob, "plane_2d", "type").collect()}
    kinds = ("AZIMUTH", "HORIZONTAL_DISTANCE")
    scaled = ob.withColumn("variance", ob.variance * __import__("pyspark").sql.functions.when(ob.type == kinds[0], found[kinds[0]].factor).otherwise(found[kinds[1]].factor))
    out = adjustment.adjust(st, scaled, "plane_2d")
    normal, right = np.zeros((2, 2)), np.zeros(2)
    for name, (stations, rows) in nets.items():
        at = {r.station: (r.x, r.y) for r in out["stations"].where(f"network_id = '{name}'").collect()}
        v = {r.obs: r.residual for r in out["residuals"].where(f"network_id = '{name}'").collect()}
        own = [(*r[:7], r[7] * found[r[2]].factor, NONE) for r in rows]
        n, u = whole_estimate(stations, own, at, False, np.array([v[r[1]] for r in own]))
        normal, right = normal + n, right + u
    assert np.allclose(np.linalg.solve(normal, right), 1.0, atol=2e-4)
    spread = np.sqrt(np.diag(np.linalg.inv(normal)))
    assert np.allclose([found[k].std_dev / found[k].factor for k in kinds], spread, rtol=1e-2)


def test_variance_components_refuse(spark):
    stations = spark.createDataFrame([("n", "A", 0.0, 0.0, 1.0, True), ("n", "B", 0.0, 0.0, 0.0, False)], STATIONS)
    rows = [("1", 10.0, "u"), ("2", 10.1, "u"), ("3", 10.05, "u"), ("4", 10.02, "w")]
    obs = spark.createDataFrame([("n", o, "HEIGHT_DIFFERENCE", "A", "B", NONE, v, 1.0, NONE, g) for o, v, g in rows], OBS + ", grp string")
    with pytest.raises(ValueError, match="group w has too little redundancy"):
        adjustment.variance_components(stations, obs, "height_1d", "grp")
    cov = spark.createDataFrame([("n", "3", "4", 0.5)], "network_id string, obs_a string, obs_b string, covariance double")
    with pytest.raises(ValueError, match="split_group"):
        adjustment.variance_components(stations, obs, "height_1d", "grp", covariances=cov)


def test_epochs_with_repeated_stations_or_other_frames_fail(spark):
    from meridian.operators import monitoring

    schema = "station string, x double, y double, z double, vx double, vy double, vz double, dof int, factor double"
    row = ("A", 1.0, 2.0, 3.0, 1.0, 1.0, 1.0, 4, 1.0)
    one, twice = spark.createDataFrame([row], schema), spark.createDataFrame([row, row], schema)
    assert monitoring.compare(one, one).count() == 1
    with pytest.raises(Exception, match="comes twice"):
        monitoring.compare(one, twice).collect()
    frames = [spark.createDataFrame([(f,)], "frame string") for f in ("local", "geocentric")]
    with pytest.raises(ValueError, match="frame"):
        monitoring.compare(one, one, tuple(frames))
