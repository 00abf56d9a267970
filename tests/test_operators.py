"""Operators on small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import adjustment, builders, gauss_newton, gnss, gravimetry, levelling, matrices, monitoring, network, solutions, store, total_station


def close(x, y, tol=1e-6):
    return x == pytest.approx(y, abs=tol)


NONE = None
OBS = "network_id string, obs string, type string, at string, to string, third string, value double, variance double, setup string"
STATIONS = "network_id string, station string, x double, y double, z double, fixed boolean"


def test_levelling_loop_by_hand(spark):
    stations = spark.createDataFrame([("n", "A", 0.0, 0.0, 100.0, True), ("n", "B", 0.0, 0.0, 0.0, False), ("n", "C", 0.0, 0.0, 0.0, False)], STATIONS)
    rows = [("AB", "A", "B", 10.0), ("BC", "B", "C", -4.0), ("CA", "C", "A", -6.03)]
    obs = spark.createDataFrame([("n", o, "HEIGHT_DIFFERENCE", a, b, NONE, v, 1.0, NONE) for o, a, b, v in rows], OBS)
    out = adjustment.adjust(stations, obs, "height_1d")
    z = {r.station: r.z for r in out["stations"].collect()}
    assert close(z["B"], 110.01) and close(z["C"], 106.02)
    s = out["statistics"].first()
    assert (s.rows, s.unknowns, s.dof) == (3, 2, 1) and close(s.variance_factor, 0.03**2 / 3)
    assert all(close(r.redundancy, 1 / 3) and close(abs(r.residual), 0.01) for r in out["residuals"].collect())


def test_networks_that_fail_say_so(spark):
    stations = [("n", s, 0.0, 0.0, 0.0, s == "A") for s in "ABCD"]
    apart = [("n", "1", "HEIGHT_DIFFERENCE", "A", "B", NONE, 1.0, 1.0, NONE), ("n", "2", "HEIGHT_DIFFERENCE", "C", "D", NONE, 1.0, 1.0, NONE)]
    with pytest.raises(ValueError, match="rank_defect"):
        adjustment.adjust(spark.createDataFrame(stations, STATIONS), spark.createDataFrame(apart, OBS), "height_1d")
    more = [("m", "A", 0.0, 0.0, 5.0, True), ("m", "B", 0.0, 0.0, 0.0, False), ("k", "A", 0.0, 0.0, 0.0, True)]
    rows = [*apart, ("m", "1", "HEIGHT_DIFFERENCE", "A", "B", NONE, 2.0, 1.0, NONE), ("k", "1", "HEIGHT_DIFFERENCE", "A", "Z", NONE, 2.0, 1.0, NONE)]
    out = adjustment.adjust(spark.createDataFrame(stations + more, STATIONS), spark.createDataFrame(rows, OBS), "height_1d")
    assert {r.network_id: (r.status, r.converged, r.rank_defect) for r in out["statistics"].collect()} == {"n": ("rank_defect", False, 1), "m": ("converged", True, 0), "k": ("missing_station", False, 0)}
    assert {r.network_id: r.z for r in out["stations"].where("station = 'B'").collect()} == {"n": NONE, "m": 7.0}
    assert {r.network_id for r in out["cofactors"].collect()} == {"m"} and out["residuals"].where("network_id <> 'm' and residual is not null").count() == 0


def test_an_unconverged_network_is_no_result(spark):
    stations = spark.createDataFrame([("n", "A", 0.0, 0.0, 0.0, True), ("n", "B", 100.0, 0.0, 0.0, True), ("n", "C", 90.0, 150.0, 0.0, False)], STATIONS)
    rows = [("n", "1", "HORIZONTAL_DISTANCE", "A", "C", NONE, 100.0, 1e-6, NONE), ("n", "2", "HORIZONTAL_DISTANCE", "B", "C", NONE, 80.0, 1e-6, NONE)]
    obs = spark.createDataFrame(rows, OBS)
    c = {r.station: r for r in adjustment.adjust(stations, obs, "plane_2d")["stations"].collect()}["C"]
    assert close(math.hypot(c.x, c.y), 100.0) and close(math.hypot(c.x - 100, c.y), 80.0)
    apart = [("n", "1", "HORIZONTAL_DISTANCE", "A", "C", NONE, 10.0, 1e-6, NONE), ("n", "2", "HORIZONTAL_DISTANCE", "B", "C", NONE, 10.0, 1e-6, NONE)]
    with pytest.raises(ValueError, match="not_converged|rank_defect"):  # circles that do not meet
        adjustment.adjust(stations, spark.createDataFrame(apart, OBS), "plane_2d")


def test_types_without_equation_are_refused(spark):
    stations = spark.createDataFrame([("n", "A", 0.0, 0.0, 0.0, True), ("n", "B", 1.0, 1.0, 0.0, False)], STATIONS)
    for kind, frame in (("BEARING", "plane_2d"), ("GRAVITY", "height_1d"), ("AZIMUTH", "gravity_1d"), (NONE, "plane_2d")):
        with pytest.raises(ValueError, match="no observation equation"):
            adjustment.adjust(stations, spark.createDataFrame([("n", "1", kind, "A", "B", NONE, 1.0, 1.0, NONE)], OBS), frame)
    with pytest.raises(ValueError, match="no observation equation"):
        adjustment.adjust_distributed(stations, spark.createDataFrame([("n", "1", "VERTICAL_ANGLE", "A", "B", NONE, 1.0, 1.0, NONE)], OBS), "local_3d")
    with pytest.raises(ValueError, match="variance"):
        adjustment.adjust(stations, spark.createDataFrame([("n", "1", "AZIMUTH", "A", "B", NONE, 1.0, 0.0, NONE)], OBS))


def braced(k, free=False):
    """A braced plane grid with the distances' errors and approximate coordinates."""
    r = np.random.default_rng(k)
    true = {(i, j): (100.0 * i + r.normal(0, 3), 100.0 * j + r.normal(0, 3)) for i in range(k) for j in range(k)}
    held = set() if free else {(0, 0), (k - 1, 0)}
    stations = [("g", f"{i}.{j}", x + (r.normal(0, 0.05) if (i, j) not in held else 0.0), y + (r.normal(0, 0.05) if (i, j) not in held else 0.0), 0.0, (i, j) in held) for (i, j), (x, y) in true.items()]
    rows = [("g", f"{i}.{j}-{m}.{n}", "HORIZONTAL_DISTANCE", f"{i}.{j}", f"{m}.{n}", NONE, math.dist(true[i, j], true[m, n]) + r.normal(0, 0.002), 4e-6, NONE) for i, j in true for m, n in ((i + 1, j), (i, j + 1), (i + 1, j + 1), (i - 1, j + 1)) if (m, n) in true]
    return stations, rows


@pytest.mark.parametrize("free", [False, True])
def test_levels_give_what_one_matrix_gives(spark, monkeypatch, free):
    stations, rows = braced(7, free)
    defect = ("x", "y", "rotation") if free else ()
    st, ob = spark.createDataFrame(stations, STATIONS), spark.createDataFrame(rows, OBS)
    results = []
    for dense in (384, 0):
        frame = "plane_2d"
        parts = adjustment._estimated(st, ob, frame, defect, None, 1, False) if dense else None
        if parts is None:  # the same in this process, with no network small enough for one matrix
            monkeypatch.setattr(gauss_newton, "DENSE", 0)
            own = [(0, "g", s, NONE, NONE, NONE, NONE, NONE, NONE, x, y, z, f, NONE) for _, s, x, y, z, f in stations] + [(1, "g", a, b, NONE, k, NONE, v, w, NONE, NONE, NONE, NONE, o) for _, o, k, a, b, _, v, w, _ in rows]
            table = spark.createDataFrame(own, ", ".join(f"{n} {t}" for n, t in adjustment._IN.items()) + ", fullname string").toArrow()
            out = adjustment._task(table, frame, defect, 1, False).to_pylist()
            results.append(({r["a"]: (r["x"], r["y"]) for r in out if r["what"] == 0}, {(r["a"], r["b"]): r["v"] for r in out if r["what"] == 2}, {r["a"]: r["x"] for r in out if r["what"] == 1}))
        else:
            results.append(({r.station: (r.x, r.y) for r in parts["stations"].collect()}, {(r.i, r.j): r.q for r in parts["cofactors"].collect()}, {r.obs: r.redundancy for r in parts["residuals"].collect()}))
            assert close(sum(results[0][2].values()), parts["statistics"].first().dof, 1e-6)
    for one, two in zip(*results, strict=True):
        assert one.keys() == two.keys()
        for key, value in one.items():
            assert np.allclose(value, two[key], rtol=1e-6, atol=1e-11)


def test_correlated_observations_are_weighted_together(spark):
    """Two baselines of a session and a third alone, against generalised least squares written out."""
    stations = spark.createDataFrame([("n", "A", 10.0, 20.0, 30.0, True), ("n", "B", 0.0, 0.0, 0.0, False), ("n", "C", 0.0, 0.0, 0.0, False)], STATIONS)
    axes = [("X_DIFFERENCE", 0), ("Y_DIFFERENCE", 1), ("Z_DIFFERENCE", 2)]
    vectors = [("AB", "A", "B", (100.0, 50.0, 5.0)), ("AC", "A", "C", (40.0, 90.0, -3.0)), ("BC", "B", "C", (-60.02, 40.01, -7.99))]
    rows = [("n", f"{name}{k}", kind, a, b, NONE, v[k], 1e-4 * (1 + k), NONE) for name, a, b, v in vectors for kind, k in axes]
    r = np.random.default_rng(5)
    cov = np.diag([x[7] for x in rows])
    half = r.normal(0, 0.004, (6, 6))
    cov[:6, :6] += half @ half.T
    rows = [(*x[:7], float(cov[i, i]), NONE) for i, x in enumerate(rows)]
    entries = [("n", rows[i][1], rows[j][1], float(cov[i, j])) for i in range(6) for j in range(i)]
    out = adjustment.adjust(stations, spark.createDataFrame(rows, OBS), "local_3d", covariances=spark.createDataFrame(entries, "network_id string, obs_a string, obs_b string, covariance double"))
    a = np.zeros((9, 6))
    for i, x in enumerate(rows):
        k = i % 3
        for s, sign in ((x[3], -1.0), (x[4], 1.0)):
            if s != "A":
                a[i, "BC".index(s) * 3 + k] = sign
    start = np.array([10.0, 20.0, 30.0])
    l = np.array([x[6] for x in rows])  # noqa: E741
    l[:6] += np.tile(start, 2)
    p = np.linalg.inv(cov)
    q = np.linalg.inv(a.T @ p @ a)
    x = q @ a.T @ p @ l
    got = {s.station: (s.x, s.y, s.z) for s in out["stations"].collect()}
    assert np.allclose(got["B"], x[:3]) and np.allclose(got["C"], x[3:])
    v = a @ x - l
    redundancy = np.diag(np.eye(9) - a @ q @ a.T @ p)
    for s in out["residuals"].collect():
        k = [y[1] for y in rows].index(s.obs)
        assert close(s.residual, v[k]) and close(s.redundancy, redundancy[k])
    assert close(out["statistics"].first().vpv, v @ p @ v)
    found = {(s.i, s.j): s.q for s in out["cofactors"].collect()}
    assert close(found["B:x", "C:y"], q[0, 4], 1e-12) and close(found["C:z", "C:z"], q[5, 5], 1e-12)


def test_geocentric_network(spark):
    """Lines of sight, levelled differences and a baseline between points on the ellipsoid, from displaced coordinates."""
    from meridian.functions.geodesy import GRS80, geodetic_to_cartesian

    points = spark.createDataFrame([("A", -0.44, -0.85, 900.0), ("B", -0.4401, -0.8499, 950.0), ("C", -0.4399, -0.8498, 930.0)], "s string, lat double, lon double, h double")
    true = {r.s: np.array([r.x, r.y, r.z]) for r in points.select("s", *(v.alias(n) for n, v in zip("xyz", geodetic_to_cartesian(F.col("lat"), F.col("lon"), F.col("h")), strict=True))).collect()}
    turn, height = adjustment._local_horizon(GRS80)(np.stack([true[s] for s in "ABC"]))
    assert np.allclose(height, [900.0, 950.0, 930.0], atol=1e-6)
    sight = lambda a, b: turn["ABC".index(a)] @ (true[b] - true[a])
    rows = []
    for a, b in ("AB", "AC", "BC", "CB"):
        e, n, u = sight(a, b)
        rows += [("AZIMUTH", a, b, math.atan2(e, n), 1e-12), ("ZENITH_ANGLE", a, b, math.atan2(math.hypot(e, n), u), 1e-12), ("SLOPE_DISTANCE", a, b, float(np.linalg.norm(true[b] - true[a])), 1e-6), ("HEIGHT_DIFFERENCE", a, b, float(height["ABC".index(b)] - height["ABC".index(a)]), 1e-6)]
    rows += [("X_DIFFERENCE", "A", "B", float((true["B"] - true["A"])[0]), 1e-6), ("Z_COORDINATE", "C", NONE, float(true["C"][2]), 1e-6)]
    obs = spark.createDataFrame([("n", str(k), kind, a, b, NONE, v, w, NONE) for k, (kind, a, b, v, w) in enumerate(rows)], OBS)
    stations = spark.createDataFrame([("n", s, *(float(c) + (0.5 if s != "A" else 0.0) for c in p), s == "A") for s, p in true.items()], STATIONS)
    got = {r.station: (r.x, r.y, r.z) for r in adjustment.adjust(stations, obs, "geocentric_3d")["stations"].collect()}
    assert all(np.allclose(got[s], true[s], atol=1e-4) for s in "ABC")


def test_gravity_network_with_drift(spark):
    g, drift = {"A": 9.78e5, "B": 9.79e5, "C": 9.785e5}, {"s1": (0.3, -0.02), "s2": (-0.1, 0.05)}
    rows = []
    for owner, (one, two) in drift.items():
        for k, (a, b) in enumerate(["AB", "BC", "CA", "AC", "BA"]):
            t0, t1 = k * 0.7, k * 0.7 + 0.5
            rows.append(("n", f"{owner}-{k}", "GRAVITY_DIFFERENCE", a, b, NONE, g[b] - g[a] + one * (t1 - t0) + two * (t1**2 - t0**2), 1e-4, owner, t0, t1))
    obs = spark.createDataFrame(rows, OBS + ", elapsed_at double, elapsed_to double")
    stations = spark.createDataFrame([("n", s, 0.0, 0.0, v if s == "A" else 9e5, s == "A") for s, v in g.items()], STATIONS)
    out = adjustment.adjust(stations, obs, "gravity_1d", degree=2)
    assert {r.station: round(r.z, 6) for r in out["stations"].collect()} == g
    assert out["statistics"].first().unknowns == 6 and "drift_2:s1" in {r.i for r in out["cofactors"].collect()}


def test_variance_components(spark):
    r = np.random.default_rng(4)
    stations = spark.createDataFrame([("n", f"P{i}", 0.0, 0.0, 0.0, i == 0) for i in range(20)], STATIONS)
    pairs = [(i, j, k) for i in range(20) for j in range(i + 1, 20) for k in range(2)]
    rows = [("n", f"{i}-{j}-{k}", "HEIGHT_DIFFERENCE", f"P{i}", f"P{j}", NONE, float(j - i + r.normal() * (1, 3)[k]), 1.0, NONE, "ab"[k]) for i, j, k in pairs]
    obs = spark.createDataFrame(rows, OBS + ", kind string")
    got = {x.kind: x.factor for x in adjustment.variance_components(stations, obs, "height_1d", "kind").collect()}
    a = np.zeros((len(rows), 20))
    for m, (i, j, _) in enumerate(pairs):
        a[m, i], a[m, j] = -1.0, 1.0
    a, l, kind = a[:, 1:], np.array([x[6] for x in rows]), np.array([p[2] for p in pairs])  # noqa: E741
    v = np.array([got["a"], got["b"]])[kind]
    q = np.linalg.inv(a.T @ (a / v[:, None]))
    e = a @ (q @ a.T @ (l / v)) - l
    redundancy = 1 - np.einsum("ij,jk,ik->i", a, q, a) / v
    for k in (0, 1):  # at the fixed point v'Pv of a group is its redundancy
        assert close((e**2 / v)[kind == k].sum() / redundancy[kind == k].sum(), 1.0, 1e-3)
    with pytest.raises(ValueError, match="settle"):
        adjustment.variance_components(stations, obs, "height_1d", "kind", rounds=1)
    exact = spark.createDataFrame([(*x[:6], 0.0, *x[7:]) for x in rows], OBS + ", kind string")
    with pytest.raises(ValueError, match="zero"):
        adjustment.variance_components(stations, exact, "height_1d", "kind")


def test_distributed_plane_network(spark):
    stations, rows = braced(4)
    st, ob = spark.createDataFrame(stations, STATIONS), spark.createDataFrame(rows, OBS)
    one = {r.station: (r.x, r.y) for r in adjustment.adjust(st, ob)["stations"].collect()}
    assert all(np.allclose(one[r.station], (r.x, r.y), atol=1e-5) for r in adjustment.adjust_distributed(st, ob).collect())


def test_free_height_network_keeps_the_mean(spark):
    stations = spark.createDataFrame([("n", s, 0.0, 0.0, z, False) for s, z in (("A", 1.0), ("B", 2.0), ("C", 3.0))], STATIONS)
    obs = spark.createDataFrame([("n", "1", "HEIGHT_DIFFERENCE", "A", "B", NONE, 1.2, 1.0, NONE), ("n", "2", "HEIGHT_DIFFERENCE", "B", "C", NONE, 1.2, 1.0, NONE)], OBS)
    z = {r.station: r.z for r in adjustment.adjust(stations, obs, "height_1d", ("z",))["stations"].collect()}
    assert close(sum(z.values()), 6.0) and close(z["B"] - z["A"], 1.2)


def test_directions_angles_and_distances(spark):
    true = {"A": (0.0, 0.0), "B": (100.0, 0.0), "C": (60.0, 80.0)}
    stations = spark.createDataFrame([("n", s, x + (0.4 if s == "C" else 0), y - (0.3 if s == "C" else 0), 0.0, s != "C") for s, (x, y) in true.items()], STATIONS)
    az = lambda a, b: math.atan2(true[b][0] - true[a][0], true[b][1] - true[a][1])
    rows = [("n", "d1", "DIRECTION", "A", "B", NONE, (az("A", "B") - 0.7) % (2 * math.pi), 1e-10, "s1"), ("n", "d2", "DIRECTION", "A", "C", NONE, (az("A", "C") - 0.7) % (2 * math.pi), 1e-10, "s1"), ("n", "a1", "HORIZONTAL_ANGLE", "B", "A", "C", (az("B", "C") - az("B", "A")) % (2 * math.pi), 1e-10, NONE), ("n", "l", "HORIZONTAL_DISTANCE", "A", "C", NONE, 100.0, 1e-6, NONE)]
    out = adjustment.adjust(stations, spark.createDataFrame(rows, OBS), "plane_2d")
    c = {r.station: r for r in out["stations"].collect()}["C"]
    assert close(c.x, 60.0) and close(c.y, 80.0)


def test_calibration_table(spark):
    table = spark.createDataFrame([("g", 0.0, 100.0, 1.0), ("g", 10.0, 112.0, 1.5), ("g", 20.0, 130.0, 2.0)], "instrument string, counter double, gravity double, factor double")
    rows = spark.createDataFrame([(i, "g", c) for i, c in enumerate((-1.0, 0.0, 9.0, 10.0, 25.0, 30.0, 31.0))], "k int, instrument string, counter double")
    assert [r.value for r in gravimetry.calibrated(rows, table).orderBy("k").collect()] == [None, 100.0, 109.0, 112.0, 140.0, 150.0, None]


def test_overlap_is_strict(spark):
    rows = [("a", "2024-01-01 00:00", "2024-01-01 02:00"), ("b", "2024-01-01 02:00", "2024-01-01 03:00"), ("c", "2024-01-01 02:30", "2024-01-01 04:00"), ("d", None, None)]
    s = spark.createDataFrame(rows, "session string, s string, e string").select("session", F.to_timestamp("s").alias("start"), F.to_timestamp("e").alias("end"))
    assert {r.session: r.group for r in gnss.overlap_groups(s).collect()} == {"a": 1, "b": 2, "c": 2, "d": None}


def test_dilution_of_precision(spark):
    az = [0.0, math.pi / 2, math.pi, 3 * math.pi / 2, 0.0]
    el = [0.3, 0.3, 0.3, 0.3, math.pi / 2]
    s = spark.createDataFrame([("s", 1, a, e) for a, e in zip(az, el, strict=True)] + [("t", 1, 0.0, 0.3)], "session string, instant int, azimuth double, elevation double")
    got = {r.session: r for r in gnss.dilution_of_precision(s).collect()}
    a = np.array([[math.cos(e) * math.sin(z), math.cos(e) * math.cos(z), math.sin(e), 1] for z, e in zip(az, el, strict=True)])
    q = np.diag(np.linalg.inv(a.T @ a))
    assert close(got["s"].pdop, math.sqrt(q[:3].sum())) and close(got["s"].vdop, math.sqrt(q[2])) and got["t"].gdop is None


def test_resection_and_parallel_rays(spark):
    known = [(0.0, 0.0), (100.0, 0.0), (50.0, 120.0), (-30.0, 60.0)]
    x, y, o = 40.0, 30.0, 1.1
    rows = [("P", a, b, (math.atan2(a - x, b - y) - o) % (2 * math.pi), 1e-10, 35.0, 25.0) for a, b in known]
    r = total_station.resections(spark.createDataFrame(rows, "station string, x double, y double, direction double, variance double, approximate_x double, approximate_y double")).first()
    assert close(r.x, x) and close(r.y, y) and close(r.orientation, o)
    rays = spark.createDataFrame([("t", 0.0, 0.0, 0.5, 1e-10), ("t", 10.0, 0.0, 0.5, 1e-10)], "target string, x double, y double, azimuth double, variance double")
    assert [r.x for r in total_station.intersections(rays).collect()] in ([], [None])


def test_traverse_methods(spark):
    legs = [("t", 1, math.pi / 2, 100.0), ("t", 2, math.pi / 2, 50.0), ("t", 3, math.pi / 2, 100.0), ("t", 4, math.pi / 2, 50.1)]
    rows = spark.createDataFrame(legs, "traverse string, seq int, angle double, distance double").withColumns({"start_azimuth": F.lit(0.0), "start_x": F.lit(0.0), "start_y": F.lit(0.0), "close_x": F.lit(0.0), "close_y": F.lit(0.0), "close_azimuth": F.lit(0.0)})
    for method in ("compass", "transit"):
        last = total_station.traverse(rows, method=method).orderBy(F.desc("seq")).first()
        assert close(last.x, 0.0) and close(last.y, 0.0) and close(last.misclosure, 0.1) and close(last.angular_misclosure, 0.0)
    open_end = total_station.traverse(rows, method="none").orderBy(F.desc("seq")).first()
    assert close(math.hypot(open_end.x, open_end.y), 0.1)


def test_components_and_inspection(spark):
    stations = spark.createDataFrame([("n", s, 0.0, 0.0, False) for s in "ABCDE"], "network_id string, station string, x double, y double, fixed boolean")
    obs = spark.createDataFrame([("n", "1", "HEIGHT_DIFFERENCE", ["A", "B"], "ACTIVE"), ("n", "2", "HEIGHT_DIFFERENCE", ["B", "C"], "ACTIVE"), ("n", "3", "HEIGHT_DIFFERENCE", ["C", "D"], "REJECTED"), ("n", "4", "HEIGHT_DIFFERENCE", ["D", "Z"], "ACTIVE"), ("n", "5", "HEIGHT_DIFFERENCE", ["A", "B"], "ACTIVE")], "network_id string, observation string, type string, stations array<string>, status string")
    codes = {(r.code, r.subject) for r in network.inspect(stations, obs, "height_1d").collect()}
    assert {("UNKNOWN_STATION", "4:Z"), ("DUPLICATE_OBSERVATION", "HEIGHT_DIFFERENCE:A-B:2")} <= codes and any(c == "DISCONNECTED" for c, _ in codes)
    assert network.worst_severity(network.inspect(stations, obs, "height_1d")).first().severity == "BLOCKING"


def test_alert_limits_are_strict(spark):
    moved = spark.createDataFrame([("A", 0.5, 0.3, -0.2, False), ("B", 0.6, 0.3, 0.1, True)], "station string, magnitude double, horizontal double, dz double, significant boolean")
    limits = spark.createDataFrame([("t", "magnitude", 0.5, None), ("v", "vertical", 0.1, ["B"])], "threshold string, kind string, limit double, stations array<string>")
    crossed = monitoring.alerts(limits, moved)
    assert [(r.threshold, r.station) for r in crossed.collect()] == [("t", "B")]
    assert {r.station: r.category for r in monitoring.station_category(moved, crossed).collect()} == {"A": "none", "B": "alert"}


def test_unstable_reference_is_found(spark):
    rows = [("b", s, dx, 0.0, 0.0, 1e-6, 1e-6, 1e-6, 1.0, 30) for s, dx in (("A", 0.0), ("B", 0.0005), ("C", -0.0005), ("D", 0.05))]
    block = spark.createDataFrame(rows, "block string, station string, dx double, dy double, dz double, qx double, qy double, qz double, pooled double, dof int")
    assert [r.station for r in monitoring.unstable_reference(block, ["block"]).orderBy("step").collect()] == ["D"]


def test_strain_of_a_rotation_is_zero(spark):
    rows = [("b", x, y, -1e-5 * y, 1e-5 * x) for x, y in ((0.0, 0.0), (100.0, 0.0), (0.0, 100.0), (70.0, 80.0))]
    r = monitoring.strain(spark.createDataFrame(rows, "block string, x double, y double, dx double, dy double"), ["block"]).first()
    assert close(r.rotation, 1e-5, 1e-12) and close(r.shear, 0.0, 1e-12) and close(r.dilatation, 0.0, 1e-12)


def test_store_differences_by_bits(spark):
    a = spark.createDataFrame([(1, 0.0), (2, float("nan")), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, -0.0), (2, float("nan")), (4, 1.0)], "k int, v double")
    assert sorted((r.k, r.column_name) for r in store.differences(a, b, ["k"]).collect()) == [(1, "v"), (3, None), (4, None)]


def test_exported_sheets(spark, tmp_path):
    results = {"stations": spark.createDataFrame([("n", "A", 1.1, 2.0, 3.0)], "network_id string, station string, x double, y double, z double")}
    assert store.export_sheets(results, f"file://{tmp_path}") == ["stations"]
    assert spark.read.csv(f"file://{tmp_path}/stations", header=True).first().x == "1.1"


def test_three_wires_in_order(spark):
    w = levelling.three_wire(F.lit(1.5), F.lit(1.2), F.lit(0.9), F.lit(3e-6))
    bad = levelling.three_wire(F.lit(1.5), F.lit(1.6), F.lit(0.9), F.lit(3e-6))
    r = spark.range(1).select(w["reading"].alias("a"), w["variance"].alias("b"), w["distance"].alias("c"), bad["reading"].alias("d")).first()
    assert close(r.a, 1.2) and close(r.b, 1e-6, 1e-12) and close(r.c, 60.0) and r.d is None


def test_upsert_of_repeats_and_null_keys(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("a", 9), (None, 8)], "k string, v int")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"]).collect() if r.k) == [("a", 9), ("b", 3)]
    assert [r.v for r in store.upsert(old, new, ["k"]).where("k is null").collect()] == [8]


def test_builders_and_loops(spark):
    b = spark.createDataFrame([("e1", "A", "B", 1.0), ("e2", "B", "C", 2.0), ("e3", "A", "C", 3.0), ("e4", "C", "D", 1.0), ("e5", "D", "A", 5.0), ("e6", "B", "A", 9.0), ("e7", "X", "X", 1.0)], "baseline string, base string, rover string, cxx double").withColumns({"cyy": F.lit(0.0), "czz": F.lit(0.0)})
    own = builders.independent_subset(b)
    assert {r.baseline for r in own.where("independent").collect()} == {"e1", "e2", "e4"}
    loops = {}
    for r in builders.closing_loops(own).orderBy("loop", "seq").collect():
        loops.setdefault(r.loop, []).append((r.baseline, r.sign))
    assert loops == {"e3": [("e3", 1), ("e2", -1), ("e1", -1)], "e5": [("e5", 1), ("e1", 1), ("e2", 1), ("e4", 1)]}
    assert builders.independent_subset(b.limit(0)).collect() == []
    with pytest.raises(Exception, match="no way from this height"):
        builders.harmonised(spark.createDataFrame([("s", 1.0, 0.1, "normal", None, None)], "station string, height double, variance double, height_type string, undulation double, undulation_variance double")).collect()
    sigma, _ = builders.resolved_sigma(F.col("a"), F.col("b"), F.col("c"), F.lit(4))
    rows = spark.createDataFrame([(None, None, None)], "a double, b double, c double")
    with pytest.raises(Exception, match="no sigma"):
        rows.select(sigma).collect()


def test_total_station_network_with_heights_of_instrument_and_target(spark):
    """Slope distances and zenith angles above the marks give the marks."""
    true = {"A": (0.0, 0.0, 10.0), "B": (100.0, 0.0, 12.0), "C": (60.0, 80.0, 15.0)}
    rows = []
    for k, (a, t) in enumerate(["AC", "BC", "AB", "BA"]):
        e, n, u = (y - x for x, y in zip(true[a], true[t]))
        u += 1.3 - 1.6
        flat = math.hypot(e, n)
        rows.append(("n", f"s{a}", a, t, math.atan2(e, n) % (2 * math.pi), math.atan2(flat, u), math.hypot(flat, u), 1e-10, 1e-10, 1e-6, 1.6, 1.3))
    names = "network_id string, setup string, station string, target string, horizontal double, zenith double, distance double, horizontal_variance double, zenith_variance double, distance_variance double, instrument_height double, target_height double"
    obs = builders.total_station_observations(spark.createDataFrame(rows, names), 3)
    known = spark.createDataFrame([("n", "A", *true["A"], True), ("n", "B", *true["B"], True), ("n", "C", 59.0, 81.0, 14.0, False)], STATIONS)
    out = adjustment.adjust(builders.network_stations(obs, known), obs, "local_3d")
    got = {r.station: (r.x, r.y, r.z) for r in out["stations"].collect()}
    assert np.allclose(got["C"], true["C"], atol=1e-6)
    assert builders.detect_defect(obs, "local_3d").first().defect == ["x", "y", "z", "rotation"]


def test_solutions_must_be_comparable(spark):
    one = spark.createDataFrame([("plane", "d1")], "frame string, datum string")
    solutions.require_comparable(one, one)
    with pytest.raises(ValueError, match="datum"):
        solutions.require_comparable(one, one.withColumn("datum", F.lit("d2")))


def test_printed_covariances(spark):
    m = [[1.0, 0.5], [0.5, 0.2499]]  # just negative, as rounding makes it
    rows = [("k", i, j, m["pq".index(i)]["pq".index(j)]) for i in "pq" for j in "pq"]
    got = matrices.from_printed(spark.createDataFrame(rows, "k string, i string, j string, v double"), ["k"], 1e-3).collect()
    back = np.array([[next(r.v for r in got if (r.i, r.j) == (i, j)) for j in "pq"] for i in "pq"])
    assert all(r.conditioned for r in got) and np.linalg.eigvalsh(back)[0] > -1e-12 and np.allclose(back, m, atol=1e-3)
    with pytest.raises(Exception, match="beyond its rounding"):
        matrices.from_printed(spark.createDataFrame(rows, "k string, i string, j string, v double"), ["k"], 1e-9).collect()
    bad = spark.createDataFrame([("k", "p", "p", -1.0), ("k", "q", "q", 2.0)], "k string, i string, j string, v double")
    with pytest.raises(Exception, match="negative beyond rounding"):
        matrices.zero_rounded(bad, ["k"]).collect()


def test_gravity_network_from_visits(spark):
    """Readings of a drifting meter over a loop, through visits and correlated differences, give gravity and drift back."""
    g = {"A": 980.0, "B": 981.5, "C": 979.25}
    visits = [("s", k + 1, s, g[s] + 0.02 * t, 1e-6, 3600.0 * t) for k, (s, t) in enumerate(zip("ABCABCA", (0.0, 0.4, 1.1, 1.7, 2.0, 2.9, 3.3)))]
    v = spark.createDataFrame(visits, "session string, visit int, station string, value double, variance double, seconds double")
    known = spark.createDataFrame([("A", g["A"], 0.0), ("B", g["B"], 1e-4)], "station string, value double, variance double")
    stations, obs, cov = builders.gravity_network(v, known)
    out = adjustment.adjust(stations, obs, "gravity_1d", covariances=cov)
    assert {r.station: round(r.z, 6) for r in out["stations"].collect()} == g
    assert cov.count() == 5 and out["statistics"].first().unknowns == 3
    assert [r.estimable for r in builders.estimable_drifts(v).collect()] == [True]


def test_combined_networks(spark):
    first = spark.createDataFrame([("n", "A", 0.0, 0.0, 10.0, True), ("n", "B", 0.0, 0.0, 0.0, False)], STATIONS)
    second = spark.createDataFrame([("n", "B", 0.0, 0.0, 11.0, False), ("n", "C", 0.0, 0.0, 0.0, False)], STATIONS)
    one = spark.createDataFrame([("n", "1", "HEIGHT_DIFFERENCE", "A", "B", NONE, 1.0, 1.0, NONE)], OBS)
    two = spark.createDataFrame([("n", "1", "HEIGHT_DIFFERENCE", "B", "C", NONE, 2.0, 1.0, NONE)], OBS)
    out = adjustment.adjust(*builders.combined({"level": (first, one), "trig": (second, two)}), "height_1d")
    assert {r.station: round(r.z, 9) for r in out["stations"].collect()} == {"A": 10.0, "B": 11.0, "C": 13.0}
    with pytest.raises(Exception, match="held at two places"):
        builders.combined({"level": (first, one), "trig": (first.withColumn("z", F.col("z") + 1), two)})[0].collect()
