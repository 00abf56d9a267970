"""Geoid grids and undulation parameters against plain NumPy."""

import math
import random

import numpy as np
import pytest

from meridian.operators import adjustment, geoid


def grid_cells(spark, grids):
    rows = [(p, i, j, float(g[i, j]), s, w, a, b) for p, (g, s, w, a, b) in grids.items() for i in range(g.shape[0]) for j in range(g.shape[1]) if not math.isnan(g[i, j])]
    return spark.createDataFrame(rows, "path string, row int, column int, value double, south double, west double, dlat double, dlon double")


def plain(grids, sigmas, lat, lon):
    fits = [(a * b, p) for p, (g, s, w, a, b) in grids.items() if -1e-9 <= (lat - s) / a <= g.shape[0] - 1 + 1e-9 and -1e-9 <= (lon - w) / b <= g.shape[1] - 1 + 1e-9]
    if not fits:
        return None
    p = min(fits)[1]
    g, s, w, a, b = grids[p]
    y, x = round((lat - s) / a, 9), round((lon - w) / b, 9)
    r, c = min(math.floor(y), g.shape[0] - 2), min(math.floor(x), g.shape[1] - 2)
    y, x = y - r, x - c
    n = sum(t * u * g[r + i, c + j] for i, t in ((0, 1 - y), (1, y)) for j, u in ((0, 1 - x), (1, x)) if t * u > 0)
    bends = []
    for axis in (0, 1):
        size, at, across = (g.shape[0], r, c) if axis == 0 else (g.shape[1], c, r)
        worst = 0.0
        if size >= 3:
            for k in (0, 1):
                m = min(max(at + k, 1), size - 2)
                for q in (across, across + 1):
                    line = g[m - 1 : m + 2, q] if axis == 0 else g[q, m - 1 : m + 2]
                    worst = max(worst, abs(line[0] - 2 * line[1] + line[2]))
        bends.append(worst)
    sigma = 0.5 * (bends[0] * y * (1 - y) + bends[1] * x * (1 - x))
    return p, n, sigma, sigmas.get(p, 0.05) ** 2 + sigma**2


def test_points_over_overlapping_grids(spark):
    r = np.random.default_rng(2)
    grids = {
        "coarse": (r.normal(40, 1, (6, 9)), 50.0, 8.0, 0.5, 0.75),
        "fine": (r.normal(41, 1, (12, 10)), 51.0, 9.5, 0.1, 0.2),
        "also": (r.normal(42, 1, (12, 10)), 51.0, 9.5, 0.1, 0.2),  # as fine: the first by name counts
        "strip": (r.normal(43, 1, (2, 20)), -1.0, -2.0, 0.25, 0.25),  # too narrow for curvature along one axis
    }
    rand = random.Random(3)
    points = [(rand.uniform(49.5, 53), rand.uniform(7.5, 15)) for _ in range(150)] + [(rand.uniform(-1.1, -0.7), rand.uniform(-2.2, 3)) for _ in range(40)]
    points += [(50.0, 8.0), (52.5, 14.0), (51.5, 8.75), (51.0, 9.5), (52.1, 11.3), (50.0, 8.0), (-0.75, 2.75)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(999, None, 9.0)], "k int, latitude double, longitude double")
    sigmas = spark.createDataFrame([("coarse", 0.2)], "path string, sigma double")
    got = {x.k: x for x in geoid.undulations(frame, grid_cells(spark, grids), sigmas).collect()}
    assert len(got) == len(points) + 1 and got[999].undulation is None
    used = set()
    for k, (lat, lon) in enumerate(points):
        want = plain(grids, {"coarse": 0.2}, lat, lon)
        if want is None:
            assert got[k].grid is None and got[k].undulation is None and got[k].undulation_variance is None
        else:
            used.add(want[0])
            assert got[k].grid == want[0]
            assert (got[k].undulation, got[k].interpolation_sigma, got[k].undulation_variance) == pytest.approx(want[1:], abs=1e-9)
    assert used == {"coarse", "also", "strip"}


def test_missing_corners_and_quadratics(spark):
    y, x = np.meshgrid(np.arange(5.0), np.arange(5.0), indexing="ij")
    surface = 3 * y * y - 2 * x * x + y * x
    gap = surface.copy()
    gap[4, 4] = math.nan
    points = spark.createDataFrame([(1, 1.25, 2.5), (2, 3.5, 3.5), (3, 4.0, 3.0)], "k int, latitude double, longitude double")
    got = {r.k: r for r in geoid.undulations(points, grid_cells(spark, {"g": (gap, 0.0, 0.0, 1.0, 1.0)})).collect()}
    # of a quadratic without mixed signs the sigma would be the error itself; here the axes' errors have unlike signs
    assert got[1].interpolation_sigma == pytest.approx(3 * 0.25 * 0.75 + 2 * 0.25) and got[2].undulation is None
    assert got[3].undulation == pytest.approx(surface[4, 3]) and got[3].interpolation_sigma == 0


OBS = "network_id string, obs string, type string, at string, to string, third string, value double, variance double, setup string, height_type string"


def test_levelling_and_gnss_with_undulations(spark):
    """One dense solution with heights and undulations as parameters and priors as rows."""
    r = np.random.default_rng(7)
    names = "ABCDE"
    height, und = dict(zip(names, (100.0, 103.0, 98.5, 110.0, 95.0), strict=True)), dict(zip(names, (40.0, 40.2, 40.4, 40.1, 39.9), strict=True))
    level = [("AB", 1e-6), ("BC", 1e-6), ("CA", 2e-6), ("CD", 1e-6)]
    gnss = [("AC", 1e-4), ("CD", 1e-4), ("DE", 1e-4), ("AE", 2e-4), ("BD", 1e-4)]
    rows = [("n", "l" + p, "HEIGHT_DIFFERENCE", p[0], p[1], None, height[p[1]] - height[p[0]] + r.normal(0, v**0.5), v, None, None) for p, v in level]
    rows += [("n", "g" + p, "HEIGHT_DIFFERENCE", p[0], p[1], None, height[p[1]] + und[p[1]] - height[p[0]] - und[p[0]] + r.normal(0, v**0.5), v, None, "ellipsoidal") for p, v in gnss]
    model = {s: und[s] + r.normal(0, 0.03) for s in names}
    stations = spark.createDataFrame([("n", s, 0.0, 0.0, height[s] if s == "A" else 0.0, s == "A") for s in names], "network_id string, station string, x double, y double, z double, fixed boolean")
    models = spark.createDataFrame([("n", s, model[s], 9e-4) for s in names], "network_id string, station string, undulation double, undulation_variance double")
    st, ob = geoid.with_undulations(stations, spark.createDataFrame(rows, OBS), models)
    out = adjustment.adjust(st, ob, "height_1d")
    z = {x.station: x.z for x in out["stations"].collect()}
    got = {x.station: x for x in geoid.geoid_residuals(out["residuals"], ob).collect()}

    unknowns = [("H", s) for s in "BCDE"] + [("N", s) for s in names]
    place = {u: k for k, u in enumerate(unknowns)}
    a, l, w = [], [], []
    for _, _, _, p, q, _, value, v, _, kind in rows:
        line, rest = np.zeros(len(unknowns)), value
        for s, sign in ((q, 1.0), (p, -1.0)):
            if s == "A":
                rest -= sign * height["A"]
            else:
                line[place["H", s]] += sign
            if kind:
                line[place["N", s]] += sign
        a.append(line), l.append(rest), w.append(1 / v)
    for s in names:
        line = np.zeros(len(unknowns))
        line[place["N", s]] = 1.0
        a.append(line), l.append(model[s]), w.append(1 / 9e-4)
    a, l, p = np.array(a), np.array(l), np.diag(w)
    q = np.linalg.inv(a.T @ p @ a)
    x = q @ a.T @ p @ l
    v = a @ x - l
    redundancy = np.diag((np.linalg.inv(p) - a @ q @ a.T) @ p)
    for s in "BCDE":
        assert z[s] == pytest.approx(x[place["H", s]], abs=1e-9)
    for k, s in enumerate(names, len(rows)):
        assert got[s].adjusted == pytest.approx(x[place["N", s]], abs=1e-9)
        assert (got[s].residual, got[s].redundancy) == pytest.approx((v[k], redundancy[k]), abs=1e-9)
        if redundancy[k] > 1e-6:
            assert got[s].standardised == pytest.approx(v[k] / math.sqrt(redundancy[k] * 9e-4), rel=1e-6)
        else:
            assert s == "E" and got[s].standardised is None  # nothing else tells its height
    with pytest.raises(Exception, match="no undulation at"):
        geoid.with_undulations(stations, spark.createDataFrame(rows, OBS), models.where("station <> 'D'"))[1].collect()
