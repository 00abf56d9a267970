"""Frame paths against a plain search and whole matrices."""

import numpy as np
import pytest

from meridian.operators import frames

NAMES = frames.PARAMETERS
HELD = [("A", "B", "ab"), ("B", "C", "bc"), ("C", "D", "cd"), ("A", "D", "ad"), ("E", "D", "ed"), ("X", "Y", "xy")]


def held(spark):
    r = np.random.default_rng(1)
    rows = []
    for source, target, code in HELD:
        p = [*r.normal(0, 1, 3), r.normal(0, 1e-6), *r.normal(0, 1e-5, 3)]
        rows.append((source, target, code, 2010.0, *map(float, p), *map(float, np.array(p) / 50), 0.01 * len(rows) + 0.01))
    schema = "source string, target string, code string, epoch double, " + ", ".join(f"{n} double" for n in NAMES) + ", " + ", ".join(f"d_{n} double" for n in NAMES) + ", accuracy double"
    return rows, spark.createDataFrame(rows, schema)


def search(source, target):
    """The shortest way, of several the one whose codes come first."""
    best, todo = None, [(source, [], {source})]
    for at, path, seen in todo:
        if at == target:
            best = min(best or (99,), (len(path), [HELD[k][2] for k, _ in path], path))
            continue
        todo += [(e, [*path, (k, back)], seen | {e}) for k, (a, b, _) in enumerate(HELD) for s, e, back in ((a, b, False), (b, a, True)) if s == at and e not in seen]
    return best and best[2]


def test_positions_in_other_frames(spark):
    rows, table = held(spark)
    points = [(k, s, t, 2000.0 + 3 * k, 4e6 + k, 1e6 - k, 4.8e6) for k, (s, t) in enumerate([(s, t) for s in "ABCDEX" for t in "ABCDEY"])]
    got = {r.k: r for r in frames.transformed(spark.createDataFrame(points, "k int, source string, target string, epoch double, x double, y double, z double"), table).collect()}
    assert len(got) == len(points)
    for k, s, t, epoch, *x in points:
        path = search(s, t)
        if path is None:
            assert got[k].status == "unavailable" and got[k].x is None and got[k].codes == []
            continue
        at, accuracy = np.array(x), 0.0
        for n, back in path:
            p = np.array(rows[n][4:11]) + (epoch - 2010.0) * np.array(rows[n][11:18])
            rx, ry, rz = p[4:]
            m = np.array([[1 + p[3], -rz, ry], [rz, 1 + p[3], -rx], [-ry, rx, 1 + p[3]]])
            at = np.linalg.solve(m, at - p[:3]) if back else p[:3] + m @ at
            accuracy += rows[n][18] ** 2
        assert got[k].status == "transformed" and (got[k].x, got[k].y, got[k].z) == pytest.approx(tuple(at), abs=1e-6)
        assert got[k].codes == ["-" * back + HELD[n][2] for n, back in path] and got[k].accuracy == pytest.approx(accuracy**0.5)
