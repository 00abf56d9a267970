"""Graph operators whose rounds grow with logarithms, against plain walks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from meridian.operators import builders, network


def test_values_are_carried_over_random_networks(spark):
    r = random.Random(6)
    true = {f"{n}{k}": (r.uniform(0, 100), r.uniform(0, 100)) for n in "pqr" for k in range(60)}
    ties = []
    for n in "pqr":
        for k in range(1, 60):
            ties.append((n, f"{n}{r.randrange(k)}", f"{n}{k}"))
        ties += [(n, f"{n}{r.randrange(60)}", f"{n}{r.randrange(60)}") for _ in range(40)]
    rows = [(n, a, b, true[b][0] - true[a][0], true[b][1] - true[a][1]) for n, a, b in ties] + [("p", "lost", "too", 1.0, 1.0)]
    seeds = [("p", "p5", *true["p5"]), ("p", "p40", *true["p40"]), ("q", "q0", *true["q0"]), ("q", "alone", 7.0, 8.0)]
    edges = spark.createDataFrame(rows, "network_id string, a string, b string, d_x double, d_y double")
    got = network.carried_values(spark.createDataFrame(seeds, "network_id string, station string, x double, y double"), edges, ("x", "y")).collect()
    assert {r.station for r in got} == {s for s in true if s[0] in "pq"} | {"alone"}  # r has no seed
    for row in got:
        assert (row.x, row.y) == pytest.approx(true.get(row.station, (7.0, 8.0)), abs=1e-9)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, stores = 1000, []
    monkeypatch.setattr(network, "stored", lambda df, f=network.stored: stores.append(1) or f(df))
    chain = spark.range(n).select(F.lit("c").alias("network_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.5).alias("d_value"))
    seeds = spark.createDataFrame([("c", 300, 10.0)], "network_id string, station long, value double")
    got = {r.station: r.value for r in network.carried_values(seeds, chain).collect()}
    assert got == {k: 10.0 + 0.5 * (k - 300) for k in range(n + 1)}
    assert len(stores) <= 60  # a walk takes one a station


def test_loops_of_a_long_chain(spark):
    n = 1000
    tree = [(f"t{k}", f"s{k:04}", f"s{k + 1:04}", True) if k % 3 else (f"t{k}", f"s{k + 1:04}", f"s{k:04}", True) for k in range(n)]
    more = [("whole", "s0000", f"s{n:04}", False), ("back", "s0700", "s0200", False), ("twice", "s0005", "s0006", False), ("triple", "s0003", "s0005", False)]
    b = spark.createDataFrame(tree + more, "baseline string, base string, rover string, independent boolean")
    began = time.time()
    got = {}
    for r in builders.closing_loops(b).collect():
        got.setdefault(r.loop, []).append((r.seq, r.baseline, r.sign))
    assert time.time() - began < 100
    step = lambda k: (f"t{k}", 1 if k % 3 else -1)
    down = lambda lo, hi: [(t, -s) for t, s in map(step, range(hi - 1, lo - 1, -1))]
    legs = {"whole": down(0, n), "triple": down(3, 5), "back": [step(k) for k in range(200, 700)]}
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: [(k, 1), *v] for k, v in legs.items()}
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_paths_in_random_trees(spark):
    r = random.Random(8)
    parent = {k: r.randrange(k) for k in range(1, 80)}
    ties = [("n", f"{a:03}", f"{b:03}", f"{a}-{b}") for k, p in parent.items() for a, b in [(k, p) if r.random() < 0.5 else (p, k)]]
    near = {}
    for _, a, b, leg in ties:
        near.setdefault(a, []).append((b, leg, 1))
        near.setdefault(b, []).append((a, leg, -1))

    def walk(u, v):
        todo = [(u, [])]
        for at, path in todo:
            if at == v:
                return path
            todo += [(b, [*path, (leg, s)]) for b, leg, s in near[at] if not path or leg != path[-1][0]]

    ends = [("n", f"e{k}", f"{r.randrange(80):03}", f"{r.randrange(80):03}") for k in range(60)] + [("n", "x", "000", "other"), ("n", "y", "004", "004")]
    forest = network.rooted(spark.createDataFrame(ties, "network_id string, a string, b string, leg string"))
    got = {}
    for row in network.tree_paths(forest, spark.createDataFrame(ends, "network_id string, path string, u string, v string")).collect():
        got.setdefault(row.path, []).append((row.seq, (row.leg, row.sign)))
    expected = {p: walk(u, v) for _, p, u, v in ends if v != "other" and u != v}
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == expected


def test_starting_positions(spark):
    """A network of every kind of placing: vectors, a polar survey by oriented directions, intersections, distances."""
    import math

    from meridian.operators import starting

    at = {"A": (100.0, 200.0), "B": (400.0, 260.0), "C": (300.0, 600.0), "D": (700.0, 500.0), "E": (900.0, 100.0), "F": (500.0, 900.0), "G": (50.0, 800.0), "H": (1000.0, 700.0), "I": (-50.0, 20.0)}
    azimuth = lambda a, b: math.atan2(at[b][0] - at[a][0], at[b][1] - at[a][1])
    rows = [("HORIZONTAL_DISTANCE", "B", "A", None, math.dist(at["A"], at["B"])), ("AZIMUTH", "A", "B", None, azimuth("A", "B"))]
    rows += [("X_DIFFERENCE", "C", "B", None, at["B"][0] - at["C"][0]), ("Y_DIFFERENCE", "C", "B", None, at["B"][1] - at["C"][1])]
    rows += [("DIRECTION", "C", t, "s1", azimuth("C", t) - 1.3) for t in "ABD"] + [("HORIZONTAL_DISTANCE", "C", "D", None, math.dist(at["C"], at["D"]))]
    rows += [("AZIMUTH", "B", "E", None, azimuth("B", "E")), ("AZIMUTH", "E", "D", None, azimuth("E", "D")), ("AZIMUTH", "A", "E", None, azimuth("A", "E") + 1e-9)]
    rows += [("HORIZONTAL_DISTANCE", "F", t, None, math.dist(at["F"], at[t])) for t in "ABCE"]
    rows += [("HORIZONTAL_DISTANCE", "G", t, None, math.dist(at["G"], at[t])) for t in "AB"]  # two distances only: either side
    rows += [("DIRECTION", "D", t, "s2", azimuth("D", t) + 0.4) for t in "EH"] + [("DIRECTION", "F", t, "s3", azimuth("F", t) - 2.0) for t in "DH"]
    obs = spark.createDataFrame([("n", *r) for r in rows], "network_id string, type string, at string, to string, setup string, value double")
    stations = spark.createDataFrame([("n", s, *(at[s] if s == "A" else (None, None))) for s in at], "network_id string, station string, x double, y double")
    got = {r.station: r for r in starting.starting_positions(stations, obs).collect()}
    for s in "ABCDEFH":
        assert (got[s].x, got[s].y) == pytest.approx(at[s], abs=1e-4)
    assert got["G"].x is None and got["I"].x is None
    assert [got[s].round for s in "ABCDEFH"] == [0, 0, 0, 1, 2, 3, 4] or got["H"].round <= 4
