"""Networks of stations and observations: filters, integrity, inspection, components, approximate values.

stations: network_id, station, and optionally x, y, z, and fixed. observations: network_id, observation, type,
stations array<string>, status, cluster. Findings are rows: network_id, code, severity, subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.sources.shared import discard, stored

BLOCKING, WARNING, INFO = "BLOCKING", "WARNING", "INFO"
#: Severities from the least serious.
SEVERITIES = (INFO, WARNING, BLOCKING)
#: Observation types with their number of components and the unknowns of a station a frame needs.
COMPONENTS = {"GNSS_BASELINE": 3, "GNSS_POINT": 3}
FRAME_NEEDS = {"height_1d": 1, "gravity_1d": 1, "plane_2d": 2, "local_3d": 3, "geocentric_3d": 3}


def active_observations(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("status") == "ACTIVE")


def observations_at(observations: DataFrame, station: str) -> DataFrame:
    return observations.where(F.array_contains("stations", station))


def active_clusters(entries: DataFrame, observations: DataFrame) -> DataFrame:
    """Covariance entries (network_id, cluster, first, second, value) between active members."""
    live = active_observations(observations)
    first = live.select("network_id", F.col("observation").alias("first"))
    second = live.select("network_id", F.col("observation").alias("second"))
    return entries.join(first, ["network_id", "first"], "left_semi").join(second, ["network_id", "second"], "left_semi")


def _finding(code: str, severity: str, rows: DataFrame, subject: Column) -> DataFrame:
    return rows.select("network_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))


def dangling_references(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of stations that the network does not have."""
    named = observations.select("network_id", "observation", F.explode("stations").alias("station"))
    return _finding("UNKNOWN_STATION", BLOCKING, named.join(stations.select("network_id", "station"), ["network_id", "station"], "left_anti"), F.concat_ws(":", "observation", "station"))


def duplicate_observations(observations: DataFrame) -> DataFrame:
    """Active observations of one type between the same stations, more than once."""
    groups = active_observations(observations).groupBy("network_id", "type", "stations").agg(F.count("*").alias("n"))
    return _finding("DUPLICATE_OBSERVATION", INFO, groups.where("n > 1"), F.concat_ws(":", "type", F.array_join("stations", "-"), F.col("n").cast("string")))


def component_count(type_col: Column) -> Column:
    return F.when(type_col.isin(*COMPONENTS), 3).otherwise(1)


def under_observed(stations: DataFrame, observations: DataFrame, frame: str) -> DataFrame:
    """Free stations with some observed components but fewer than the frame needs."""
    counts = active_observations(observations).select("network_id", F.explode(F.array_distinct("stations")).alias("station"), component_count(F.col("type")).alias("n")).groupBy("network_id", "station").agg(F.sum("n").alias("n"))
    short = stations.where(~F.coalesce(F.col("fixed"), F.lit(False))).join(counts, ["network_id", "station"]).where(F.col("n") < FRAME_NEEDS[frame])
    return _finding("UNDER_OBSERVED", WARNING, short, F.col("station"))


def missing_coordinates(stations: DataFrame) -> DataFrame:
    return _finding("NO_APPROXIMATE_COORDINATES", WARNING, stations.where(F.col("x").isNull() | F.col("y").isNull()), F.col("station"))


def observed_pairs(observations: DataFrame) -> DataFrame:
    """Distinct unordered pairs of stations within an observation: three for an angle."""
    i = F.transform("stations", lambda a: F.transform("stations", lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    pairs = active_observations(observations).select("network_id", F.explode(F.array_distinct(F.flatten(i))).alias("p"))
    return pairs.where("p.a <> p.b").select("network_id", "p.a", "p.b").distinct()


def connected_components(stations: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, station, component): the smallest station reachable. Labels spread over edges and jump to their own
    labels, so the number of rounds grows with the logarithm of a component's diameter."""
    both = stored(edges.select("network_id", "a", "b").unionByName(edges.select("network_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    before: list[DataFrame] = []
    labels = stored(stations.select("network_id", F.col("station").alias("a"), F.col("station").alias("l")).distinct())
    while True:
        met = both.join(labels.withColumnRenamed("a", "b"), ["network_id", "b"]).groupBy("network_id", "a").agg(F.min("l").alias("m"))
        spread = stored(labels.join(met, ["network_id", "a"], "left").select("network_id", "a", F.least("l", "m").alias("n"), "l"))
        # a label's own label is at least as small
        jump = spread.select("network_id", F.col("a").alias("n"), F.col("n").alias("j"))
        moved = stored(spread.join(jump, ["network_id", "n"]).select("network_id", "a", F.least("n", "j").alias("l"), F.col("l").alias("was")))
        discard(spread, *before)
        before, labels = [moved], moved.select("network_id", "a", "l")
        if moved.where("l <> was").isEmpty():
            discard(both)
            return labels.select("network_id", F.col("a").alias("station"), F.col("l").alias("component"))


def disconnected(stations: DataFrame, observations: DataFrame) -> DataFrame:
    """Networks in more than one piece, with the number of pieces."""
    labels = connected_components(stations, observed_pairs(observations))
    pieces = labels.groupBy("network_id").agg(F.countDistinct("component").alias("n")).where("n > 1")
    return _finding("DISCONNECTED", BLOCKING, pieces, F.col("n"))


def inspect(stations: DataFrame, observations: DataFrame, frame: str) -> DataFrame:
    """All findings on networks as planned or observed."""
    found = [dangling_references(stations, observations), duplicate_observations(observations), under_observed(stations, observations, frame), missing_coordinates(stations), disconnected(stations, observations)]
    return reduce(DataFrame.unionByName, found)


def worst_severity(findings: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy("network_id").agg(F.max_by("severity", rank).alias("severity"), F.count("*").alias("findings"))


def approximate_values(seeds: DataFrame, differences: DataFrame) -> DataFrame:
    """(network_id, station, value, depth): known values carried over differences (a, b, difference = b - a), each station taking
    that of its least depth, and there of the smallest neighbour. One join a level; only the frontier is joined."""
    both = stored(differences.select("network_id", "a", "b", "difference").unionByName(differences.select("network_id", F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("difference")).alias("difference"))))
    seen = stored(seeds.select("network_id", "station", "value", F.lit(0).alias("depth")))
    frontier, depth = seen, 0
    while True:
        depth += 1
        reached = frontier.withColumnRenamed("station", "a").join(both, ["network_id", "a"]).select("network_id", F.col("b").alias("station"), "a", (F.col("value") + F.col("difference")).alias("value"))
        new = reached.join(seen, ["network_id", "station"], "left_anti").groupBy("network_id", "station").agg(F.min_by("value", F.struct("a", "value")).alias("value"), F.lit(depth).alias("depth"))
        frontier = stored(new)
        if frontier.isEmpty():
            return seen
        seen = stored(seen.unionByName(frontier))


def carried_values(seeds: DataFrame, differences: DataFrame, components: tuple[str, ...] = ("value",)) -> DataFrame:
    """(network_id, station, components..): known values carried over differences (a, b and `d_component` = b - a), by pointer doubling. Each
    piece of a network takes the tie with the smallest hash to another and is put into its frame, so that pieces halve at least in a
    round, and chains of pieces are shortened by jumps that double; the rounds grow with the logarithm of the depth. Seeds keep their
    values, and seeded stations of a network are one piece from the start. Stations no seed reaches are not in the result."""
    offs = [f"o_{c}" for c in components]
    keys = ["network_id", "station"]
    deltas = [f"d_{c}" for c in components]
    kind = differences.schema["a"].dataType
    name = lambda c: F.col(c).cast("string").alias(c)
    ties = differences.where("a <> b").select("network_id", name("a"), name("b"), *deltas)
    stations = ties.select("network_id", F.col("a").alias("station")).unionByName(ties.select("network_id", F.col("b").alias("station"))).distinct()
    held = seeds.groupBy("network_id", name("station")).agg(*(F.min(c).alias(c) for c in components))
    # a label is the station that a piece is known by; "" is where seeds are
    named = stations.join(held.select(*keys), keys, "left_anti").select(*keys, F.col("station").alias("label"), *(F.lit(0.0).alias(o) for o in offs))
    labels = stored(named.unionByName(held.select(*keys, F.lit("").alias("label"), *(F.col(c).cast("double").alias(o) for c, o in zip(components, offs, strict=True)))))
    edges, first = ties.select("network_id", "a", "b", *deltas, F.struct(F.xxhash64("network_id", "a", "b"), "a", "b", *deltas).alias("rank")), True
    moves = labels.withColumnRenamed("station", "was")
    while True:
        side = lambda end: moves.select("network_id", F.col("was").alias(end), F.col("label").alias(f"l{end}"), *(F.col(o).alias(f"{o}{end}") for o in offs))
        how = "inner" if first else "left"  # later, pieces that stayed have no move
        met = edges.join(side("a"), ["network_id", "a"], how).join(side("b"), ["network_id", "b"], how)
        end = lambda e: F.coalesce(f"l{e}", e)
        off = lambda o, e: F.coalesce(f"{o}{e}", F.lit(0.0))
        between = [(off(o, "a") + F.col(d) - off(o, "b")).alias(d) for o, d in zip(offs, deltas, strict=True)]
        met = met.select("network_id", end("a").alias("a"), end("b").alias("b"), *between, "rank").where("a <> b")
        fresh = stored(met.groupBy("network_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min_by(F.struct("a", "b", *deltas, "rank"), "rank").alias("e")).select("network_id", "e.*"))
        if not first:
            discard(edges)
        edges, first = fresh, False
        if edges.isEmpty():
            break
        turned = edges.select("network_id", F.col("b").alias("a"), F.col("a").alias("b"), *((-F.col(d)).alias(d) for d in deltas), "rank")
        # a piece goes to the one its smallest tie leads to; of two that choose the same tie, the smaller name stays
        best = turned.unionByName(edges.select(*turned.columns)).where("a <> ''").groupBy("network_id", F.col("a").alias("was")).agg(F.min_by(F.struct("b", *deltas), "rank").alias("e"))
        best = best.select("network_id", "was", F.col("e.b").alias("label"), *((-F.col(f"e.{d}")).alias(o) for d, o in zip(deltas, offs, strict=True)))
        mutual = best.select("network_id", F.col("was").alias("label"), F.col("label").alias("was")).where("was < label")
        hooks = stored(best.join(mutual, ["network_id", "was", "label"], "left_anti"))
        while True:
            further = hooks.select("network_id", F.col("was").alias("label"), F.col("label").alias("next"), *(F.col(o).alias(f"n{o}") for o in offs))
            sums = [(F.col(o) + F.coalesce(f"n{o}", F.lit(0.0))).alias(o) for o in offs]
            jumped = stored(hooks.join(further, ["network_id", "label"], "left").select("network_id", "was", F.coalesce("next", "label").alias("label"), *sums, F.col("next").isNotNull().alias("moved")))
            discard(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        moves = hooks.drop("moved")
        step = moves.select("network_id", F.col("was").alias("label"), F.col("label").alias("next"), *(F.col(o).alias(f"n{o}") for o in offs))
        sums = [(F.col(o) + F.coalesce(f"n{o}", F.lit(0.0))).alias(o) for o in offs]
        renamed = stored(labels.join(step, ["network_id", "label"], "left").select(*keys, F.coalesce("next", "label").alias("label"), *sums))
        discard(labels)
        labels = renamed
    return labels.where("label = ''").select("network_id", F.col("station").cast(kind).alias("station"), *(F.col(o).alias(c) for o, c in zip(offs, components, strict=True)))


def rooted(ties: DataFrame) -> DataFrame:
    """(network_id, station, parent, leg, up): the forest that ties (network_id, a, b, leg) are, each tree rooted at its smallest station; `up`
    is 1 where going up takes the leg from a to b. The tree is walked around as a list of arcs, and the list is ranked by pointer
    doubling: of an edge's two arcs the one that comes first goes down. Rounds grow with the logarithm of a tree's size."""
    way = lambda a, b, sign: ties.select("network_id", F.col(a).alias("a"), F.col(b).alias("b"), "leg", F.lit(sign).alias("sign"))
    both = stored(way("a", "b", 1).unionByName(way("b", "a", -1)))
    stations = both.select("network_id", F.col("a").alias("station")).distinct()
    roots = connected_components(stations, ties.select("network_id", "a", "b")).where("station = component").select("network_id", F.col("station").alias("b"), F.lit(True).alias("is_root"))
    around = Window.partitionBy("network_id", "a").orderBy("b")
    after = both.select("network_id", F.col("a").alias("b"), F.col("b").alias("a"), F.lead("b").over(around).alias("c"), F.first("b").over(around).alias("c0"))
    # the arc a -> b goes on as b -> c, with c after a around b; a tree's walk ends where its root has no next one
    arcs = after.join(roots, ["network_id", "b"], "left").select("network_id", "a", "b", F.when(F.col("c").isNotNull() | F.col("is_root").isNull(), F.struct(F.col("b").alias("a"), F.coalesce("c", "c0").alias("b"))).alias("next"), F.lit(1).cast("long").alias("left"))
    arcs = stored(arcs)
    while not arcs.where("next is not null").isEmpty():
        ahead = arcs.select("network_id", F.struct("a", "b").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        jumped = stored(arcs.join(ahead, ["network_id", "next"], "left").select("network_id", "a", "b", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        discard(arcs)
        arcs = jumped
    back = arcs.select("network_id", F.col("a").alias("b"), F.col("b").alias("a"), F.col("left").alias("left_back"))
    down = arcs.join(back, ["network_id", "a", "b"]).where("left > left_back").select("network_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return stored(down.join(both, ["network_id", "a", "b"]).select("network_id", F.col("a").alias("station"), F.col("b").alias("parent"), "leg", F.col("sign").alias("up")))


def tree_paths(forest: DataFrame, ends: DataFrame) -> DataFrame:
    """(network_id, path, seq, leg, sign) of the legs from u to v for each of `ends` (network_id, path, u, v), along a forest of rooted(); none
    where both are in different trees. Ancestors are tabled at distances of powers of two; the meeting point is found from the
    highest power down, and a climb is written out by halving it. Rounds grow with the logarithm of the depth."""
    lifts = [forest.select("network_id", "station", F.col("parent").alias("above"))]
    depth = stored(lifts[0].select("network_id", "station", F.lit(1).cast("long").alias("depth"), F.col("above").alias("top")))
    while True:
        ahead = depth.select("network_id", F.col("station").alias("top"), F.col("depth").alias("more"), F.col("top").alias("then"))
        joined = stored(depth.join(ahead, ["network_id", "top"], "left").select("network_id", "station", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("then", "top").alias("top"), F.col("then").isNotNull().alias("moved")))
        discard(depth)
        depth = joined
        if depth.where("moved").isEmpty():
            break
        lifts.append(depth.where("moved").select("network_id", "station", F.col("top").alias("above")))
        below = lifts[-2]
        doubled = below.join(below.select("network_id", F.col("station").alias("above"), F.col("above").alias("then")), ["network_id", "above"]).select("network_id", "station", F.col("then").alias("above"))
        lifts[-1] = stored(doubled)
    known = depth.select("network_id", "station", "depth", F.col("top").alias("root"))

    def beside(rows: DataFrame, table: DataFrame, of: str, names: dict[str, str]) -> DataFrame:
        return rows.join(table.select("network_id", F.col("station").alias(of), *(F.col(a).alias(b) for a, b in names.items())), ["network_id", of], "left")

    pairs = ends
    for p in "uv":
        pairs = beside(pairs, known, p, {"depth": f"{p}_depth", "root": f"{p}_root"}).withColumn(f"{p}_depth", F.coalesce(f"{p}_depth", F.lit(0))).withColumn(f"{p}_root", F.coalesce(f"{p}_root", p))
    pairs = stored(pairs.where("u_root = v_root and u <> v").select("network_id", "path", "u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"), "u_depth", "v_depth", (F.col("u_depth") - F.col("v_depth")).alias("gap")))
    for k in range(len(lifts) - 1, -1, -1):  # the deeper end climbs to the other's depth
        for p, sign in (("u", 1), ("v", -1)):
            far = sign * F.col("gap") >= 1 << k
            pairs = beside(pairs, lifts[k], f"c{p}", {"above": "above"}).withColumn(f"c{p}", F.when(far, F.col("above")).otherwise(F.col(f"c{p}"))).withColumn("gap", F.when(far, F.col("gap") - (sign << k)).otherwise(F.col("gap"))).drop("above")
        pairs = stored(pairs) if k % 3 == 0 else pairs
    pairs = pairs.withColumn("climbed", F.lit(0).cast("long"))
    for k in range(len(lifts) - 1, -1, -1):  # both climb as long as they don't meet
        up = beside(beside(pairs, lifts[k], "cu", {"above": "au"}), lifts[k], "cv", {"above": "av"})
        apart = (F.col("cu") != F.col("cv")) & (F.col("au") != F.col("av"))
        pairs = up.select("network_id", "path", "u", "v", "u_depth", "v_depth", *(F.when(apart, F.col(f"a{p}")).otherwise(F.col(f"c{p}")).alias(f"c{p}") for p in "uv"), (F.col("climbed") + F.when(apart, 1 << k).otherwise(0)).alias("climbed"))
        pairs = stored(pairs) if k % 3 == 0 else pairs
    level = F.least("u_depth", "v_depth") - F.col("climbed") - F.when(F.col("cu") != F.col("cv"), 1).otherwise(0)
    met = pairs.select("network_id", "path", "u", "v", (F.col("u_depth") - level).alias("nu"), (F.col("v_depth") - level).alias("nv"))
    climb = F.explode(F.array(F.struct(F.col("u").alias("station"), F.col("nu").alias("n"), F.lit(0).cast("long").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("v").alias("station"), F.col("nv").alias("n"), (F.col("nu") + F.col("nv") - 1).alias("at"), F.lit(-1).alias("sign"))))
    parts = met.select("network_id", "path", climb.alias("c")).select("network_id", "path", "c.*").where("n > 0")
    for k in range(len(lifts) - 1, -1, -1):  # a climb of over 2^k legs is 2^k of them and the rest
        long = F.col("n") > 1 << k
        cut = beside(parts, lifts[k], "station", {"above": "above"})
        head = F.struct("station", F.when(long, 1 << k).otherwise(F.col("n")).cast("long").alias("n"), "at")
        tail = F.struct(F.col("above").alias("station"), (F.col("n") - (1 << k)).alias("n"), (F.col("at") + F.col("sign") * (1 << k)).alias("at"))
        parts = cut.select("network_id", "path", "sign", F.explode(F.when(long, F.array(head, tail)).otherwise(F.array(head))).alias("c")).select("network_id", "path", "c.*", "sign")
        parts = stored(parts) if k % 3 == 0 else parts
    legs = beside(parts, forest, "station", {"leg": "leg", "up": "up"})
    return legs.select("network_id", "path", F.col("at").cast("int").alias("seq"), "leg", (F.col("sign") * F.col("up")).alias("sign"))


def first_runs(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, and the number of the others."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("run", F.row_number().over(w.orderBy(*order))).withColumn("runs", F.count("*").over(w)).where("run = 1").drop("run")
