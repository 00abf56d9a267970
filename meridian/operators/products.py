"""Products that sessions need from outside their folders, found among the files of a directory: orbits and broadcast navigation by day.

Nothing is downloaded. What a file covers is a table of days: its name states one, or an orbit's header a span. Requests meet
these by kind and day, so each is one equi-join; where several files will do, the order of preference decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.records import sp3_span

#: Kinds, and the latencies of orbits, the best first; navigation is broadcast.
ORBIT, GPS_NAVIGATION, GLONASS_NAVIGATION = "orbit", "gps_navigation", "glonass_navigation"
LATENCIES = ("final", "rapid")
BROADCAST = "broadcast"
#: Seconds of a day that an orbit must cover to be of that day.
COVERED = 23 * 3600
#: How a file was found, in order of preference: its name is exact, a header's span is as good where no name is known.
BY_NAME, BY_SPAN = "name", "span"


def needed(sessions: DataFrame, precise: bool, glonass: bool = False, latency: str = "final") -> DataFrame:
    """(campaign, kind, day, latency): for each day that a campaign's sessions (campaign, first, last, navigation) touch, an orbit if `precise`, and
    broadcast navigation if no session of the campaign has its own. A session without an end touches its first day."""
    days = sessions.where("first is not null").select("campaign", F.explode(F.sequence(F.to_date("first"), F.greatest(F.to_date("first"), F.to_date(F.coalesce("last", "first"))))).alias("day")).distinct()
    own = sessions.groupBy("campaign").agg(F.max(F.coalesce(F.size("navigation"), F.lit(0)) > 0).alias("has_own"))
    navigation = [GPS_NAVIGATION] + [GLONASS_NAVIGATION] * glonass
    kinds = F.concat(F.array(*[F.lit(ORBIT)] * precise).cast("array<string>"), F.when(F.col("has_own"), F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, navigation))))
    rows = days.join(own, "campaign").select("campaign", F.explode(kinds).alias("kind"), "day")
    return rows.withColumn("latency", F.when(F.col("kind") == ORBIT, latency).otherwise(BROADCAST))


def named(name: Column) -> dict[str, Column]:
    """Kind, latency and day that a product's name states: igsWWWWD.sp3 and igrWWWWD.sp3, IGS0OPSFIN_YYYYDDD... and IGS0OPSRAP_... for orbits,
    brdcDDD0.YYn and .YYg for navigation; in upper or lower case, with or without .gz."""
    low = F.regexp_replace(F.lower(name), r"\.gz$", "")
    short, long, nav = r"^ig([sr])(\d{4})(\d)\.sp3$", r"^igs0ops(fin|rap)_(\d{4})(\d{3})\d{4}_01d_\d+m_orb\.sp3$", r"^brdc(\d{3})0\.(\d{2})([ng])$"
    n = lambda pattern, k: F.regexp_extract(low, pattern, k).try_cast("int")
    of_year = lambda year, day: F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)
    yy = n(nav, 2)
    kind = F.when(low.rlike(short) | low.rlike(long), ORBIT).when(low.rlike(nav), F.when(F.regexp_extract(low, nav, 3) == "n", GPS_NAVIGATION).otherwise(GLONASS_NAVIGATION))
    letter = F.coalesce(F.nullif(F.regexp_extract(low, short, 1), F.lit("")), F.when(F.regexp_extract(low, long, 1) == "fin", "s").when(F.regexp_extract(low, long, 1) == "rap", "r"))
    return {
        "kind": kind,
        "latency": F.when(kind == ORBIT, F.when(letter == "s", "final").when(letter == "r", "rapid")).when(kind.isNotNull(), BROADCAST),
        "day": F.when(low.rlike(short), F.date_add(F.lit("1980-01-06").cast("date"), n(short, 2) * 7 + n(short, 3)))
        .when(low.rlike(long), of_year(n(long, 2), n(long, 3)))
        .when(low.rlike(nav), of_year(yy + F.when(yy < 80, 2000).otherwise(1900), n(nav, 1))),
    }


def coverage(files: DataFrame) -> DataFrame:
    """(path, kind, latency, day, found_by): what files (path, head) are of. An orbit under another name covers each day of which its header's span has
    23 hours at least, at any latency (null)."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.withColumns({k: v for k, v in named(name).items()})
    by_name = own.where("kind is not null").select("path", "kind", "latency", "day", F.lit(BY_NAME).alias("found_by"))
    orbits = own.where(F.col("kind").isNull() & F.lower(name).rlike(r"\.sp3(\.gz)?$"))
    spans = orbits.select("path", sp3_span(F.col("head").cast("string"), F.lit(None).cast("int")).alias("s")).where("s.first is not null and s.last is not null")
    days = spans.select("path", "s.first", "s.last", F.explode(F.sequence(F.to_date("s.first"), F.to_date("s.last"))).alias("day"))
    begin = F.greatest(F.unix_seconds("first"), F.unix_seconds(F.col("day").cast("timestamp")))
    end = F.least(F.unix_seconds("last"), F.unix_seconds(F.date_add("day", 1).cast("timestamp")))
    by_span = days.where(end - begin >= COVERED).select("path", F.lit(ORBIT).alias("kind"), F.lit(None).cast("string").alias("latency"), "day", F.lit(BY_SPAN).alias("found_by"))
    return by_name.unionByName(by_span)


def resolve(requests: DataFrame, covered: DataFrame, fallback: bool = False) -> dict[str, DataFrame]:
    """Tables resolved (campaign, kind, day, latency, path, used, found_by), substituted (campaign, kind, day, latency, used) and missing (campaign, kind, day,
    latency, reason) of requests. A file of the latency asked for comes before one of a lower latency, which counts only with
    `fallback` and for orbits; then names before spans, then the first path. No request is in neither of resolved and missing."""
    keys = ["campaign", "kind", "day", "latency"]
    grade = lambda c: F.array_position(F.array(*map(F.lit, LATENCIES)), F.col(c))
    met = requests.distinct().join(covered.withColumnRenamed("latency", "has"), ["kind", "day"], "left")
    same = F.col("has").isNull() | (F.col("has") == F.col("latency"))
    lower = F.lit(fallback) & (F.col("kind") == ORBIT) & (grade("has") > grade("latency"))
    step = F.when(F.col("path").isNull(), None).when(same, 0).when(lower, grade("has") - grade("latency"))
    rank = F.struct(step.alias("step"), F.when(F.col("found_by") == BY_NAME, 0).otherwise(1).alias("how"), "path")
    best = met.groupBy(*keys).agg(F.min(F.when(step.isNotNull(), F.struct(*(rank[c].alias(c) for c in ("step", "how", "path")), F.coalesce("has", "latency").alias("used"), "found_by"))).alias("b"))
    found = best.where("b is not null").select(*keys, "b.path", "b.used", "b.found_by", "b.step")
    return {
        "resolved": found.drop("step"),
        "substituted": found.where("step > 0").select(*keys, "used"),
        "missing": best.where("b is null").select(*keys, F.lit("not found").alias("reason")),
    }
