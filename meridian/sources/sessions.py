"""Sessions out of folders of observation files, and the status files of a positioning engine.

Observation files are large and what tells a session stands at both ends, so they are read by a data source whose partitions
open only a file's first and last bytes. What a file says is cut out of these natively, navigation files are joined by the days
they are of, and whatever can't be used is a finding, never left out in silence.

Status files are read as lines by Spark, split at any place. A line knows its epoch, so nothing needs the whole file in order;
what depends on order (a second pass over an epoch, a counter that has moved) is told by the place of a line in its file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read of a file at its start and at its end.
HEAD, TAIL = 1 << 16, 1 << 16
#: Files of a partition.
FILES = 64
#: File names that are worth opening, and how they say that a file is compressed.
CANDIDATES = (".rnx", ".crx", ".gz", ".z", ".zip", ".o", ".d", ".n", ".g", ".l", ".h", ".p", ".m", ".c", ".f")
COMPRESSIONS = {".gz": "gzip", ".z": "compress", ".zip": "zip"}
WARNING = "WARNING"


def compression_of(name: str) -> str:
    """none, gzip, compress, zip, or hatanaka for observations stored as differences; the outer wrapping counts."""
    low = name.lower()
    for suffix, kind in COMPRESSIONS.items():
        if low.endswith(suffix):
            return kind
    return "hatanaka" if low.endswith(".crx") or low[-4:-3] == "." and low[-3:-1].isdigit() and low.endswith("d") else "none"


def is_candidate(name: str) -> bool:
    low = name.lower()
    return low.endswith(CANDIDATES) or low[-4:-3] == "." and low[-3:-1].isdigit() and low[-1:].isalpha()


class EndsOfFiles(DataSource):
    """(path, size, compression, head, tail, problem) of the candidates in a folder. Options: path; recursive; head and tail in bytes. Any
    file system that Arrow can open by its address will do. Of a gzip file the head is inflated and there is no tail."""

    @classmethod
    def name(cls) -> str:
        return "ends_of_files"

    def schema(self) -> str:
        return "path string, size long, compression string, head binary, tail binary, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _EndsReader(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _EndsReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.recursive = options["path"], options.get("recursive", "false").lower() == "true"
        self.head, self.tail = int(options.get("head", HEAD)), int(options.get("tail", TAIL))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, folder = self._system()
        if system.get_file_info(folder).type != fs.FileType.Directory:
            raise ValueError(f"{self.folder} is not a folder")
        found = system.get_file_info(fs.FileSelector(folder, recursive=self.recursive))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and is_candidate(f.base_name))
        return [_Files(paths[k : k + FILES]) for k in range(0, len(paths), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path in partition.paths:
            kind, size, head, tail, problem = compression_of(path), None, None, None, None
            try:
                with system.open_input_file(path) as file:
                    size = file.size()
                    head = file.read(self.head)
                    if kind == "gzip":
                        head = zlib.decompressobj(31).decompress(head, self.head)
                    elif kind in ("compress", "zip"):
                        problem, head = f"compressed by {kind}", None
                    elif kind == "none":
                        file.seek(max(0, size - self.tail))
                        tail = file.read(self.tail)
            except (OSError, zlib.error) as error:  # one bad file is a finding, not the end of the scan
                problem, head = str(error), None
            yield path, size, kind, head, tail, problem


def ends_of_files(spark: SparkSession, folder: str, recursive: bool = False, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    spark.dataSource.register(EndsOfFiles)
    return spark.read.format("ends_of_files").options(path=folder, recursive=str(recursive).lower(), head=head, tail=tail).load()


def hints_of(path: Column) -> dict[str, Column]:
    """Station, year and day of year that a file's name states, by the short (ssssdddf.yyo) or the long convention
    (SSSSMRCCC_S_YYYYDDDHHMM_...)."""
    name = F.element_at(F.split(path, "/"), -1)
    short, long = r"^(\w{4})(\d{3})\w\.(\d{2})[a-zA-Z]", r"^([A-Za-z0-9]{4})[A-Za-z0-9]{5}_[A-Z]_(\d{4})(\d{3})\d{4}_"
    is_long, is_short = name.rlike(long), name.rlike(short)
    yy = F.regexp_extract(name, short, 3).try_cast("int")
    pick = lambda of_long, of_short: F.when(is_long, of_long).when(is_short, of_short)
    return {
        "station": F.upper(pick(F.regexp_extract(name, long, 1), F.regexp_extract(name, short, 1))),
        "year": pick(F.regexp_extract(name, long, 2).try_cast("int"), yy + F.when(yy < 80, 2000).otherwise(1900)),
        "day": pick(F.regexp_extract(name, long, 3).try_cast("int"), F.regexp_extract(name, short, 2).try_cast("int")),
    }


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text.cast("string"), "\r\n?", "\n"), "\n")


def _moment(parts: Column, year: Column) -> Column:
    n = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    return F.try_make_timestamp(year, n(2), n(3), n(4), n(5), F.try_element_at(parts, F.lit(6)).try_cast("decimal(16,6)"))


def last_epochs(tails: DataFrame) -> DataFrame:
    """(path, last): the last line of a tail (path, version, first, tail) that is shaped like an epoch. Version 3 marks these by `>`; before,
    a year has two digits, of the century of the first epoch, and a flag and a number of satellites stand at fixed places."""
    rows = tails.select("path", "version", "first", F.posexplode(_lines(F.col("tail"))).alias("at", "line"))
    new = F.col("version") >= 3
    parts = F.split(F.trim(F.substring("line", 2, 60)), r"\s+")
    modern = F.when(F.col("line").startswith(">"), _moment(parts, F.try_element_at(parts, F.lit(1)).try_cast("int")))
    field = lambda start, n: F.trim(F.substring("line", start, n))
    shaped = (F.length("line") >= 32) & field(27, 3).rlike("^[0-6]$") & field(30, 3).rlike(r"^\d+$") & field(1, 3).rlike(r"^\d+$")
    old_parts = F.array(*(field(s, n) for s, n in ((1, 3), (4, 3), (7, 3), (10, 3), (13, 3), (16, 11))))
    yy = field(1, 3).try_cast("int")
    year = yy + F.coalesce(F.floor(F.year("first") / 100) * 100, F.when(yy >= 80, 1900).otherwise(2000)).cast("int")
    moment = F.when(new, modern).when(shaped, _moment(old_parts, year))
    return rows.withColumn("moment", moment).where("moment is not null").groupBy("path").agg(F.max_by("moment", "at").alias("last"))


def headers(ends: DataFrame) -> DataFrame:
    """One row for each file whose head holds a header: values are columns 1-60 of a line and labels 61-80, up to END OF HEADER."""
    rows = ends.where("head is not null").select("path", F.posexplode(_lines(F.col("head"))).alias("at", "line"))
    rows = rows.withColumns({"label": F.trim(F.substring("line", 61, 20)), "value": F.substring("line", 1, 60)})
    end = rows.where("label = 'END OF HEADER'").groupBy("path").agg(F.min("at").alias("end"))
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("value")))
    parts = lambda label: F.split(F.trim(pick(label)), r"\s+")
    stamp = lambda label: _moment(parts(label), F.try_element_at(parts(label), F.lit(1)).try_cast("int"))
    number = lambda k: F.try_element_at(parts("ANTENNA: DELTA H/E/N"), F.lit(k)).try_cast("double")
    kind = F.substring(pick("RINEX VERSION / TYPE"), 21, 1)
    return rows.join(end, "path").where("at <= end").groupBy("path").agg(
        F.trim(F.substring(pick("RINEX VERSION / TYPE"), 1, 9)).try_cast("double").alias("version"),
        F.when(kind == "O", "observation").when(kind.isin("N", "G", "H", "L", "E", "C", "J", "I", "S"), "navigation").otherwise(F.lower(kind)).alias("kind"),
        F.nullif(F.trim(pick("MARKER NAME")), F.lit("")).alias("marker"),
        F.trim(F.substring(pick("REC # / TYPE / VERS"), 21, 20)).alias("receiver"),
        F.trim(F.substring(pick("ANT # / TYPE"), 21, 20)).alias("antenna"),
        number(1).alias("antenna_height"), number(2).alias("east"), number(3).alias("north"),
        stamp("TIME OF FIRST OBS").alias("first"), stamp("TIME OF LAST OBS").alias("stated_last"),
        F.trim(pick("INTERVAL")).try_cast("double").alias("interval"),
    )


def _finding(code: str, rows: DataFrame, detail: Column) -> DataFrame:
    return rows.select("path", F.lit(code).alias("code"), F.lit(WARNING).alias("severity"), detail.cast("string").alias("detail"))


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False, head: int = HEAD, tail: int = TAIL) -> tuple[DataFrame, DataFrame]:
    """(sessions, findings) of a folder. sessions: path, station, marker, receiver, antenna, antenna_height, east, north, version, first, last,
    interval, navigation (sorted paths) and paired_by (day, or folder where no navigation file is of the session's days; then all are
    offered). A session's end is what its header states, else the last epoch in its tail, else null. findings: path, code, severity,
    detail, of files that can't be read or are of another kind, spans that are not known, names that state another station, and
    navigation files offered by fallback."""
    ends = ends_of_files(spark, folder, recursive, head, tail)
    hints = hints_of(F.col("path"))
    known = headers(ends).join(ends.select("path", "compression", "tail"), "path")
    known = known.withColumns({f"named_{k}": v for k, v in hints.items()})
    observed = known.where("kind = 'observation'")
    tails = observed.where("stated_last is null and compression = 'none'").select("path", "version", "first", "tail")
    observed = observed.join(last_epochs(tails), "path", "left").withColumn("last", F.coalesce("stated_last", "last")).drop("stated_last", "tail")
    navigation = known.where("kind = 'navigation'").select(F.col("path").alias("nav"), F.col("named_year").alias("year"), F.col("named_day").alias("day"))
    span = F.sequence(F.to_date("first"), F.greatest(F.to_date("first"), F.to_date(F.coalesce("last", "first"))))
    days = observed.where("first is not null").select("path", F.explode(span).alias("date")).select("path", F.year("date").alias("year"), F.dayofyear("date").alias("day"))
    undated = observed.where("first is null and named_day is not null").select("path", F.col("named_year").alias("year"), F.col("named_day").alias("day"))
    by_day = days.unionByName(undated).join(navigation, ["year", "day"]).groupBy("path").agg(F.array_sort(F.collect_set("nav")).alias("navigation"))
    every = navigation.agg(F.array_sort(F.collect_set("nav")).alias("every"))  # a folder's navigation files, one a day and system
    paired = observed.join(by_day, "path", "left").join(F.broadcast(every))
    station = F.coalesce("marker", "named_station", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    none = F.array().cast("array<string>")
    sessions = paired.select(
        "path", station.alias("station"), "marker", "named_station", "receiver", "antenna", "antenna_height", "east", "north", "version", "first", "last", "interval",
        F.coalesce("navigation", "every", none).alias("navigation"), F.when(F.col("navigation").isNotNull(), "day").when(F.size("every") > 0, "folder").alias("paired_by"),
    )
    headless = ends.join(known.select("path"), "path", "left_anti")
    found = _finding("UNREADABLE", headless, F.coalesce("problem", F.lit("no header within its first bytes")))
    found = found.unionByName(_finding("NEITHER_OBSERVATION_NOR_NAVIGATION", known.where("kind is null or kind not in ('observation', 'navigation')"), F.col("kind")))
    found = found.unionByName(_finding("SPAN_UNKNOWN", sessions.where("first is not null and last is null"), F.lit(None)))
    unlike = sessions.where("marker is not null and named_station is not null and upper(substring(marker, 1, 4)) <> named_station")
    found = found.unionByName(_finding("NAME_STATES_ANOTHER_STATION", unlike, F.concat_ws(" ", "marker", "named_station")))
    found = found.unionByName(_finding("NAVIGATION_PAIRED_BY_FALLBACK", sessions.where("paired_by = 'folder'"), F.size("navigation")))
    return sessions.drop("named_station"), found


def joined_sessions(sessions: DataFrame, gap_seconds: float = 60.0) -> DataFrame:
    """(station, part, first, last, paths in order of time, navigation): a station's files that follow each other within gap_seconds and were
    recorded one way are one session; files that overlap are too. A change of receiver, antenna, height, eccentricity, version or
    interval begins another one, as a station set up twice is two sessions. Files without a span stay alone."""
    setup = ["receiver", "antenna", "antenna_height", "east", "north", "version", "interval"]
    w = Window.partitionBy("station").orderBy(F.col("first").asc_nulls_last(), "path")
    far = F.unix_micros("first") > F.max(F.unix_micros("last")).over(w.rowsBetween(Window.unboundedPreceding, -1)) + gap_seconds * 1e6
    same = F.lag(F.struct(*setup)).over(w).eqNullSafe(F.struct(*setup))
    rows = sessions.withColumn("new", F.when(F.row_number().over(w) == 1, 1).when(F.coalesce(far, F.lit(True)) | ~same | F.col("first").isNull() | F.col("last").isNull(), 1).otherwise(0))
    parts = rows.withColumn("part", F.sum("new").over(w) - 1).groupBy("station", "part")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "path"))), lambda s: s["path"])
    return parts.agg(F.min("first").alias("first"), F.max("last").alias("last"), ordered.alias("paths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("navigation")))).alias("navigation"))


# ---- status files


def _instant(week: Column, seconds: Column) -> Column:
    """To the millisecond, as solutions print it."""
    return F.timestamp_millis(F.lit(315_964_800_000) + week.cast("long") * F.lit(604_800_000).cast("long") + F.round(seconds * 1000.0).cast("long"))


def status_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, order, line): `order` is a line's place among those of its file, whatever parts of it tasks read."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    return rows.select("path", F.struct("start", F.monotonically_increasing_id().alias("k")).alias("order"), "line")


def read_status(lines: DataFrame) -> DataFrame:
    """(path, instant, sightings array<satellite, azimuth, elevation>, slips, rejections) of each epoch, of $POS and $SAT lines as given by
    status_lines(). Sightings are of valid signals of the first frequency, slips of valid signals with the first bit of their flag,
    rejections of signals whose counter has moved to another number than zero since their last line. Of an epoch that comes again,
    as in the second pass of a combined solution, the first block counts. A line that can't be read fails with its text."""
    f = F.split(F.trim("line"), ",")
    text = lambda k: F.try_element_at(f, F.lit(k + 1))
    refuse = F.raise_error(F.concat(F.lit("malformed status line: "), F.col("line")))
    number = lambda k, kind: F.coalesce(text(k).try_cast(kind), refuse.cast(kind))
    at = _instant(number(1, "int"), number(2, "double"))
    blocks = lines.where("startswith(line, '$POS,')").select("path", "order", at.alias("instant"))
    first = blocks.groupBy("path", "instant").agg(F.min("order").alias("first"))
    again = blocks.join(first, ["path", "instant"]).where("order > first").groupBy("path", "instant").agg(F.min("order").alias("again"))
    whole = F.when(F.size(f) >= 17, F.col("line")).otherwise(refuse)
    sat = lines.where("startswith(line, '$SAT,')").withColumn("line", whole).select(
        "path", "order", at.alias("instant"), text(3).alias("satellite"), number(4, "int").alias("frequency"), F.radians(number(5, "double")).alias("azimuth"), F.radians(number(6, "double")).alias("elevation"),
        number(9, "int").alias("valid"), number(12, "int").alias("slip"), number(16, "int").alias("rejected"),
    )
    sat = sat.join(again, ["path", "instant"], "left").where("again is null or order < again")
    sat = sat.withColumn("signal", F.concat_ws("/", "satellite", "frequency"))
    before = F.coalesce(F.lag("rejected").over(Window.partitionBy("path", "signal").orderBy("order")), F.lit(0))
    moved = (F.col("rejected") != 0) & (F.col("rejected") != before)
    used = F.col("valid") == 1
    sat = sat.withColumn("moved", moved)
    listed = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("order", what)))), lambda s: s.getField("v"))
    sighting = F.struct("satellite", "azimuth", "elevation").alias("v")
    signal = F.col("signal").alias("v")
    epochs = sat.groupBy("path", "instant").agg(
        listed(used & (F.col("frequency") == 1), sighting).alias("sightings"),
        listed(used & (F.col("slip").bitwiseAND(1) == 1), signal).alias("slips"),
        listed(F.col("moved"), signal).alias("rejections"),
    )
    none = {"sightings": "array<struct<satellite string, azimuth double, elevation double>>", "slips": "array<string>", "rejections": "array<string>"}
    return first.select("path", "instant").join(epochs, ["path", "instant"], "full").select("path", "instant", *(F.coalesce(c, F.array().cast(t.replace(" string", ":string").replace(" double", ":double"))).alias(c) for c, t in none.items()))


def satellite_geometry(status: DataFrame) -> DataFrame:
    """(session, instant, satellite, azimuth, elevation), a row a sighting, as dilution_of_precision() reads it."""
    return status.select(F.col("path").alias("session"), "instant", F.explode("sightings").alias("s")).select("session", "instant", "s.*")


def epoch_quality(epochs: DataFrame, status: DataFrame, precision: DataFrame) -> DataFrame:
    """Solution epochs (session, instant, status, satellites, ratio, age) with slips, rejections and dilutions of their status file, met to the
    millisecond: of one that is not there, null lists and dilutions."""
    rounded = F.timestamp_millis(F.round(F.unix_micros("instant") / 1000.0).cast("long"))
    own = status.select(F.col("path").alias("session"), F.col("instant").alias("met"), "slips", "rejections")
    dop = precision.select("session", F.col("instant").alias("met"), "gdop", "pdop", "hdop", "vdop")
    return epochs.withColumn("met", rounded).join(own, ["session", "met"], "left").join(dop, ["session", "met"], "left").drop("met")
