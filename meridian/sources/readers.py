"""Readers of survey files as DataFrames. Files are many and small, or rows are independent: lines are read by Spark, and
columns are cut out of them natively. Where an order of lines matters, a whole file is one row that is split with its positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridian.functions.units import printed_sigma
from meridian.sources.mapping import Mapping


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_number from 1, line) of text files, a file at a time."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_number"), "line")


def fields_of(rows: DataFrame) -> DataFrame:
    """Adds `f`, the line's fields between white space."""
    return rows.withColumn("f", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))


def read_csv_rows(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """A CSV file's rows as text columns, with the number of the line in the file as `row`."""
    rows = lines_of(spark, path).where(F.trim("line") != "")
    header = rows.where("line_number = 1").select("line").first()
    names = [h.strip().strip('"').lstrip("﻿") for h in header.line.split(separator)]
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = rows.where("line_number > 1").select(F.col("line_number").alias("row"), F.from_csv("line", schema, {"sep": separator}).alias("r"))
    return parsed.select("row", "r.*")


def read_field_book(rows: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """Pointings of a total station, the first of a face and set, with the setup's instrument height: the smallest where several were
    recorded, 0 where none was, each with a finding."""
    good, findings = mapping.apply(rows)
    w = Window.partitionBy("station", "target", "set", "face").orderBy("row")
    good = good.withColumn("nth", F.row_number().over(w))
    again = good.where("nth > 1").select("row", F.lit("REPEATED_POINTING").alias("code"), F.lit("WARNING").alias("severity"), F.array(F.lit("face")).alias("fields"))
    heights = good.groupBy("station").agg(F.min("row").alias("row"), F.min("instrument_height").alias("height"), F.countDistinct("instrument_height").alias("n"))
    odd = heights.where("n <> 1").select("row", F.when(F.col("n") > 1, "SEVERAL_INSTRUMENT_HEIGHTS").otherwise("NO_INSTRUMENT_HEIGHT").alias("code"), F.lit("WARNING").alias("severity"), F.array(F.lit("instrument_height")).alias("fields"))
    kept = good.where("nth = 1").drop("nth", "instrument_height").join(heights.select("station", F.coalesce("height", F.lit(0.0)).alias("instrument_height")), "station")
    return kept, findings.unionByName(again).unionByName(odd)


def read_level_book(rows: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """Setups of a level book with a row a reading (sight BS, FS or IS): setup, line, seq, backsight station and reading, and a row for each
    foresight. A setup without exactly one backsight and a foresight is a finding and left out."""
    good, findings = mapping.apply(rows)
    good = good.withColumn("sight", F.upper("sight"))
    if "line" not in good.columns:
        good = good.withColumn("line", F.lit("1"))
    counts = good.groupBy("line", "setup").agg(F.count_if(F.col("sight") == "BS").alias("back"), F.count_if(F.col("sight").isin("FS", "IS")).alias("fore"), F.min("row").alias("row"))
    bad = counts.where("back <> 1 or fore < 1").select("row", F.lit("INCOMPLETE_SETUP").alias("code"), F.lit("BLOCKING").alias("severity"), F.array(F.lit("sight")).alias("fields"))
    valid = counts.where("back = 1 and fore >= 1").select("line", "setup", F.col("row").alias("seq"))
    own = good.join(valid, ["line", "setup"])
    back = own.where("sight = 'BS'").select("line", "setup", "seq", F.col("station").alias("from"), F.col("reading").alias("backsight"), F.col("distance").alias("backsight_distance"))
    fore = own.where("sight <> 'BS'").select("line", "setup", F.col("station").alias("to"), F.col("reading").alias("foresight"), F.col("distance").alias("foresight_distance"), "sight", "row")
    return back.join(fore, ["line", "setup"]), findings.unionByName(bad)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """name, x, y, z per line; a first line without numbers is a header; of a repeated name the last stays."""
    rows = lines_of(spark, path).where(F.trim("line") != "").withColumn("c", F.split("line", r"\s*,\s*"))
    number = lambda k: F.try_element_at("c", F.lit(k)).try_cast("double")
    rows = rows.select("line_number", F.trim(F.element_at("c", 1)).alias("name"), number(2).alias("x"), number(3).alias("y"), number(4).alias("z"))
    bad = rows.where("line_number > 1 and (x is null or y is null)").select("line_number").first()
    if bad:
        raise ValueError(f"line {bad.line_number} has no coordinates")
    return rows.where("x is not null").groupBy("name").agg(*(F.max_by(c, "line_number").alias(c) for c in ("x", "y", "z")))


def detect_gravity_format(spark: SparkSession, path: str) -> DataFrame:
    """(path, format): cg5, burris or csv, by content."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    first = F.lower(F.substring_index(F.trim("value"), "\n", 1))
    return whole.select("path", F.when(F.col("value").rlike(r"(?m)^/.*"), "cg5").when(first.contains(",") & first.contains("station"), "csv").otherwise("burris").alias("format"))


def read_cg5(spark: SparkSession, path: str | list[str], additive_sigma: float = 0.0, utc_offset_hours: float = 0.0) -> DataFrame:
    """Readings of 15 fields that begin with a digit: station, height, gravity and tide in m/s^2, instant, variance. The tide column was
    added by the instrument, so tide_applied is true where it is not 0."""
    rows = fields_of(lines_of(spark, path)).where((F.size("f") == 15) & F.col("line").rlike(r"^\s*\d"))
    n = lambda k: F.element_at("f", k + 1).try_cast("double")
    instant = F.try_to_timestamp(F.concat_ws(" ", F.element_at("f", 15), F.element_at("f", 12)), F.lit("yyyy/MM/dd HH:mm:ss"))
    sigma = F.hypot(n(4) / F.sqrt(F.greatest(n(9), F.lit(1.0))), F.lit(additive_sigma))
    return rows.select("path", "line_number", F.element_at("f", 2).alias("station"), n(2).alias("height"), (n(3) * 1e-5).alias("reading"), F.pow(sigma * 1e-5, 2.0).alias("variance"), (n(8) * 1e-5).alias("tide"), (F.coalesce(n(8), F.lit(0.0)) != 0).alias("tide_applied"), (instant - F.make_dt_interval(hours=F.lit(int(utc_offset_hours)), mins=F.lit(int(round(utc_offset_hours % 1 * 60))))).alias("instant"))


def read_burris(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Readings of 16 fields or more: station, instant, gravity, tide (applied where not 0), height, latitude and longitude in radians."""
    rows = fields_of(lines_of(spark, path)).where(F.size("f") >= 16)
    n = lambda k: F.element_at("f", k + 1).try_cast("double")
    date = F.regexp_replace(F.element_at("f", 4), "[-.]", "/")
    instant = F.try_to_timestamp(F.concat_ws(" ", date, F.element_at("f", 5)), F.lit("yyyy/MM/dd HH:mm:ss"))
    return rows.where(n(5).isNotNull()).select("path", "line_number", F.element_at("f", 1).alias("station"), (n(5) * 1e-5).alias("reading"), (n(8) * 1e-5).alias("tide"), (F.coalesce(n(8), F.lit(0.0)) != 0).alias("tide_applied"), n(13).alias("height"), F.radians(n(14)).alias("latitude"), F.radians(n(15)).alias("longitude"), instant.alias("instant"))


def read_gravity_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """station, time with a zone, reading_mgal; a time without a zone is a finding, as the tide depends on it."""
    zoned = F.col("time").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    typed = rows.withColumns({"instant": F.when(zoned, F.try_to_timestamp("time")), "reading": F.col("reading_mgal").try_cast("double") * 1e-5})
    good = typed.where("instant is not null and reading is not null and trim(station) <> ''")
    bad = typed.where("instant is null or reading is null or coalesce(trim(station), '') = ''")
    return good.select("row", "station", "instant", "reading"), bad.select("row", F.lit("UNREADABLE_ROW").alias("code"), F.lit("BLOCKING").alias("severity"))


def read_pos(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Epochs of GNSS solution files. The layout is told by the column header's marker (latitude, x-ecef or e-baseline); the three cross
    columns are signed roots of covariances, so covariance = sign(v) v^2. Times stay on the scale of the file."""
    rows = lines_of(spark, path)
    marker = F.max(F.when(F.col("line").startswith("%") & F.col("line").rlike(r"latitude|x-ecef|e-baseline"), F.col("line")))
    kinds = rows.groupBy("path").agg(marker.alias("header"))
    layout = F.when(F.col("header").contains("x-ecef"), "xyz").when(F.col("header").contains("e-baseline"), "enu").when(F.col("header").contains("d'"), "llh_dms").otherwise("llh")
    data = fields_of(rows.where(~F.col("line").startswith("%") & (F.trim("line") != ""))).join(kinds.select("path", layout.alias("layout")), "path")
    width = F.when(F.col("layout") == "llh_dms", 7).otherwise(3)
    n = lambda k: F.try_element_at("f", F.lit(k)).try_cast("double")
    dms = lambda k: F.signum(n(k)) * (F.abs(n(k)) + n(k + 1) / 60.0 + n(k + 2) / 3600.0)
    is_dms = F.col("layout") == "llh_dms"
    calendar = F.element_at("f", 1).contains("/")
    week = F.timestamp_micros(((315964800 + n(1) * 604800 + n(2)) * 1e6).cast("long"))
    time = F.when(calendar, F.try_to_timestamp(F.concat_ws(" ", F.element_at("f", 1), F.element_at("f", 2)), F.lit("yyyy/MM/dd HH:mm:ss.SSS"))).otherwise(week)
    at = lambda k: F.try_element_at("f", width + 2 + k).try_cast("double")
    signed = lambda k: F.signum(at(k)) * at(k) * at(k)
    out = data.select(
        "path", "line_number", "layout", time.alias("instant"),
        F.when(is_dms, dms(3)).otherwise(n(3)).alias("c1"), F.when(is_dms, dms(6)).otherwise(n(4)).alias("c2"), F.when(is_dms, n(9)).otherwise(n(5)).alias("c3"),
        at(1).cast("int").alias("q"), at(2).cast("int").alias("satellites"),
        *(F.pow(at(k), 2.0).alias(f"v{k - 2}") for k in (3, 4, 5)), *(signed(k).alias(c) for k, c in ((6, "c12"), (7, "c23"), (8, "c31"))),
        at(9).alias("age"), at(10).alias("ratio"),
    )
    return out.where(F.col("q").between(1, 6))


def baseline_from_pos(epochs: DataFrame) -> DataFrame:
    """The last epoch of each xyz file."""
    last = epochs.where("layout = 'xyz'").groupBy("path").agg(F.max_by(F.struct("instant", "c1", "c2", "c3", "q", "v1", "v2", "v3", "c12", "c23", "c31"), "instant").alias("e"))
    return last.select("path", "e.*")


def read_rinex_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row an observation file: values are columns 1-60 of a line and labels 61-80, up to END OF HEADER."""
    rows = lines_of(spark, path).withColumns({"label": F.trim(F.substring("line", 61, 20)), "value": F.substring("line", 1, 60)})
    end = rows.where("label = 'END OF HEADER'").groupBy("path").agg(F.min("line_number").alias("end"))
    head = rows.join(end, "path").where("line_number <= end")
    pick = lambda label: F.max(F.when(F.col("label") == label, F.trim("value")))
    first = F.split(pick("TIME OF FIRST OBS"), r"\s+")
    last = F.split(pick("TIME OF LAST OBS"), r"\s+")
    stamp = lambda p: F.try_make_timestamp(*(F.try_element_at(p, F.lit(k)).try_cast("int") for k in range(1, 6)), F.try_element_at(p, F.lit(6)).try_cast("decimal(16,6)"))
    delta = F.split(pick("ANTENNA: DELTA H/E/N"), r"\s+")
    return head.groupBy("path").agg(
        pick("MARKER NAME").alias("marker"), F.trim(F.substring(pick("REC # / TYPE / VERS"), 21, 20)).alias("receiver"), F.trim(F.substring(pick("ANT # / TYPE"), 21, 20)).alias("antenna"),
        F.try_element_at(delta, F.lit(1)).try_cast("double").alias("height"), stamp(first).alias("first"), stamp(last).alias("last"), pick("INTERVAL").try_cast("double").alias("interval"),
    )


def name_hints(path: Column) -> dict[str, Column]:
    """Station, day of year and year of the short file-name convention ssssdddf.yyo."""
    name = F.element_at(F.split(path, "/"), -1)
    short = r"^(\w{4})(\d{3})(\w)\.(\d{2})[a-zA-Z]"
    yy = F.regexp_extract(name, short, 4).try_cast("int")
    return {"station": F.when(name.rlike(short), F.upper(F.regexp_extract(name, short, 1))), "day": F.regexp_extract(name, short, 2).try_cast("int"), "year": F.when(yy < 80, yy + 2000).otherwise(yy + 1900)}


def read_esri_ascii(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row from the south, column, value, south, west, dlat, dlon) of grids, without their no-data cells; each file by its own header,
    whose corner is that of its first cell or that cell's centre."""
    rows = fields_of(lines_of(spark, path)).where(F.size("f") > 0)
    is_head = F.col("line").rlike(r"^\s*[A-Za-z]")
    pairs = rows.where(is_head).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.lower(F.element_at("f", 1)).alias("k"), F.element_at("f", 2).cast("double").alias("v")))).alias("h"))
    get = lambda k: F.try_element_at("h", F.lit(k))
    size = get("cellsize")
    head = pairs.select("path", get("nrows").cast("int").alias("nrows"), get("nodata_value").alias("no_data"), F.coalesce(get("yllcenter"), get("yllcorner")).alias("south"), F.coalesce(get("xllcenter"), get("xllcorner")).alias("west"), F.coalesce(get("dy"), size).alias("dlat"), F.coalesce(get("dx"), size).alias("dlon"))
    body = rows.where(~is_head).withColumn("north", F.row_number().over(Window.partitionBy("path").orderBy("line_number")))
    cells = body.join(head, "path").select("path", (F.col("nrows") - F.col("north")).alias("row"), F.posexplode("f").alias("column", "text"), "no_data", "south", "west", "dlat", "dlon")
    value = F.col("text").cast("double")
    return cells.withColumn("value", value).where(F.col("no_data").isNull() | (F.col("value") != F.col("no_data"))).select("path", "row", "column", "value", "south", "west", "dlat", "dlon")


def read_gtx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same of big-endian GTX grids, which are stored from the south; no-data is -88.8888."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                south, west, dlat, dlon = np.frombuffer(content, ">f8", 4)
                rows, columns = np.frombuffer(content, ">i4", 2, 32)
                values = np.frombuffer(content, ">f4", rows * columns, 40).astype(float)
                i, j = np.divmod(np.arange(rows * columns), columns)
                keep = np.abs(values + 88.8888) > 1e-3
                yield pd.DataFrame({"path": name, "row": i[keep], "column": j[keep], "value": values[keep], "south": south, "west": west, "dlat": dlat, "dlon": dlon})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, row int, column int, value double, south double, west double, dlat double, dlon double")


def undulations(points: DataFrame, cells: DataFrame, south: float, west: float, dlat: float, dlon: float, sigma: float = 0.05) -> DataFrame:
    """Bilinear interpolation at points (latitude, longitude in degrees) by an equi-join with the four corners of their cell. Points
    outside the grid, or beside a cell without a value, get null."""
    y, x = (F.col("latitude") - south) / dlat, (F.col("longitude") - west) / dlon
    placed = points.withColumns({"_r": F.floor(y).cast("int"), "_c": F.floor(x).cast("int"), "_y": y - F.floor(y), "_x": x - F.floor(x)})
    w = lambda i, j: (F.col("_y") if i else 1 - F.col("_y")) * (F.col("_x") if j else 1 - F.col("_x"))
    out, total = placed, F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            c = cells.select((F.col("row") - i).alias("_r"), (F.col("column") - j).alias("_c"), F.col("value").alias(f"_n{i}{j}"))
            out = out.join(c, ["_r", "_c"], "left")
            total = total + F.when(w(i, j) > 0, w(i, j) * F.col(f"_n{i}{j}")).otherwise(0.0)
    drop = ["_r", "_c", "_y", "_x", *(f"_n{i}{j}" for i in (0, 1) for j in (0, 1))]
    return out.withColumns({"undulation": total, "undulation_variance": F.lit(sigma * sigma)}).drop(*drop)


def read_sections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_number, section, f) of sectioned text such as [Coordinates]: comments begin a field with # or %; blank lines are left out."""
    rows = lines_of(spark, path).withColumn("line", F.trim(F.regexp_replace("line", r"(^|\s)[#%].*$", "")))
    name = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1))
    order = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("section", F.last(name, ignorenulls=True).over(order))
    return fields_of(inside.where((F.col("line") != "") & ~F.col("line").rlike(r"^\[.*\]$"))).select("path", "line_number", "section", "f")


def read_adjust(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(stations, observations) of *Adjust* text, each with its path: a title, five counts (distances, angles, azimuths, control stations,
    stations), stations, then rows told apart by their number of fields: 2 or 4 a distance, 3 or 7 an angle from a backsight at a
    station to a foresight. Raises for a file whose counts are not those of its rows."""
    rows = fields_of(lines_of(spark, path)).where(F.size("f") > 0)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("line_number")))
    counts = rows.where("k = 2").select("path", F.transform(F.slice("f", 1, 5), lambda x: x.cast("int")).alias("c"))
    rows = rows.join(counts, "path").withColumn("n_stations", F.col("c")[3] + F.col("c")[4])
    n = lambda k: F.try_element_at("f", F.lit(k)).try_cast("double")
    stations = rows.where((F.col("k") >= 3) & (F.col("k") <= 2 + F.col("n_stations"))).select("path", F.element_at("f", 1).alias("station"), n(2).alias("x"), n(3).alias("y"), n(4).alias("sx"), n(5).alias("sy"), (F.col("k") <= 2 + F.col("c")[3]).alias("control"))
    body = rows.where(F.col("k") > 2 + F.col("n_stations")).withColumn("size", F.size("f"))
    distance = body.where("size in (2, 4)").select("path", "line_number", F.lit("HORIZONTAL_DISTANCE").alias("type"), F.slice("f", 1, 2).alias("stations"), n(3).alias("value"), n(4).alias("sigma"))
    dms = F.signum(n(4) + 0.5) * (F.abs(n(4)) + n(5) / 60.0 + n(6) / 3600.0)
    angle = body.where("size in (3, 7)").select("path", "line_number", F.lit("HORIZONTAL_ANGLE").alias("type"), F.slice("f", 1, 3).alias("stations"), F.radians(dms).alias("value"), F.radians(n(7) / 3600.0).alias("sigma"))
    found = distance.unionByName(angle)
    got = found.groupBy("path").agg(F.count_if(F.col("type") == "HORIZONTAL_DISTANCE").alias("distances"), F.count_if(F.col("type") == "HORIZONTAL_ANGLE").alias("angles"))
    wrong = counts.join(got, "path", "left").where((F.coalesce("distances", F.lit(0)) != F.col("c")[0]) | (F.coalesce("angles", F.lit(0)) != F.col("c")[1]) | (F.col("c")[2] != 0)).limit(1).collect()
    if wrong:
        raise ValueError(f"the counts {wrong[0].c[:3]} of {wrong[0].path} are not those of its rows")
    return stations, found


def read_dna_stations(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width stations: name 1-20, constraint 21-23, type 25-27, coordinates 28-47, 48-67, 68-87."""
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    rows = lines_of(spark, path).where(~F.col("line").startswith("!") & (F.trim("line") != ""))
    return rows.select(cut(1, 20).alias("station"), cut(21, 3).alias("constraint"), cut(25, 3).alias("type"), *(cut(a, 20).try_cast("double").alias(c) for a, c in ((28, "c1"), (48, "c2"), (68, "c3"))))


def read_dynaml_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations of an XML file, by Spark's own XML source."""
    schema = "Name string, Constraints string, Type string, StationCoord struct<Name:string, XAxis:double, YAxis:double, Height:double>, Description string"
    rows = spark.read.format("xml").option("rowTag", "DnaStation").schema(schema).load(path)
    return rows.select(F.col("Name").alias("station"), F.col("Constraints").alias("constraint"), F.col("Type").alias("type"), F.col("StationCoord.XAxis").alias("c1"), F.col("StationCoord.YAxis").alias("c2"), F.col("StationCoord.Height").alias("c3"))


def parse_config(spark: SparkSession, path: str) -> DataFrame:
    """key = value lines with # comments."""
    rows = lines_of(spark, path).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains("="))
    return rows.select(F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))


def reading_variance(text: Column, factor: float = 1.0) -> Column:
    """What the printed decimals of a reading imply."""
    return F.pow(printed_sigma(text) * factor, 2.0)


def thresholds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alert thresholds (kind, limit, stations, group) from CSV rows; others are findings with their row."""
    typed = rows.withColumns({"limit": F.col("limit").try_cast("double"), "kind": F.lower(F.trim("kind")), "stations": F.when(F.trim("stations") != "", F.split(F.trim("stations"), r"[;\s]+"))})
    good = F.coalesce((F.col("limit") > 0) & F.col("kind").isin("magnitude", "horizontal", "vertical", "velocity"), F.lit(False))
    return typed.where(good), typed.where(~good).select("row", F.lit("BAD_THRESHOLD").alias("code"), F.lit("BLOCKING").alias("severity"))

