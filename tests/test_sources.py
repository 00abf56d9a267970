"""Readers on small files written here."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from meridian.sources import mapping, readers
from meridian.streaming import alerts


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{path}"


FIELDS = {
    "station": mapping.Field("st"),
    "target": mapping.Field("to"),
    "set": mapping.Field(constant="1"),
    "face": mapping.Field("pos", values={"PD": "D", "PI": "R"}),
    "horizontal": mapping.Field("hz", kind="angle"),
    "distance": mapping.Field("d", kind="number", unit="millimetre"),
    "instrument_height": mapping.Field("hi", kind="number"),
}


def test_field_book(spark, tmp_path):
    path = write(tmp_path, "b.csv", "st,to,pos,hz,d,hi\nA,B,PD,10-20-30,1500,1.5\nA,B,PI,190-20-40,\"1501,5\",1.6\nA,B,PD,11-00-00,1,1.5\nB,C,PD,bad,2,\nC,D,PD,1-2-3,3,\n")
    good, findings = readers.read_field_book(readers.read_csv_rows(spark, path), mapping.Mapping(FIELDS, ("station", "target", "horizontal")))
    rows = {(r.station, r.face): r for r in good.collect()}
    assert set(rows) == {("A", "D"), ("A", "R"), ("C", "D")}
    assert rows["A", "D"].instrument_height == 1.5 and rows["C", "D"].instrument_height == 0.0
    assert rows["A", "R"].distance == pytest.approx(1.5015) and rows["A", "D"].horizontal == pytest.approx(math.radians(10 + 20 / 60 + 30 / 3600))
    assert sorted((r.code, r.row) for r in findings.collect()) == [("NO_INSTRUMENT_HEIGHT", 6), ("REPEATED_POINTING", 4), ("SEVERAL_INSTRUMENT_HEIGHTS", 2), ("UNREADABLE_ROW", 5)]


def test_inferred_mapping():
    m = mapping.infer(["Setup", "Point", "Kind", "Reading", "Distance", "Line"])
    assert {k: f.column for k, f in m.fields.items()} == {"target": "Point", "setup": "Setup", "distance": "Distance", "reading": "Reading", "sight": "Kind", "line": "Line"}


def test_level_book(spark, tmp_path):
    path = write(tmp_path, "l.csv", "setup,point,kind,reading,distance,line\n1,A,BS,1.5,20,L\n1,B,FS,1.2,21,L\n2,B,BS,1.1,20,L\n2,C,FS,1.4,20,L\n2,D,IS,1.9,15,L\n3,E,FS,1.0,10,L\n")
    m = mapping.Mapping({"setup": mapping.Field("setup"), "station": mapping.Field("point"), "sight": mapping.Field("kind"), "reading": mapping.Field("reading", kind="number"), "distance": mapping.Field("distance", kind="number"), "line": mapping.Field("line")}, ("setup", "station", "reading"))
    setups, findings = readers.read_level_book(readers.read_csv_rows(spark, path), m)
    assert sorted((r["from"], r.to, round(r.backsight - r.foresight, 3)) for r in setups.collect()) == [("A", "B", 0.3), ("B", "C", -0.3), ("B", "D", -0.8)]
    assert [r.code for r in findings.collect()] == ["INCOMPLETE_SETUP"]


def test_gravity_files(spark, tmp_path):
    cg5 = write(tmp_path, "a.txt", "/ CG-5 SURVEY\n/ Instrument S/N: 1\n 1.0  101  12.5  4500.123  0.020  1.0  -2.0  30.1  0.050  60  0  12:30:15  737000.5  0.0  2024/03/01\n header words only\n")
    r = readers.read_cg5(spark, cg5).collect()
    assert len(r) == 1 and r[0].station == "101" and r[0].reading == pytest.approx(4500.123e-5) and r[0].tide_applied and r[0].variance == pytest.approx((0.02 / math.sqrt(60) * 1e-5) ** 2) and r[0].instant.hour == 12
    csv = write(tmp_path, "g.csv", "station,time,reading_mgal\nA,2024-01-01T00:00:00Z,1000\nB,2024-01-01T00:00:00,1001\n")
    good, bad = readers.read_gravity_csv(readers.read_csv_rows(spark, csv))
    assert [x.station for x in good.collect()] == ["A"] and [x.row for x in bad.collect()] == [3]
    assert {x.format for x in readers.detect_gravity_format(spark, cg5).collect()} == {"cg5"}


def test_pos(spark, tmp_path):
    head = "% program\n%  GPST          x-ecef(m)  y-ecef(m)  z-ecef(m)  Q ns sdx sdy sdz sdxy sdyz sdzx age ratio\n"
    path = write(tmp_path, "s.pos", head + "2024/03/01 10:00:00.000 1.5 2.5 3.5 1 8 0.1 0.2 0.3 -0.05 0.01 0.0 0.0 5.5\n2024/03/01 10:00:30.000 1.6 2.6 3.6 2 7 0.1 0.2 0.3 0.05 0.01 0.0 0.0 1.5\n")
    rows = readers.read_pos(spark, path).orderBy("instant").collect()
    assert [r.q for r in rows] == [1, 2] and rows[0].c12 == pytest.approx(-0.0025) and rows[0].v3 == pytest.approx(0.09) and rows[1].ratio == 1.5
    assert readers.baseline_from_pos(readers.read_pos(spark, path)).first().c1 == 1.6


def test_rinex_header(spark, tmp_path):
    line = lambda value, label: f"{value:<60}{label:<20}\n"
    text = line("     2.11           OBSERVATION DATA    G", "RINEX VERSION / TYPE") + line("STN1", "MARKER NAME") + line("        1.2345        0.0000        0.0000", "ANTENNA: DELTA H/E/N") + line("    30.000", "INTERVAL") + line("  2005     4     2     0     0    0.0000000     GPS", "TIME OF FIRST OBS") + line("", "END OF HEADER") + line("X", "MARKER NAME")
    r = readers.read_rinex_headers(spark, write(tmp_path, "abcd0920.05o", text)).first()
    assert (r.marker, r.height, r.interval, r["first"].year) == ("STN1", 1.2345, 30.0, 2005)
    hints = spark.range(1).select(*(c.alias(k) for k, c in readers.name_hints(F.lit("/x/abcd0920.05o")).items())).first()
    assert (hints.station, hints.day, hints.year) == ("ABCD", 92, 2005)


def test_grids_and_interpolation(spark, tmp_path):
    asc = write(tmp_path, "g.asc", "ncols 3\nnrows 2\nxllcorner 10\nyllcorner 50\ncellsize 1\nNODATA_value -9999\n4 5 6\n1 2 -9999\n")
    cells = readers.read_esri_ascii(spark, asc)
    assert sorted((r.row, r.column, r.value) for r in cells.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)] and {(r.south, r.west, r.dlat) for r in cells.collect()} == {(50.0, 10.0, 1.0)}
    other = write(tmp_path, "h.asc", "ncols 1\nnrows 3\nxllcenter 20\nyllcenter 60\ncellsize 2\n7\n8\n-9999\n")  # no no-data value, another height
    two = readers.read_esri_ascii(spark, [asc, other]).where("path like '%h.asc'").collect()
    assert sorted((r.row, r.value, r.south, r.dlon) for r in two) == [(0, -9999.0, 60.0, 2.0), (1, 8.0, 60.0, 2.0), (2, 7.0, 60.0, 2.0)]
    points = spark.createDataFrame([("a", 50.5, 10.5), ("b", 50.0, 10.0), ("c", 50.5, 11.5), ("d", 60.0, 10.0)], "p string, latitude double, longitude double")
    got = {r.p: r.undulation for r in readers.undulations(points, cells, 50.0, 10.0, 1.0, 1.0).collect()}
    assert got == {"a": pytest.approx(3.0), "b": 1.0, "c": None, "d": None}
    gtx = write(tmp_path, "g.gtx", struct.pack(">4d2i4f", 50.0, 10.0, 1.0, 1.0, 2, 2, 1.0, 2.0, -88.8888, 5.0))
    cells = readers.read_gtx(spark, gtx)
    assert sorted((r.row, r.column, round(r.value, 3)) for r in cells.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 5.0)] and cells.first().south == 50.0
    more = write(tmp_path, "i.gtx", struct.pack(">4d2i1f", 70.0, 11.0, 1.0, 1.0, 1, 1, 9.0))
    assert {(r.south, r.value) for r in readers.read_gtx(spark, [gtx, more]).where("value > 8").collect()} == {(70.0, 9.0)}


def test_sectioned_and_counted_text(spark, tmp_path):
    path = write(tmp_path, "n.dat", "# title\n[Coordinates]\nA 1 2 # note\n\n[Distances]\nA B 10.5\n")
    assert [(r.section, list(r.f)) for r in readers.read_sections(spark, path).orderBy("line_number").collect()] == [("Coordinates", ["A", "1", "2"]), ("Distances", ["A", "B", "10.5"])]
    adjust = write(tmp_path, "a.txt", "title\n1 1 0 1 1\nA 0 0 0.01 0.01\nB 10 0\nA B 10.0 0.002\nA B A 90 30 00 5\n")
    stations, rows = readers.read_adjust(spark, adjust)
    assert {r.station: r.control for r in stations.collect()} == {"A": True, "B": False}
    more = write(tmp_path, "b.txt", "title\n2 0 0 0 3\nC 0 0\nD 1 1\nE 2 2\nC D 1.4 0.01\nD E 1.4 0.01\n")
    several = readers.read_adjust(spark, [adjust, more])
    assert (several[0].count(), several[1].count()) == (5, 4) and {r.station for r in several[0].where("control").collect()} == {"A"}
    angle = rows.where("type = 'HORIZONTAL_ANGLE'").first()
    assert angle.value == pytest.approx(math.radians(90.5)) and angle.sigma == pytest.approx(math.radians(5 / 3600))
    with pytest.raises(ValueError):
        readers.read_adjust(spark, write(tmp_path, "bad.txt", "title\n2 0 0 1 1\nA 0 0 1 1\nB 1 1\nA B 10.0 0.002\n"))


def test_small_readers(spark, tmp_path):
    xyz = readers.read_coordinates(spark, write(tmp_path, "c.csv", "name,e,n,h\nA,1,2,3\nA,4,5,6\nB,7,8,\n"))
    assert {r.name: (r.x, r.z) for r in xyz.collect()} == {"A": (4.0, 6.0), "B": (7.0, None)}
    dna = readers.read_dna_stations(spark, write(tmp_path, "s.stn", "!#=DNA\n" + f"{'P1':<20}{'CCC':<4}{'XYZ':<3}{1.5:>20}{2.5:>20}{3.5:>20}\n"))
    assert (dna.first().station, dna.first().constraint, dna.first().c3) == ("P1", "CCC", 3.5)
    xml = write(tmp_path, "s.xml", "<DnaXmlFormat><DnaStation><Name>Q</Name><Constraints>FFF</Constraints><Type>LLH</Type><StationCoord><Name>Q</Name><XAxis>1.5</XAxis><YAxis>2.5</YAxis><Height>3.5</Height></StationCoord></DnaStation></DnaXmlFormat>")
    assert readers.read_dynaml_stations(spark, xml).first().c2 == 2.5
    assert {r.key: r.value for r in readers.parse_config(spark, write(tmp_path, "c.conf", "a = 1 # x\n# b=2\nc=d=e\n")).collect()} == {"a": "1", "c": "d=e"}
    good, bad = readers.thresholds(readers.read_csv_rows(spark, write(tmp_path, "t.csv", "kind,limit,stations,group\nMagnitude,0.5,A;B,\nspeed,1,,\nvertical,x,,\n")))
    assert [list(r.stations) for r in good.collect()] == [["A", "B"]] and bad.count() == 2


def test_stream_of_displacements(spark, tmp_path):
    rows = spark.createDataFrame([("A", "2024-01-01 00:10:00", 0.5), ("A", "2024-01-01 00:20:00", 2.0), ("B", "2024-01-01 00:30:00", 0.5), ("A", "2024-01-01 03:00:00", 0.1)], "station string, t string, magnitude double").select("station", F.to_timestamp("t").alias("instant"), "magnitude")
    path = f"file://{tmp_path}/in"
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    q = alerts.windowed_alerts(stream, 1.0).writeStream.format("memory").queryName("alerts_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from alerts_out").collect()
    assert [(r.station, r.readings, r.largest) for r in got] == [("A", 2, 2.0)]
