"""Sessions and status files against sequential readers."""

import gzip
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meridian.operators import gnss
from meridian.sources import sessions

FIRST = datetime(2024, 3, 1, 23, 0, 0)


def header(kind="O", version="3.04", marker="ABCD", last=None, first=FIRST, height="1.5000", interval="30.000"):
    line = lambda value, label: f"{value:<60}{label}"
    stamp = lambda t: "  ".join(["", *(f"{x:4d}" for x in (t.year, t.month, t.day, t.hour, t.minute)), f"{t.second:11.7f}", "GPS"])
    out = [line(f"{version:>9}{'':11}{kind:<20}M", "RINEX VERSION / TYPE")]
    if kind == "O":
        out += [line(marker, "MARKER NAME"), line(f"{'1':<20}{'RX 9':<20}v", "REC # / TYPE / VERS"), line(f"{'2':<20}{'ANT 1':<20}", "ANT # / TYPE"), line(f"{height:>14}{'0.0000':>14}{'0.0000':>14}", "ANTENNA: DELTA H/E/N"), line(f"{interval:>10}", "INTERVAL")]
        out += [line(stamp(first), "TIME OF FIRST OBS")] if first else []
        out += [line(stamp(last), "TIME OF LAST OBS")] if last else []
    return "\n".join([*out, line("", "END OF HEADER")]) + "\n"


def modern(n, first=FIRST):
    return "".join(f"> {t.year} {t.month:02} {t.day:02} {t.hour:02} {t.minute:02} {t.second + 0.0:10.7f}  0 12\nG01  22222222.222\n" for t in (first + timedelta(seconds=30 * k) for k in range(n)))


def old(n, first=FIRST):
    return "".join(f" {t.year % 100:02} {t.month:2} {t.day:2} {t.hour:2} {t.minute:2}{t.second:11.7f}  0  2G01G02\n  22222222.222\n" for t in (first + timedelta(seconds=30 * k) for k in range(n)))


@pytest.fixture
def folder(tmp_path):
    put = lambda name, text: (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    put("ABCD00XXX_R_20240612300_02H_30S_MO.rnx", header() + modern(5000))  # several times the head
    put("wxyz061a.24o", header(version="2.11", marker="WXYZ") + old(300) + "                            4  1\nspliced" + " " * 53 + "COMMENT\n")
    put("efgh061b.24o", header(version="2.11", marker="OTHER", last=FIRST + timedelta(hours=1)))
    put("ijkl061b.24o.gz", gzip.compress((header(marker="IJKL") + modern(9)).encode()))
    put("late1230.24o", header(marker="LATE", first=datetime(2024, 5, 2)) + modern(3, datetime(2024, 5, 2)))
    put("brdc0610.24n", header("N"))
    put("brdc0620.24n", header("N"))
    put("met0610.24m", header("M"))
    put("broken.rnx", b"\x00\xff nothing")
    put("bad.gz", b"no gzip")
    put("arc.zip", b"PK")
    put("notes.txt", "not looked at")
    return str(tmp_path)


def test_scan_of_a_folder(spark, folder):
    found, findings = sessions.scan_folder(spark, folder, head=20_000, tail=4096)
    got = {r.path.rpartition("/")[2]: r for r in found.collect()}
    assert set(got) == {"ABCD00XXX_R_20240612300_02H_30S_MO.rnx", "wxyz061a.24o", "efgh061b.24o", "ijkl061b.24o.gz", "late1230.24o"}
    long = got["ABCD00XXX_R_20240612300_02H_30S_MO.rnx"]
    assert (long.station, long.receiver, long.antenna, long.antenna_height, long.interval, long.version) == ("ABCD", "RX 9", "ANT 1", 1.5, 30.0, 3.04)
    assert long.first == FIRST and long.last == FIRST + timedelta(seconds=30 * 4999)
    assert [p.rpartition("/")[2] for p in long.navigation] == ["brdc0610.24n", "brdc0620.24n"] and long.paired_by == "day"
    assert got["wxyz061a.24o"].last == FIRST + timedelta(seconds=30 * 299) and got["efgh061b.24o"].last == FIRST + timedelta(hours=1)
    assert got["ijkl061b.24o.gz"].last is None and got["late1230.24o"].paired_by == "folder" and len(got["late1230.24o"].navigation) == 2
    codes = sorted((r.code, r.path.rpartition("/")[2]) for r in findings.collect())
    assert codes == sorted([
        ("UNREADABLE", "broken.rnx"), ("UNREADABLE", "bad.gz"), ("UNREADABLE", "arc.zip"), ("NEITHER_OBSERVATION_NOR_NAVIGATION", "met0610.24m"),
        ("SPAN_UNKNOWN", "ijkl061b.24o.gz"), ("NAME_STATES_ANOTHER_STATION", "efgh061b.24o"), ("NAVIGATION_PAIRED_BY_FALLBACK", "late1230.24o"),
    ])
    with pytest.raises(Exception, match="is not a folder"):
        sessions.scan_folder(spark, folder + "/notes.txt")[0].collect()


def test_only_ends_are_read(spark, folder):
    rows = {r.path.rpartition("/")[2]: r for r in sessions.ends_of_files(spark, folder, head=100, tail=50).collect()}
    long = rows["ABCD00XXX_R_20240612300_02H_30S_MO.rnx"]
    assert len(long.head) == 100 and len(long.tail) == 50 and long.size > 200_000 and rows["bad.gz"].problem


def test_joined_sessions(spark, tmp_path):
    hour = timedelta(hours=1)
    for k, (gap, height) in enumerate([(0, "1.5000"), (1, "1.5000"), (2, "1.5000"), (3, "1.6000"), (9, "1.6000")]):
        first = FIRST + gap * hour
        (tmp_path / f"abcd061{k}.24o").write_text(header(first=first, last=first + hour - timedelta(seconds=30), height=height))
    found, _ = sessions.scan_folder(spark, str(tmp_path))
    got = {r.part: [p[-6 - 6 :] for p in r.paths] for r in sessions.joined_sessions(found).collect()}
    assert {k: len(v) for k, v in got.items()} == {0: 3, 1: 1, 2: 1} and got[0] == sorted(got[0])


def status_text(seed):
    r, rows, count = random.Random(seed), [], {}
    for passing in (1, -1):
        for k in range(0, 40)[::passing]:
            rows.append(f"$POS,2300,{100 + k * 0.5:.3f},1,1.0,2.0,3.0,0,0,0")
            rows.append("$VELACC,x")
            for s in range(8):
                for frequency in (1, 2):
                    signal = f"G{s:02}/{frequency}"
                    count[signal] = count.get(signal, 0) + (r.random() < 0.1)
                    if r.random() < 0.02:
                        count[signal] = 0
                    rows.append(f"$SAT,2300,{100 + k * 0.5:.3f},G{s:02},{frequency},{r.uniform(0, 360):.1f},{r.uniform(5, 89):.1f},0.1,0.01,{int(r.random() < 0.9)},40,1,{r.choice([0, 0, 0, 1, 2, 3])},5,0,1,{count[signal]},0,0")
    return "\n".join(rows) + "\n"


def sequential(text):
    epochs, counters, repeated = {}, {}, False
    for line in text.splitlines():
        f = line.split(",")
        if f[0] == "$POS":
            repeated = f[2] in epochs
            epochs.setdefault(f[2], ([], [], []))
        elif f[0] == "$SAT" and not repeated:
            signal, rejected = f"{f[3]}/{f[4]}", int(f[16])
            e = epochs[f[2]]
            if f[4] == "1" and f[9] == "1":
                e[0].append((f[3], math.radians(float(f[5])), math.radians(float(f[6]))))
            if f[9] == "1" and int(f[12]) & 1:
                e[1].append(signal)
            if rejected not in (0, counters.get(signal, 0)):
                e[2].append(signal)
            counters[signal] = rejected
    return {datetime(1980, 1, 6) + timedelta(weeks=2300, seconds=float(t)): v for t, v in epochs.items()}


def test_status_files_in_pieces(spark, tmp_path):
    texts = {f"{k}.stat": status_text(k) for k in range(2)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # a file is many tasks
    try:
        lines = sessions.status_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = {(r.path.rpartition("/")[2], r.instant): ([tuple(s) for s in r.sightings], r.slips, r.rejections) for r in sessions.read_status(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = {(name, t): v for name, text in texts.items() for t, v in sequential(text).items()}
    assert got.keys() == want.keys()
    for key, (sightings, slips, rejections) in want.items():
        assert got[key][1:] == (slips, rejections)
        assert [s[0] for s in got[key][0]] == [s[0] for s in sightings]
        assert [x for s in got[key][0] for x in s[1:]] == pytest.approx([x for s in sightings for x in s[1:]])
    assert any(v[2] for v in want.values()) and any(v[1] for v in want.values())
    (tmp_path / "bad.stat").write_text("$SAT,2300,1.0,G01\n")
    with pytest.raises(Exception, match="malformed status line"):
        sessions.read_status(sessions.status_lines(spark, f"{tmp_path}/bad.stat")).collect()


def test_epoch_quality(spark, tmp_path):
    (tmp_path / "a.stat").write_text(status_text(5))
    status = sessions.read_status(sessions.status_lines(spark, f"{tmp_path}/a.stat"))
    path = status.first().path
    base = datetime(1980, 1, 6) + timedelta(weeks=2300)
    rows = [(path, base + timedelta(seconds=100.5, microseconds=300), "fix", 8, 3.0, 0.0), (path, base + timedelta(seconds=5), "float", 5, 1.0, 0.0)]
    epochs = spark.createDataFrame(rows, "session string, instant timestamp, status string, satellites int, ratio double, age double")
    precision = gnss.dilution_of_precision(sessions.satellite_geometry(status))
    got = {r.status: r for r in sessions.epoch_quality(epochs, status, precision).collect()}
    want = sequential(status_text(5))[base + timedelta(seconds=100.5)]
    assert (got["fix"].slips, got["fix"].rejections) == want[1:] and got["fix"].gdop > 0
    assert got["float"].slips is None and got["float"].gdop is None
    assert precision.where(F.col("pdop") > F.col("gdop")).count() == 0
