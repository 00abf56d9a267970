"""Products by day against the rules written out."""

from datetime import date, datetime

from meridian.operators import products


def sp3(first, count, step=900):
    return f"#cP{first.year} {first.month:2} {first.day:2} {first.hour:2} {first.minute:2} {first.second:11.8f} {count:7} ORBIT IGS14 HLM  IGS\n## 2086 345600.00000000 {step:14.8f} 58849 0.0000000000000\n"


def test_names_and_spans(spark):
    files = [
        ("/p/igs23470.sp3", ""), ("/p/igr23471.sp3.gz", ""), ("/p/IGS0OPSFIN_20250030000_01D_15M_ORB.SP3.gz", ""), ("/p/IGS0OPSRAP_20250040000_01D_15M_ORB.SP3", ""),
        ("/p/brdc0050.25n", ""), ("/p/brdc0050.25g.gz", ""), ("/p/com23472.sp3", sp3(datetime(2024, 12, 31), 192)), ("/p/half.sp3", sp3(datetime(2025, 1, 1), 48)), ("/p/bad.sp3", "no header"), ("/p/notes.txt", "x"),
    ]
    covered = products.coverage(spark.createDataFrame([(p, h.encode()) for p, h in files], "path string, head binary"))
    got = sorted((r.path[3:], r.kind, r.latency, r.day, r.found_by) for r in covered.collect())
    assert got == sorted([
        ("igs23470.sp3", "orbit", "final", date(2024, 12, 29), "name"), ("igr23471.sp3.gz", "orbit", "rapid", date(2024, 12, 30), "name"),
        ("IGS0OPSFIN_20250030000_01D_15M_ORB.SP3.gz", "orbit", "final", date(2025, 1, 3), "name"), ("IGS0OPSRAP_20250040000_01D_15M_ORB.SP3", "orbit", "rapid", date(2025, 1, 4), "name"),
        ("brdc0050.25n", "gps_navigation", "broadcast", date(2025, 1, 5), "name"), ("brdc0050.25g.gz", "glonass_navigation", "broadcast", date(2025, 1, 5), "name"),
        ("com23472.sp3", "orbit", None, date(2024, 12, 31), "span"), ("com23472.sp3", "orbit", None, date(2025, 1, 1), "span"),
    ], key=lambda r: (r[0], r[1], str(r[2]), r[3]))


def test_requests_and_resolution(spark):
    sessions = [("a", datetime(2025, 1, 1, 22), datetime(2025, 1, 3, 1), []), ("a", datetime(2025, 1, 2), None, []), ("b", datetime(2025, 1, 1), None, ["own"]), ("b", None, None, [])]
    rows = spark.createDataFrame(sessions, "campaign string, first timestamp, last timestamp, navigation array<string>")
    asked = products.needed(rows, precise=True, glonass=True)
    got = {(r.campaign, r.kind, r.day.day, r.latency) for r in asked.collect()}
    assert got == {("a", k, d, "final" if k == "orbit" else "broadcast") for k in ("orbit", "gps_navigation", "glonass_navigation") for d in (1, 2, 3)} | {("b", "orbit", 1, "final")}
    assert products.needed(rows, precise=False).where("campaign = 'b'").count() == 0
    covered = [
        ("z-final", "orbit", "final", 1, "name"), ("a-span", "orbit", None, 1, "span"), ("rapid", "orbit", "rapid", 2, "name"), ("rapid2", "orbit", "rapid", 1, "name"),
        ("nav", "gps_navigation", "broadcast", 3, "name"), ("glo", "glonass_navigation", "broadcast", 9, "name"),
    ]
    table = spark.createDataFrame([(p, k, latency, date(2025, 1, d), how) for p, k, latency, d, how in covered], "path string, kind string, latency string, day date, found_by string")
    for fallback in (False, True):
        out = products.resolve(asked, table, fallback)
        found = {(r.campaign, r.kind, r.day.day): (r.path, r.used) for r in out["resolved"].collect()}
        want = {("a", "orbit", 1): ("z-final", "final"), ("b", "orbit", 1): ("z-final", "final"), ("a", "gps_navigation", 3): ("nav", "broadcast")}
        want |= {("a", "orbit", 2): ("rapid", "rapid")} if fallback else {}
        assert found == want
        assert {(r.campaign, r.day.day, r.used) for r in out["substituted"].collect()} == ({("a", 2, "rapid")} if fallback else set())
        assert {(r.campaign, r.kind, r.day.day) for r in out["missing"].collect()} == {(c, k, d) for c, k, d, _ in got} - set(want)
    less = products.resolve(asked, table.where("path <> 'z-final'"))["resolved"].where("kind = 'orbit'").collect()
    assert {(r.path, r.used, r.found_by) for r in less} == {("a-span", "final", "span")}
