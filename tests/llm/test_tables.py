"""Search and archives against brute force, the registered queries, and the pipeline."""

import hashlib
import io
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import queries, topk_search, warc
from meridian.llm.common import stored

SF = "/root/testdata/sf0.001"


def brute_top(rows, k=5, step=50):
    vectors = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in vectors.items():
        if q % step == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_topk_search(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8) * r.choice([0.1, 1.0, 3.0])]) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(200)]  # one very common vector
    rows += [(1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1050, [0.0] * 8), (1100, [2.0] * 5), (1004, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "score": F.lit(2.0)}).repartition(4)
    is_query = F.col("id") % 50 == 0
    assert sorted(tuple(x) for x in topk_search.top_k(table, is_query).collect()) == brute_top(rows)
    assert topk_search.top_k(table.limit(0), is_query).collect() == []
    few = table.where("vec_id in (0, 1, 2)")
    assert sorted(tuple(x) for x in topk_search.top_k(few, is_query).collect()) == brute_top([x for x in rows if x[0] in (0, 1, 2)])


def test_topk_of_large_components(spark):
    rows = [(0, [3e15, 1.0]), (1, [3e15, -1.0]), (2, [0.001, 2.0])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, (1 << 63) - 1), (2, 256 * 512)]


@pytest.mark.parametrize("big", [1e130, 1e160, 1.7e308, -1e300])
def test_topk_of_huge_components(spark, big):
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [1.0, 2.0]), (3, [-big, 5.0]), (4, [0.0, 3.0]), (50, [0.25, 1e-300]), (51, [-1e-9, 1e150])]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=6).collect()
    low, high = -(1 << 63), (1 << 63) - 1
    whole = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        scored = sorted((-min(max(sum(x * y for x, y in zip(whole[q], b)), low), high), i) for i, b in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(x) for x in got) == sorted(want)


PAGES = [(i, f"http://h/{i % 7}", f"<p>{i % 5}</p>" * 200) for i in range(40)] + [
    (40, None, "short"),
    (41, "http://h/é\r\nX: y", "short"),
    (42, "u", None),
    (43, "u", ""),
    (44, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
    (45, "u", "é" * 500000),
    (None, "u", "<p>1</p>" * 200),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = sorted((tuple(x) for x in warc.round_trip(pages).collect()), key=lambda x: (x[0] is None, x[0]))
    largest = {}
    for i, _, h in PAGES:
        largest[h] = max(largest.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and largest[h] != (-1 if i is None else i)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[h] if revisit else None))
    assert got == sorted(want, key=lambda x: (x[0] is None, x[0]))
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_normaliser_gives_every_record_its_member():
    import gzip
    import zlib

    records = [warc.record(i, f"http://h/{i}", b"x" * (i * 700001), hashlib.sha1(b"x" * (i * 700001)).hexdigest(), None, False) for i in range(4)]
    whole = gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))
    sink = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(whole), sink))
    data = sink.getvalue()
    assert [zlib.decompress(data[o : o + n], 31) for _, o, n in index] == records and sum(n for _, _, n in index) == len(data)
    with pytest.raises((EOFError, zlib.error)):
        list(warc.normalise(io.BytesIO(whole[:-40]), io.BytesIO()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    want = sorted((tuple(str(dict(zip([c[0] for c in cursor.description], r))[c]) for c in columns) for r in cursor.fetchall()))
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    norm = lambda v: str(v)
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


def test_every_query_returns_its_whole_table(spark):
    sizes = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "embeddings", "pages")}
    for name, fn in queries.queries().items():
        n = fn(spark, SF).count()
        assert n == (5 * -(-sizes["embeddings"] // 50) if name.startswith("op4") else sizes["pages" if name.startswith("op7") else "documents"]), name


def test_pipeline(spark):
    from test_text_operators import brute_components, brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        docs = stored(stage(spark, docs, SF))
        after = {r.doc_id: r.asDict() for r in docs.collect()}
        rows[name] = len(after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "language_id":
            assert {i for i, r in before.items() if not any(map(str.isalpha, r["text"] or ""))}.isdisjoint(after)
        if name == "jaccard_join":
            assert set(after) == {c for _, _, c in brute_components([(i, r["text"]) for i, r in before.items()], 5, 80)}
        if name == "suffix_dedup":
            seen = set()
            for i in sorted(before):
                data = (before[i]["text"] or "").encode()
                gone = np.zeros(len(data) + 1, np.int64)
                for k in range(len(data) - 99):
                    w = data[k : k + 100]
                    if w in seen:
                        gone[k] += 1
                        gone[k + 100] -= 1
                    seen.add(w)
                mask = np.cumsum(gone[:-1]) > 0
                text = before[i]["text"] or ""
                at, kept = 0, []
                for c in text:
                    n = len(c.encode())
                    if not mask[at : at + n].all():
                        kept.append(c)
                    at += n
                if kept or not mask.any():
                    assert after[i]["text"] == "".join(kept) and after[i]["n_chars"] == len(kept)
                else:
                    assert i not in after
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {i for i, r in before.items() if not brute_hits(r["text"], items)[1]}
        if name == "byte_bpe":
            assert all(after[i]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for i, r in before.items())
    assert corpus_pipeline.run(spark, SF).count() == rows["byte_bpe"]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, ties, empty and very long texts, and columns named as the stages name their own."""
    words = [f"word{k}" for k in range(400)]
    base = " ".join(words[:120])
    long = " ".join(words[(k * 7919 + k // 400) % 400] for k in range(20_000)) + " " + "x" * 3_000_000
    texts = [(1, base), (2, base), (2, base), (3, base + " tail"), (None, base), (4, None), (None, None), (5, ""), (6, "1234 !!"), (7, "tiny text"), (8, long), (9, " ".join(words[200:330])), (10, "benchmark passage " + " ".join(words[150:165]))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shingle string, node int, label int, row string, twin int, spans string, t string, slice string, term string"
    rows = [(i, t, "aa" if k % 2 else "bb", "s", len(t or ""), "x", 1, 2, "r", 3, "sp", "t", "sl", "te") for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([("i", " ".join(words[150:165])), (None, "tiny text"), ("n", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = []
    for name in ("language_id", "jaccard_join", "suffix_dedup", "decontamination"):
        docs = stored(stages[name](spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept.append(sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()))
    ids = lambda *own, null=0: [(False, i) for i in own] + [(True, 0)] * null
    assert kept[0] == ids(1, 2, 2, 3, 7, 8, 9, 10, null=1)
    assert kept[1] == ids(1, 7, 8, 9, 10, null=1)
    assert kept[2] == ids(1, 7, 8, 9, 10)  # the row without an id repeats what stands before
    assert kept[3] == ids(1, 8, 9)
    coded = stages["byte_bpe"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in coded} == {1, 8, 9} and all(r.n_tokens == len(r.ids) for r in coded)
    none = docs.limit(0)
    for stage in stages.values():
        assert stage(spark, none, str(tmp_path)).collect() == []
