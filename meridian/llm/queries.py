"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import byte_bpe, conversation_repair, cross_tokenizer, decontamination, jaccard_join, language_id, lattice_lm, license_scan, personal_data, suffix_dedup, token_counts, topk_search, warc
from meridian.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_train = language_id.fold("doc_id", 10) != 0
    return lattice_lm.score(table(spark, sf_dir, "documents"), is_train, public_tokenizers.path("piece_bpe_32k.model"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.fold("doc_id", 4) != 2))
    held_out = (language_id.fold("doc_id", 4) == 2).alias("held_out")
    return language_id.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "bits_per_byte")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=20)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.encode(personal_data.written("base"), "UTF-8"), 256).alias("base_sha256"),
        personal_data.written("spans").alias("spans"),
    )


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return cross_tokenizer.align(table(spark, sf_dir, "documents"), *files).withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_license_scan": op2_license_scan,
        "op3_lattice_lm": op3_lattice_lm,
        "op4_topk_search": op4_topk_search,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_language_id": op6_language_id,
        "op7_warc": op7_warc,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_personal_data": op12_personal_data,
        "op13_cross_tokenizer": op13_cross_tokenizer,
    }


_OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to FROM m"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM bw) l, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
p AS (SELECT doc_id, i, w[i] AS term FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)), f AS (SELECT term, count(*) AS f FROM p GROUP BY term),
k AS (SELECT DISTINCT k, string_split(k, ' ') AS w FROM bw), wt AS (SELECT k, o, w[o] AS term FROM k, LATERAL (SELECT unnest(generate_series(1, len(w))) AS o)),
r AS (SELECT k, first(wt.term ORDER BY f, o) AS rarest, count(DISTINCT wt.term) AS kinds FROM wt LEFT JOIN f ON wt.term = f.term GROUP BY k HAVING count(*) = count(f)),
u AS (SELECT DISTINCT k, term FROM wt), g AS (SELECT p.doc_id, p.i, r.k FROM r JOIN p ON p.term = r.rarest JOIN u ON u.k = r.k JOIN p AS x ON x.doc_id = p.doc_id AND x.term = u.term AND x.i BETWEEN p.i - 20 AND p.i + 20 GROUP BY p.doc_id, p.i, r.k, r.kinds HAVING count(DISTINCT u.term) = r.kinds),
e AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT doc_id, item FROM g JOIN bw ON g.k = bw.k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN e ON d.doc_id = e.doc_id"""


_OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 3))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS least FROM documents UNION SELECT e.v, r.least FROM r JOIN e ON r.v = e.u WHERE r.least < e.v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.component_id FROM (SELECT DISTINCT doc_id FROM documents) q JOIN d ON d.doc_id = q.doc_id LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(least) AS component_id FROM r GROUP BY v) m ON m.v = d.doc_id"""


_SPACE = r"[\x20\x09-\x0D]"
_OP11 = rf"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
f AS (SELECT *, xor(list_reduce(list_transform(generate_series(1, len(k)), lambda i: CAST(unicode(k[i]) AS BIGINT)), lambda c, b: list_reduce(generate_series(1, 8), lambda x, n: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) % 20 AS fate FROM r),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || text)) AS i FROM d),
g AS (SELECT *, left(role, 1) AS q, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '(?s)([^\x20\x09-\x0D]){_SPACE}*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(s, t, c, a, x) AS (VALUES ('-','-',0,'',''),('-','u',2,'I','user:'||chr(10)),('-','a',4,'II','user:'||chr(10)||'assistant:'||chr(10)),('s','s',0,'',''),('s','u',2,'I','user:'||chr(10)),('s','a',4,'II','user:'||chr(10)||'assistant:'||chr(10)),
  ('u','u',0,'',''),('u','a',2,'I','assistant:'||chr(10)),('u','u',4,'II','assistant:'||chr(10)||'user:'||chr(10)),('a','a',0,'',''),('a','u',2,'I','user:'||chr(10)),('a','a',4,'II','user:'||chr(10)||'assistant:'||chr(10))),
nx(t, v) AS (VALUES ('-','s'),('-','u'),('s','u'),('u','a'),('a','u')),
act AS (SELECT conv_id, i, t, t AS v, 3 AS c, 'D' AS a, '' AS x FROM g, (SELECT unnest(['-', 's', 'u', 'a']) AS t)
  UNION ALL SELECT conv_id, i, t, v, CAST(fault = 'truncated' AS INTEGER), 'K', role || ':' || text || chr(10) FROM g JOIN nx ON q = v WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, t, v, 2 + CAST(fault = 'truncated' AS INTEGER), 'R', CASE v WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10) FROM g, nx WHERE v <> 's' AND fault IN ('', 'truncated')),
b AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '-' AS s, {{'c': CAST(0 AS BIGINT), 'a': '', 'x': ''}} AS m FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, s, m FROM (SELECT b.conv_id, b.i + 1 AS i, act.v AS s, min({{'c': CAST(b.m.c + ins.c + act.c AS BIGINT), 'a': b.m.a || ins.a || act.a, 'x': b.m.x || ins.x || act.x}}) AS m FROM b JOIN ins ON ins.s = b.s JOIN act ON act.conv_id IS NOT DISTINCT FROM b.conv_id AND act.i = b.i + 1 AND act.t = ins.t GROUP BY b.conv_id, b.i, act.v)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || q NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
e AS (SELECT b.conv_id, min({{'c': b.m.c + ins.c, 'a': b.m.a || ins.a, 'x': b.m.x || ins.x}}) AS m FROM b JOIN ins ON ins.s = b.s LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(n.n, 0) AND ins.t IN ('-', 'a') GROUP BY b.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(e.m.c AS BIGINT) AS cost, e.m.a AS audit, sha256(e.m.x[:-2]) AS repaired_sha256 FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id"""


def oracle_sql() -> dict[str, str]:
    """Of the queries whose results SQL can express over whole tables."""
    return {"op4_topk_search": _OP4, "op7_warc": _OP7, "op8_jaccard_join": _OP8, "op10_decontamination": _OP10, "op11_conversation_repair": _OP11}
