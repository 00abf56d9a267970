"""Personal data: rules find emails, addresses, cards and phones; bootstrapping from these finds identifiers that no rule knows.

Every match of a rule is a seed. A seed, and any other word with a digit or an @, is an instance that stands in lexical patterns:
the two words before it, the two after it, and one on each side. The distinct (pattern, instance) pairs of the corpus
are a graph that Spark scores in rounds, as Snowball does: a pattern's confidence is the mean belief in its instances, a pattern
is accepted with a confidence of CONFIDENCE from a support of SUPPORT, and the belief in an instance that is no seed
is 1 - prod(1 - confidence) over its accepted patterns. What is believed in strengthens further patterns, until a round accepts no
more. Words in places where accepted patterns expect identifiers become spans of the kind `identifier`.

Texts are read once and in linear time; what is kept of them is their spans and the surroundings of words with digits, so the rest
runs on a table that is small beside the texts. Beliefs are joined by pattern and by instance, with partial sums before
every shuffle; nothing is collected or broadcast.

Rows: one out for each row in, null and repeated ids included; null text is empty and has no spans. Offsets are code points. Copies
of a text add no pairs, so they do not sway scores. Context words count by at most WORD characters, with digits as 0, and
instances over LONG characters by their MD5. Empty tables give empty tables; other columns are not read; ids keep their type.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meridian.llm.common import by_bytes, discard, give_back, stored

#: Kinds in order; the last is what the method adds.
KINDS = ("email", "ip", "card", "phone", "identifier")
#: Confidence and number of believed instances that a pattern needs, and rounds at most.
CONFIDENCE, SUPPORT, ROUNDS = 0.8, 3.0, 8
#: Characters of an instance at least, of one that is kept as it is, of a context word.
SHORT, LONG, WORD = 5, 64, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# possessive, and from the start of a run of digits only: else a long run would take quadratic time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGE = " \t\n\r\f\v.,;:!?\"'()[]{}<>|*#$%&=`"
_DIGITS = str.maketrans("123456789", "000000000")
_DOUBLED = str.maketrans("0123456789", "0246813579")  # twice a digit, with the digits of that added


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, as only there an address can be: what may stand before it, back to the last match."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    own = digits[-1::-2] + digits[-2::-2].translate(_DOUBLED)
    return sum(map(int, own)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _neighbours(text: str, start: int, end: int) -> list[str]:
    """The patterns of a place: words before it, after it, and on both sides."""
    room = 3 * WORD
    before = ["^", "^", *(w[-WORD:] for w in text[max(0, start - room) : start].split())]
    after = [*(w[:WORD] for w in text[end : end + room].split()), "$", "$"]
    before, after = ([w.lower().translate(_DIGITS) for w in x] for x in (before[-2:], after[:2]))
    return [f"{before[0]} {before[1]} _", f"_ {after[0]} {after[1]}", f"{before[1]} _ {after[0]}"]


def instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, instance, seed): the base spans, and words with a digit or an @ that meet none."""
    for start, _, end in base:
        yield start, end, text[start:end], True
    starts = [s for s, _, _ in base]
    reach, far = [], 0  # the furthest end of the spans up to each
    for _, _, e in base:
        far = max(far, e)
        reach.append(far)
    k = 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        word = text[start:end]
        start, end = start + len(word) - len(word.lstrip(_EDGE)), end - len(word) + len(word.rstrip(_EDGE))
        while k < len(starts) and starts[k] < end:
            k += 1
        if end - start >= SHORT and not (k and reach[k - 1] > start) and any(c in "0123456789@" for c in text[start:end]):
            yield start, end, text[start:end], False


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, base, found) of each row: base spans, and the places of instances with their patterns."""
    schema = StructType([docs.schema[id_col]])
    added = "row long, base array<struct<start long, kind int, end long>>, found array<struct<start long, end long, instance string, seed boolean, patterns array<string>>>"
    for f in StructType.fromDDL(added):
        schema.add(f)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                spans, places = [], []
                for text in part.column(2).to_pylist():
                    own = base_spans(text) if text else []
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                    places.append(
                        [
                            {"start": s, "end": e, "instance": x if len(x) <= LONG else hashlib.md5(x.encode()).hexdigest(), "seed": seed, "patterns": _neighbours(text, s, e)}
                            for s, e, x, seed in (instances(text, own) if text else ())
                        ]
                    )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int64()), pa.array(spans, arrow.field(2).type), pa.array(places, arrow.field(3).type)], schema=arrow)
        give_back()

    return docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(text_col)).mapInArrow(run, schema)


def graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, belief): the distinct pairs of occurrences(); a seed is believed in."""
    places = found.select(F.explode("found").alias("f"))
    pairs = places.select(F.explode("f.patterns").alias("pattern"), F.col("f.instance").alias("instance"), F.col("f.seed").alias("seed"))
    return pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).select("pattern", "instance", "seed", F.col("seed").cast("double").alias("belief"))


def accepted_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, confidence) of the patterns that the current beliefs support."""
    scored = edges.groupBy("pattern").agg(F.sum("belief").alias("support"), F.count(F.lit(1)).alias("n"))
    return scored.where(F.col("support") >= SUPPORT).select("pattern", (F.col("support") / F.col("n")).alias("confidence")).where(F.col("confidence") >= CONFIDENCE)


def bootstrap(found: DataFrame) -> DataFrame:
    """(pattern, confidence) of the patterns accepted in the end. Patterns of fewer than SUPPORT instances can never be accepted and go
    first."""
    pairs = graph(found)
    wide = pairs.groupBy(F.col("pattern").alias("_pattern")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    edges = stored(pairs.join(wide, F.col("pattern") == F.col("_pattern"), "left_semi"))
    accepted = stored(accepted_patterns(edges))
    n = accepted.count()
    for _ in range(ROUNDS):
        if not n:
            break
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.99))))
        told = edges.where("NOT seed").join(accepted, "pattern").groupBy(F.col("instance").alias("_instance")).agg((1 - F.exp(doubt)).alias("told"))
        belief = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("told", F.lit(0.0))).alias("belief")
        renewed = stored(edges.join(told, F.col("instance") == F.col("_instance"), "left").select("pattern", "instance", "seed", belief))
        discard(edges, accepted)
        edges, accepted = renewed, stored(accepted_patterns(renewed))
        if (now := accepted.count()) <= n:
            break
        n = now
    discard(edges)
    return accepted


def _equal_to(value: int):
    return lambda x: x == value


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans): counts of base spans, base and all spans as arrays of (start, kind, end), by
    start and kind; kinds are places in KINDS."""
    found = stored(occurrences(docs, id_col, text_col))
    patterns = bootstrap(found)
    places = found.select("row", F.explode("found").alias("f")).where("NOT f.seed").select("row", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    new = places.join(patterns, "pattern", "left_semi").distinct()  # a place may be expected by several patterns
    new = new.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("new"))
    empty = F.array().cast("array<struct<start bigint, kind int, end bigint>>")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equal_to(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.join(new, "row", "left").select(id_col, *counts, "base", F.array_sort(F.concat("base", F.coalesce("new", empty))).alias("spans"))


def written(spans: str):
    """Spans as `kind:start:end`, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
