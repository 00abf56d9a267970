"""Benchmark decontamination over a distributed positional inverted index.

All documents' words go into an index that is written once: for each term and slice of documents (SLICE_BYTES of text) one
list of the positions at which the slice has the term. The index is partitioned by term. A benchmark item is a set
of windows of consecutive words; the terms of a window are put in order from the rarest of the whole corpus
on. Of the index, only the lists of benchmark terms are read again. They meet slice by slice: the list of a
window's rarest term, shifted by the term's offset, gives the starts that are possible, and each further term leaves
those at which its own shifted list agrees, until what is left is an exact phrase. A proximity match needs
all terms of a window within some words of its rarest term, in any order.

Windows are broadcast, at most WINDOWS of them at once; more are worked through group by group. Terms are 64-bit hashes
of their words: two of N terms are taken for one with probability N^2 / 2^65.

Rows: null text has no words; an item without words has no window; repeated item_ids count as one item. Benchmark rows
without an item_id are searched like all others; together they are one item, null, which stands last in `items`
(op10's n_items counts it once, and its items_sha256, over the ids that are there, leaves it out). Rows
of documents that repeat an id are kept, one row out for each row in; empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm import shingles
from meridian.llm.common import WORD_TABLE, by_bytes, column_bytes, discard, stored

#: Bytes of text of a slice of documents, and benchmark windows that are broadcast at once.
SLICE_BYTES, WINDOWS = 2 << 20, 200_000


def _lists(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, where each one's list begins, and all lists of ascending positions, one after the other."""
    bits = max(1, int(at[-1]).bit_length()) if len(at) else 1
    low = np.uint64((1 << bits) - 1)
    both = np.sort((hashes & ~low) | at.astype(np.uint64))  # one sort of numbers: by the upper bits, then by position
    position = (both & low).astype(np.int64)
    whole = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.uint64)
    whole[at] = hashes
    terms = whole[position]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(both)), bool), both[1:] & ~low != both[:-1] & ~low)))
    if (terms != np.repeat(terms[first], np.diff(np.append(first, len(terms))))).any():  # two terms with the same upper bits
        order = np.lexsort((position, terms))
        terms, position = terms[order], position[order]
        first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    return terms[first], first, position


def _packed(first: np.ndarray, position: np.ndarray) -> pa.Array:
    """Each list as bytes: its first position in four, then the steps to the next ones in two each, or in four where one is long."""
    sizes = np.diff(np.append(first, len(position)))
    steps = np.diff(position, prepend=0)
    steps[first] = 0
    wide = np.maximum.reduceat(steps, first) > 0xFFFF if len(first) else np.zeros(0, bool)
    width = np.where(wide, 4, 2)
    offsets = np.concatenate(([0], np.cumsum(4 + (sizes - 1) * width))).astype(np.int32)
    out = np.zeros(int(offsets[-1]), np.uint8)
    head = position[first].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(offsets[:-1, None] + np.arange(4)).ravel()] = head.ravel()
    inside = np.arange(len(position)) - np.repeat(first, sizes)  # places in the lists
    for w, kind in ((2, "<u2"), (4, "<u4")):
        own = (np.repeat(width, sizes) == w) & (inside > 0)
        at = (np.repeat(offsets[:-1], sizes) + 4 + (inside - 1) * w)[own]
        out[(at[:, None] + np.arange(w)).ravel()] = steps[own].astype(kind).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The positions of a list of n."""
    head = np.frombuffer(data, "<u4", 1).astype(np.int64)
    return head if n == 1 else np.cumsum(np.concatenate((head, np.frombuffer(data, "<u2" if len(data) == 2 + 2 * n else "<u4", offset=4).astype(np.int64))))


def positional_index(docs: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """The index of all documents: rows of documents (slice, doc, first position, words n, hash of the text, id; no term) and of
    lists (slice, term, n, positions). The documents of a slice stand one position apart, so that no phrase goes across."""
    id_type = docs.schema[id_col].dataType.simpleString() if id_col else "void"
    names = ["slice", "doc", "first", "n", "twin", "id", "term", "positions"]

    def run(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in by_bytes(batch, SLICE_BYTES):
                hashes, counts = shingles.words(column_bytes(part.column(0)), WORD_TABLE)
                m, ids = len(counts), part.column(2)
                at = np.arange(len(hashes)) + np.repeat(np.arange(m), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, k)), pa.array(np.arange(m, dtype=np.int32)), pa.array((np.cumsum(counts) - counts + np.arange(m)).astype(np.int32)), pa.array(counts.astype(np.int32)), part.column(1), ids, pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=names)
                if len(hashes):
                    terms, first, position = _lists(hashes, at)
                    t = len(terms)
                    none = pa.nulls(t, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(t, k)), none, none, pa.array(np.diff(np.append(first, len(position))).astype(np.int32)), pa.nulls(t, pa.int64()), pa.nulls(t, ids.type), pa.array(terms.view(np.int64)), _packed(first, position)], names=names)
                k += 1

    asked = F.col(id_col) if id_col else F.lit(None).cast("boolean")
    schema = f"slice long, doc int, first int, n int, twin long, id {id_type if id_col else 'boolean'}, term long, positions binary"
    rows = docs.select(text_col, F.xxhash64(text_col), asked).mapInArrow(run, schema)
    by_term = F.coalesce("term", "slice")
    return rows.repartition(by_term).sortWithinPartitions("term", "slice")


def benchmark_windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(item, window, terms array<long>) of all windows of the items."""
    schema = pa.schema([("item", pa.string()), ("window", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                hashes, counts = shingles.words(column_bytes(part.column(1)), WORD_TABLE)
                own, items, first = [], [], 0
                for item, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    for i in range(first, first + max(1, n - size + 1) if n else first):
                        own.append(hashes[i : min(i + size, first + n)])
                        items.append(item)
                    first += n
                names = [int.from_bytes(hashlib.blake2b(w.tobytes(), digest_size=8).digest(), "little", signed=True) for w in own]
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(names, pa.int64()), pa.array([w.view(np.int64) for w in own], pa.list_(pa.int64()))], schema=schema)

    rows = benchmark.select(F.col(item_col).cast("string"), text_col).mapInArrow(run, "item string, window long, terms array<long>")
    return rows.dropDuplicates(["item", "window"])


class Sought:
    """Windows with their terms from the rarest on, as arrays: window, words, and (windows, words) of terms and offsets."""

    def __init__(self, rows: list):
        self.window = np.array([r.window for r in rows], np.int64)
        self.words = np.array([len(r.terms) for r in rows], np.int64)
        wide = int(self.words.max(initial=0))
        self.term, self.offset = np.zeros((len(rows), wide), np.int64), np.zeros((len(rows), wide), np.int64)
        for i, r in enumerate(rows):
            self.term[i, : len(r.terms)] = [t.term for t in r.terms]
            self.offset[i, : len(r.terms)] = [t.offset for t in r.terms]
        order = np.argsort(self.term[:, 0], kind="stable") if len(rows) else np.zeros(0, np.int64)
        self.window, self.words, self.term, self.offset = self.window[order], self.words[order], self.term[order], self.offset[order]


class Lists:
    """A slice's lists of some terms, as one sorted array of (term, position)."""

    def __init__(self, terms: np.ndarray, lists: list[np.ndarray]):
        order = np.argsort(terms)
        self.terms = terms[order]
        self.sizes = np.array([len(lists[i]) for i in order.tolist()], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.position = np.concatenate([lists[i] for i in order.tolist()]) if len(order) else np.zeros(0, np.int64)
        self.keys = np.repeat(np.arange(len(order)), self.sizes) << 32 | self.position
        self.last = int(self.position.max(initial=0))
        self.at = np.full(self.last + 2, -1, np.int64)  # which of the terms stands at a position
        self.at[self.position] = np.repeat(np.arange(len(order)), self.sizes)

    def place(self, terms: np.ndarray) -> np.ndarray:
        """The terms' numbers in this slice, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def rarest(self, sought: Sought) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose terms the slice has, by position of their rarest term: (window, position), and the terms' numbers."""
        number = self.place(sought.term)
        has = np.arange(number.shape[1]) < sought.words[:, None]
        whole = np.flatnonzero(((number >= 0) | ~has).all(1)) if len(number) else np.zeros(0, np.int64)
        sizes = self.sizes[number[whole, 0]] if len(whole) else np.zeros(0, np.int64)
        row = np.repeat(whole, sizes)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return row, self.position[np.repeat(self.first[number[whole, 0]], sizes) + inside] if len(whole) else inside, number

    def phrases(self, sought: Sought) -> tuple[np.ndarray, np.ndarray]:
        """(window's row, start) of exact phrases: the rarest terms' lists, shifted, of which each further term leaves what agrees."""
        row, position, number = self.rarest(sought)
        start = position - sought.offset[row, 0]
        row, start = row[start >= 0], start[start >= 0]
        for k in range(1, sought.term.shape[1]):
            there = start + sought.offset[row, k]
            good = (sought.words[row] <= k) | (self.at[np.minimum(there, self.last + 1)] == number[row, k])
            row, start = row[good], start[good]
        return row, start

    def near(self, sought: Sought, within: int, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's row, position of its rarest term) where all its terms stand within so many words, in the same document, whose
        words begin at `first` and end before `end`."""
        row, position, number = self.rarest(sought)
        for k in range(1, sought.term.shape[1]):
            doc = np.searchsorted(first, position, side="right") - 1
            low, high = np.maximum(position - within, first[doc]), np.minimum(position + within, end[doc] - 1)
            base = np.maximum(number[row, k], 0) << 32
            good = (sought.words[row] <= k) | (np.searchsorted(self.keys, base + low) < np.searchsorted(self.keys, base + high, side="right"))
            row, position = row[good], position[good]
        return row, position


HITS = "slice long, doc int, window long, start int, words int"
_HITS = pa.schema([("slice", pa.int64()), ("doc", pa.int32()), ("window", pa.int64()), ("start", pa.int32()), ("words", pa.int32())])


def _slice_hits(t: pa.Table, sought: Sought, within: int | None) -> pa.Table:
    """Exact hits of one slice; and where `within` is given, proximity matches, as hits of no words, one for a document and window."""
    slice_of = t["slice"][0].as_py()
    is_doc = t["term"].is_null()
    docs = t.filter(is_doc).sort_by("first")
    rows = t.filter(t["term"].is_valid())
    first, n = docs["first"].to_numpy().astype(np.int64), docs["n"].to_numpy().astype(np.int64)
    number = docs["doc"].to_numpy()
    lists = Lists(rows["term"].to_numpy(), [unpacked(x, k) for x, k in zip(rows["positions"].to_pylist(), rows["n"].to_pylist(), strict=True)])
    found = []
    row, start = lists.phrases(sought)
    doc = np.searchsorted(first, start, side="right") - 1
    found.append((number[doc], sought.window[row], start - first[doc], sought.words[row]))
    if within is not None:
        row, position = lists.near(sought, within, first, first + n)
        doc = np.searchsorted(first, position, side="right") - 1
        both = np.unique(np.stack((doc, row), 1), axis=0)
        found.append((number[both[:, 0]], sought.window[both[:, 1]], np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)))
    doc, window, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.Table.from_arrays([pa.array(np.full(len(doc), slice_of)), pa.array(doc.astype(np.int32)), pa.array(window), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], schema=_HITS)


def _searcher(sent, within: int | None):
    return lambda t: _slice_hits(t, sent.value, within)


def search(index: DataFrame, windows: DataFrame, within: int | None = None) -> DataFrame:
    """HITS rows of all windows (window, terms) over the index; with `within`, proximity matches as hits of no words too."""
    spark = index.sparkSession
    terms = stored(windows.dropDuplicates(["window"]).select("window", F.posexplode("terms").alias("offset", "term")))
    lists = index.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi")
    frequency = lists.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("f"))
    # a window with a term that no document has occurs nowhere
    placed = terms.join(frequency, "term", "left").groupBy("window").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "offset", "term"))).alias("terms"))
    wanted = stored(placed.where("terms[0].f > 0"))
    count = wanted.count()
    parts = []
    groups = -(-count // WINDOWS)
    for k in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("window"), F.lit(groups)) == k) if groups > 1 else wanted
        rows = own.collect()  # WINDOWS rows, about
        sent = spark.sparkContext.broadcast(Sought(rows))
        asked = own.select(F.explode("terms.term").alias("term")).distinct()
        use = index.where("term is null").unionByName(index.where("term is not null").join(asked, "term", "left_semi"))
        parts.append(stored(use.groupBy("slice").applyInArrow(_searcher(sent, within), HITS)))
    if not parts:
        return spark.createDataFrame([], HITS)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _spans(hits: DataFrame) -> DataFrame:
    """(slice, doc, n_hit, hit_spans): the words inside any hit, as runs."""
    by_start = Window.partitionBy("slice", "doc").orderBy("start", "words")
    end = F.col("start") + F.col("words")
    before = F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.where("words > 0").withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by_start)).groupBy("slice", "doc", "run").agg(F.min("start").cast("long").alias("start"), F.max(end).cast("long").alias("end"))
    span = F.struct("start", (F.col("end") - F.col("start")).alias("words"))
    return runs.groupBy("slice", "doc").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(span)).alias("hit_spans"))


def _items(hits: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """(slice, doc, items): of each document with a hit; null stands last."""
    pairs = hits.select("slice", "doc", "window").distinct().join(windows.select("window", "item"), "window").select("slice", "doc", "item").distinct()
    own = F.array_sort(F.collect_list(F.struct(F.col("item").isNull().alias("no"), F.coalesce("item", F.lit("")).alias("item"))))
    return pairs.groupBy("slice", "doc").agg(F.transform(own, lambda x: F.when(~x["no"], x["item"])).alias(name))


def _with_rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("twin"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no window of the benchmark. Texts are told by 64-bit hashes."""
    index = stored(positional_index(docs, text_col))
    hits = search(index, stored(benchmark_windows(benchmark, size, item_col, item_text_col)))
    gone = stored(index.where("term is null").select("slice", "doc", "twin").join(hits.select("slice", "doc").distinct(), ["slice", "doc"]).select("twin").distinct())
    discard(index)
    kept = _with_rows(docs, text_col).join(gone, "twin", "left_anti")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, within: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items array<string>, hit_spans array<struct<start, words>>, near array<string>) of every document; `near`
    has the items with a proximity match, and is empty unless `within` is given."""
    index = stored(positional_index(docs, text_col, id_col))
    windows = stored(benchmark_windows(benchmark, size, item_col, item_text_col))
    hits = search(index, windows, within)
    rows = stored(index.where("term is null").select("slice", "doc", F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words")))
    discard(index)
    exact = hits.where("words > 0")
    own = rows.join(_spans(exact), ["slice", "doc"], "left").join(_items(exact, windows, "items"), ["slice", "doc"], "left").join(_items(hits.where("words = 0"), windows, "near"), ["slice", "doc"], "left")
    names, spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:long,words:long>>")
    return own.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", names).alias("items"), F.coalesce("hit_spans", spans).alias("hit_spans"), F.coalesce("near", names).alias("near"))


def proximity(docs: DataFrame, terms: list[list[str]], within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, query): documents in which all words of a list stand within `within` words of the list's rarest one; `query` is the
    list's place in `terms`."""
    spark = docs.sparkSession
    lists = [shingles.words([" ".join(dict.fromkeys(own)).encode("utf-8")], WORD_TABLE)[0].view(np.int64).tolist() for own in terms]
    windows = spark.createDataFrame([(k, own) for k, own in enumerate(lists) if own], "window long, terms array<long>")
    index = stored(positional_index(docs, text_col, id_col))
    hits = search(index, stored(windows), within).where("words = 0").select("slice", "doc", F.col("window").cast("int").alias("query"))
    rows = index.where("term is null").select("slice", "doc", F.col("id").alias(id_col))
    return rows.join(hits, ["slice", "doc"]).select(id_col, "query")
