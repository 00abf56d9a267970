"""Exact removal of repeated byte strings by sorting sampled suffixes, from which all others are induced.

A byte goes if a string of LENGTH bytes over it also starts earlier. As induced sorting does, only a sample of the
suffixes is sorted, and what holds for the rest follows from it. The sample are anchors: of each window of
LENGTH bytes the leftmost place with the least hash of the GRAM bytes that follow. Content alone decides it,
so equal windows have their anchors at equal offsets, and a run of windows with one anchor is one suffix tuple
(gram, hash of the run's bytes, document, place). Spark sorts the tuples externally, on disk, over all
documents at once, so no shard has to fit in memory. In the sorted order

* a tuple equal to its predecessor repeats it: all windows of its run go;
* tuples with one gram and unlike runs may still share some windows. Common-prefix values carried in the
  tuples (hashes of four stretches that the run's windows have in common) tell which; only these runs are
  taken apart into single windows, which are sorted once more in the same way.

Tuples that repeat an earlier one of the same task are recognised there and only the first is compared
with the rest, so a string that very many documents share sends one tuple a task. A gram with more than half a
mean partition of tuples is dealt by gram and run, not by gram.

Rows: null text is empty; texts shorter than LENGTH keep all; null ids come last and count as one id; rows that repeat an id
are ordered by a hash of their text, and those of equal text are one document: it is searched once, and each of its rows
has its result; one row out for each row in; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridian.llm.common import by_bytes, column_bytes, stored
from meridian.llm.shingles import mix

LENGTH, GRAM = 100, 16
#: Grams in a window, and of the four stretches the windows' offsets from their anchor.
SPAN = LENGTH - GRAM + 1
PARTS, PART = 4, -(-SPAN // 4)
#: Bytes of text whose arrays are made at once; tuples that are compared in a task before they go out.
SLICE_BYTES, LOCAL = 1 << 18, 150_000
#: Candidate runs that may be broadcast; beyond that they are joined.
BROADCAST_RUNS = 2_000_000
LAST = (1 << 63) - 1
_AT = np.uint64((1 << 40) - 1)
#: Hashes are two polynomials in random bases modulo a Mersenne prime, so that no family of strings collides by its form.
PRIME = np.uint64((1 << 31) - 1)
_rng = np.random.Generator(np.random.PCG64(7))
_BASES = [int(x) for x in _rng.integers(1 << 20, 1 << 30, 2)]
_BYTES = _rng.integers(1, 1 << 31, (2, 256), dtype=np.uint64) % PRIME
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2]


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base, and of its inverse: doubled until there are enough."""
    for which, base in enumerate((_BASES[k], pow(_BASES[k], -1, int(PRIME)))):
        table = _powers[k][which]
        while len(table) < n:
            step = np.uint64(pow(base, len(table), int(PRIME)))
            table = np.concatenate((table, _modulo(table * step)))
        _powers[k][which] = table
    return _powers[k][0][:n], _powers[k][1][:n]


class Hashes:
    """Hashes of any stretches of some texts, from sums over their prefixes."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.sums, self.down = [], []
        for k in range(2):
            up, down = powers(k, len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_modulo(_BYTES[k][self.data] * up[: len(self.data)]), out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        first, second = (_modulo(_modulo(s[end] - s[start]) * d[start]) for s, d in zip(self.sums, self.down, strict=True))
        return mix(((first << np.uint64(31)) | second) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs(texts: list[bytes]) -> tuple[Hashes, dict[str, np.ndarray]]:
    """The runs of windows with one anchor: text's place, first window's start within all texts, windows,
    anchor's offset in the first, gram."""
    own = Hashes(texts)
    n = len(own.data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return own, {k: empty for k in ("text", "start", "count", "offset")} | {"gram": np.zeros(0, np.uint64)}
    at = np.arange(n - GRAM + 1)
    least = ((own.of(at, at + GRAM) >> np.uint64(40)) << np.uint64(40)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    least = np.minimum(least[: len(least) - rest], least[rest:])  # of SPAN grams from each start
    start = np.arange(len(least))
    text = np.searchsorted(own.ends, start, side="right")
    inside = own.ends[text] - start >= LENGTH
    start, text, anchor = start[inside], text[inside], (least[inside] & _AT).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))) if len(start) else empty
    count = np.diff(np.append(first, len(start)))
    start, text, anchor = start[first], text[first], anchor[first]
    return own, {"text": text, "start": start, "count": count, "offset": anchor - start, "gram": own.of(anchor, anchor + GRAM)}


def stretches(own: Hashes, r: dict[str, np.ndarray]) -> np.ndarray:
    """For each run (rows) the hash of what the windows of each quarter of the offsets have in common, or 0 where the
    run has no such window. 32 bits: they only choose what is compared in full."""
    out = np.zeros((len(r["start"]), PARTS), np.uint64)
    anchor = r["start"] + r["offset"]
    low, high = r["offset"] - r["count"] + 1, r["offset"]
    for k in range(PARTS):
        has = (high >= k * PART) & (low < (k + 1) * PART)
        # a window with its anchor at offset o covers [anchor - o, anchor - o + LENGTH)
        begin = anchor[has] - k * PART
        out[has, k] = (own.of(begin, begin + LENGTH - PART + 1) >> np.uint64(32)) | np.uint64(1)
    return out


def _pack(r: dict[str, np.ndarray], start: np.ndarray) -> np.ndarray:
    """Place, windows and anchor's offset of a run in one number that sorts by place."""
    return (start << 16) | (r["count"] << 8) | r["offset"]


TUPLE = "deal long, gram long, run long, doc long, twin long, place long, h0 long, h1 long, repeat boolean"
_TUPLE = pa.schema([(n, pa.int64()) for n in ("deal", "gram", "run", "doc", "twin", "place", "h0", "h1")] + [("repeat", pa.bool_())])


def _documents(docs: DataFrame, id_col: str, text_col: str, repeats: bool) -> DataFrame:
    twin = F.xxhash64(text_col) if repeats else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), twin.alias("twin"), F.col(text_col).alias("t"))


def _once(own: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each (doc, twin) of _documents once. Only rows of the ids `repeated` (doc) are shuffled with their texts."""
    several = stored(own.join(repeated, "doc", "left_semi").dropDuplicates(["doc", "twin"]))
    return own.join(repeated, "doc", "left_anti").unionByName(several)


def _local_repeats(cols: list[np.ndarray], keys: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by all columns, and whether the first `keys` of them are those of the row before."""
    order = np.lexsort(cols[::-1])
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in cols[:keys]:
        same[1:] &= c[order][1:] == c[order][:-1]
    return order, same


def heavy_grams(docs: DataFrame, partitions: int) -> np.ndarray:
    """Grams with more than half a mean partition of tuples: at most 2 * partitions."""

    def run(batches):
        held, size = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= 3
            # the number of all tuples goes along under no gram
            return pa.RecordBatch.from_arrays([pa.array([*values[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), int(counts.sum())], pa.int64())], names=["gram", "n"])

        for batch in batches:
            for part in by_bytes(batch, SLICE_BYTES):
                _, r = runs(column_bytes(part.column(0)))
                held.append(r["gram"])
                size += len(r["gram"])
                if size >= LOCAL:
                    yield counted()
                    held, size = [], 0
        yield counted()

    counted = stored(docs.select("t").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = next((r.n for r in counted.where("gram is null").collect()), 0)
    rows = counted.where(F.col("gram").isNotNull() & (F.col("n") * 2 * partitions > total)).select("gram").toArrow()
    return np.sort(rows["gram"].to_numpy())


def suffix_tuples(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        heavy = sent.value
        held: list[list[np.ndarray]] = []
        size = 0

        def out():
            gram, run_hash, doc, twin, place, h0, h1 = (np.concatenate(c) for c in zip(*held, strict=True))
            order, same = _local_repeats([gram, run_hash, doc, twin, place >> 16], 2)
            gram, run_hash, doc, twin, place, h0, h1 = (c[order] for c in (gram, run_hash, doc, twin, place, h0, h1))
            spread = mix(gram.view(np.uint64) ^ mix(run_hash.view(np.uint64))).view(np.int64)
            at = np.minimum(np.searchsorted(heavy, gram), max(len(heavy) - 1, 0))
            is_heavy = heavy[at] == gram if len(heavy) else np.zeros(len(gram), bool)
            deal = np.where(same, mix((doc * 31 + place).view(np.uint64)).view(np.int64), np.where(is_heavy, spread, gram))
            h0 = np.where(is_heavy, -1, h0)  # the sorted order can't tell which windows are shared: all may be
            yield from pa.Table.from_arrays([pa.array(x) for x in (deal, gram, run_hash, doc, twin, place, h0, h1, same)], schema=_TUPLE).to_batches(max_chunksize=64_000)

        for batch in batches:
            for part in by_bytes(batch, SLICE_BYTES):
                texts = column_bytes(part.column(2))
                own, r = runs(texts)
                if not len(r["start"]):
                    continue
                begins = own.ends - np.array([len(t) for t in texts])
                h = stretches(own, r)
                text = r["text"]
                held.append([r["gram"].view(np.int64), own.of(r["start"], r["start"] + r["count"] + LENGTH - 1).view(np.int64), part.column(0).to_numpy()[text], part.column(1).to_numpy()[text], _pack(r, r["start"] - begins[text]), (h[:, 0] << np.uint64(32) | h[:, 1]).view(np.int64), (h[:, 2] << np.uint64(32) | h[:, 3]).view(np.int64)])
                size += len(text)
                if size >= LOCAL:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return docs.mapInArrow(run, TUPLE)


FOUND = "doc long, twin long, start long, end long, gram long, parts int"
_FOUND = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.int64()), ("parts", pa.int32())])


def _found(t: dict[str, np.ndarray], rows: np.ndarray, parts: np.ndarray | None) -> pa.RecordBatch:
    """Spans to remove (parts null), or runs to take apart: then start is the packed place."""
    place = t["place"][rows]
    start = place >> 16 if parts is None else place
    end = (place >> 16) + ((place >> 8) & 255) + LENGTH - 1
    kinds = pa.nulls(len(rows), pa.int32()) if parts is None else pa.array(parts.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(t["doc"][rows]), pa.array(t["twin"][rows]), pa.array(start), pa.array(end), pa.array(t["gram"][rows]), kinds], schema=_FOUND)


def _shared_parts(group: np.ndarray, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Bits of the stretches that another tuple of the same group has too."""
    bits = np.zeros(len(group), np.int32)
    for k, h in enumerate((h0 >> 32, h0 & 0xFFFFFFFF, h1 >> 32, h1 & 0xFFFFFFFF)):
        h = h & 0xFFFFFFFF
        order = np.lexsort((h, group))
        g, v = group[order], h[order]
        same = (g[1:] == g[:-1]) & (v[1:] == v[:-1]) & (v[1:] != 0)
        hit = np.zeros(len(order), bool)
        hit[1:] |= same
        hit[:-1] |= same
        bits[order[hit]] |= 1 << k
    bits[h0 == -1] = (1 << PARTS) - 1
    return bits


def _scan_sorted(batches):
    """Over tuples sorted by (deal, gram, run, doc, twin, place): repeats of the run before, and firsts whose gram has
    other runs with shared stretches. A gram's firsts are held until the next gram begins, or until there are
    very many, when all of them are taken apart unseen."""
    names = ("gram", "run", "doc", "twin", "place", "h0", "h1")
    held: list[dict[str, np.ndarray]] = []
    last_gram = last_run = None

    def flush(every: bool = False):
        nonlocal held
        if not held:
            return
        t = {n: np.concatenate([h[n] for h in held]) for n in names}
        held = []
        bits = np.full(len(t["gram"]), (1 << PARTS) - 1, np.int32) if every else _shared_parts(t["gram"], t["h0"], t["h1"])
        rows = np.flatnonzero(bits)
        if len(rows):
            yield _found(t, rows, bits[rows])

    crowded = None  # a gram that was too large to hold
    for batch in batches:
        flag = batch.column("repeat").to_numpy(zero_copy_only=False)
        t = {n: batch.column(n).to_numpy() for n in names}
        if flag.any():
            yield _found(t, np.flatnonzero(flag), None)
            t = {n: v[~flag] for n, v in t.items()}
        if not len(t["gram"]):
            continue
        gram, run = t["gram"], t["run"]
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (run[1:] == run[:-1])
        same[0] = gram[0] == last_gram and run[0] == last_run
        last_gram, last_run = gram[-1], run[-1]
        if same.any():
            yield _found(t, np.flatnonzero(same), None)
        firsts = {n: v[~same] for n, v in t.items()}
        if not len(firsts["gram"]):
            continue
        gram = firsts["gram"]
        if crowded is not None and gram[0] == crowded:
            n = int(np.argmax(gram != crowded)) if (gram != crowded).any() else len(gram)
            held.append({k: v[:n] for k, v in firsts.items()})
            yield from flush(every=True)
            firsts = {k: v[n:] for k, v in firsts.items()}
            gram = firsts["gram"]
            if not len(gram):
                continue
        crowded = None
        others = np.flatnonzero(gram != gram[-1])
        begin = int(others[-1]) + 1 if len(others) else 0  # of the last gram's rows
        if begin or held and held[-1]["gram"][-1] != gram[0]:
            if begin:
                held.append({k: v[:begin] for k, v in firsts.items()})
            yield from flush()
        held.append({k: v[begin:] for k, v in firsts.items()})
        if sum(len(h["gram"]) for h in held) > 100_000:
            crowded = gram[-1]
            yield from flush(every=True)
    yield from flush()


def windows_of_runs(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The single windows of the runs to take apart, as tuples (window hash, gram, document, start)."""
    spark = docs.sparkSession
    names = ["deal", "gram", "run", "doc", "twin", "place", "h0", "h1", "repeat"]
    packed = candidates.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "parts")).alias("r"))

    def expand(batches_with_runs):
        held: list[list[np.ndarray]] = []
        size = 0

        def out():
            window, gram, doc, twin, start = (np.concatenate(c) for c in zip(*held, strict=True))
            order, same = _local_repeats([window, gram, doc, twin, start], 2)
            window, gram, doc, twin, start = (c[order] for c in (window, gram, doc, twin, start))
            deal = np.where(same, mix((doc * 31 + start).view(np.uint64)).view(np.int64), window)
            zero = np.zeros(len(window), np.int64)
            yield from pa.Table.from_arrays([pa.array(x) for x in (deal, window, gram, doc, twin, (start << 16) | (1 << 8), zero, zero, same)], names=names).to_batches(max_chunksize=64_000)

        for doc, twin, text, place, parts in batches_with_runs:
            own = Hashes([text])
            start, count, offset = place >> 16, (place >> 8) & 255, place & 255
            k = np.repeat(np.arange(len(place)), count)
            step = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
            part = (offset[k] - step) // PART
            keep = (parts[k] >> part) & 1 == 1
            k, step = k[keep], step[keep]
            begin = start[k] + step
            anchor = start[k] + offset[k]
            held.append([own.of(begin, begin + LENGTH).view(np.int64), own.of(anchor, anchor + GRAM).view(np.int64), np.full(len(k), doc), np.full(len(k), twin), begin])
            size += len(k)
            if size >= LOCAL:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    if candidates.count() <= BROADCAST_RUNS:
        t = candidates.select("doc", "twin", "start", "parts").toArrow()
        cols = [t[n].to_numpy() for n in ("doc", "twin", "start", "parts")]
        order = np.lexsort(cols[:3][::-1])
        sent = spark.sparkContext.broadcast([c[order] for c in cols])

        def local(batches):
            doc, twin, place, parts = sent.value

            def each():
                for batch in batches:
                    ids, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    lo, hi = np.searchsorted(doc, ids, side="left"), np.searchsorted(doc, ids, side="right")
                    for i in np.flatnonzero(hi > lo).tolist():
                        mine = slice(lo[i], hi[i])
                        own = np.flatnonzero(twin[mine] == twins[i]) + lo[i]
                        if len(own):
                            yield ids[i], twins[i], (batch.column(2)[i].as_py() or "").encode("utf-8"), place[own], parts[own].astype(np.int64)

            yield from expand(each())

        return docs.mapInArrow(local, TUPLE)

    def joined(batches):
        def each():
            for batch in batches:
                for r in batch.to_pylist():
                    yield r["doc"], r["twin"], (r["t"] or "").encode("utf-8"), np.array([x["start"] for x in r["r"]], np.int64), np.array([x["parts"] for x in r["r"]], np.int64)

        yield from expand(each())

    return docs.join(packed, ["doc", "twin"]).select("doc", "twin", "t", "r").mapInArrow(joined, TUPLE)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, twin, start, end) of strings that also start earlier, of documents that come once each; spans may overlap."""
    spark = docs.sparkSession
    order = ["deal", "gram", "run", "doc", "twin", "place"]
    heavy = heavy_grams(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = stored(suffix_tuples(docs, heavy).repartition("deal").sortWithinPartitions(*order).mapInArrow(_scan_sorted, FOUND))
    windows = windows_of_runs(docs, found.where("parts is not null"))
    single = windows.repartition("deal").sortWithinPartitions(*order).mapInArrow(_scan_sorted, FOUND)
    spans = found.where("parts is null").unionByName(single.where("parts is null"))
    return spans.select("doc", "twin", "start", "end")


def _removed(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes lie in any span."""
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns of the rows, as the struct `row`, with their `text` and the `spans` to remove."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"))
    repeated = stored(ids.groupBy("doc").count().where("count > 1").select("doc"))
    repeats = not repeated.isEmpty()
    own = _documents(docs, id_col, text_col, repeats)
    own = _once(own, repeated) if repeats else own
    spans = repeated_spans(own).groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), (F.xxhash64(text_col) if repeats else F.lit(0).cast("long")).alias("twin"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return keyed.join(spans, ["doc", "twin"], "left").select("row", F.col("row")[text_col].alias("text"), F.coalesce("spans", none).alias("spans"))


def _each(part: pa.RecordBatch):
    """(bytes, which of them go) of rows (.., text, spans)."""
    column = part.column(part.num_columns - 1)
    offsets, flat = column.offsets.to_numpy(), column.values
    starts, ends = flat.field("start").to_numpy(), flat.field("end").to_numpy()
    for i, data in enumerate(column_bytes(part.column(part.num_columns - 2))):
        yield data, _removed(data, starts[offsets[i] : offsets[i + 1]], ends[offsets[i] : offsets[i + 1]])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans array<struct<start, end>>, kept binary) of every whole text."""
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                sizes, removed, spans, kept = [], [], [], []
                for data, gone in _each(part):
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    sizes.append(len(data))
                    removed.append(int(gone.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edges) else data)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip((sizes, removed, spans, kept), list(schema)[1:], strict=True))], schema=schema)

    rows = _with_spans(docs, id_col, text_col).select(F.col("row")[id_col].alias("id"), "text", "spans")
    return rows.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, their texts without what repeats; of a character of several bytes
    all go or none. A text of which nothing stays is dropped, unless it was empty before."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                out, stays = [], []
                for (data, gone), was in zip(_each(part), part.column(1).is_null().to_pylist(), strict=True):
                    if gone.any():
                        raw = np.frombuffer(data, np.uint8)
                        first = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
                        whole = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(raw))))
                        data = raw[~whole].tobytes()
                    out.append(None if was else data.decode("utf-8"))
                    stays.append(bool(data) or not gone.any())
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["row", "text"])
                yield rows.filter(pa.array(stays))

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType())])
    rows = _with_spans(docs, id_col, text_col).mapInArrow(run, schema)
    return rows.select(*(F.col("text").alias(n) if n == text_col else F.col("row")[n].alias(n) for n in names))
