"""Cross-tokenizer alignment: where tokens of two tokenizers end at the same byte, both are cut, and tokens between two cuts are linked.

An event sweep. Both tokenizers encode a document, which gives two lists of token ends. They are shipped together as rows of some
thousand events (document, offset of the first, side, ids): a token's length in bytes is a property of its id, so ends are not
shipped. Rows are repartitioned by document, sorted by offset within partitions, and streamed through a machine whose state is
the open group, running counts, a running hash and the distinct pairs linked so far in the one document it is in. Groups close
where both sides end; a document of any length is many rows. What is linked is written once, counted over the corpus as
(A id, B id) by Spark, and joined back. Counts of pairs are broadcast if they are at most BROADCAST_PAIRS, else both sides are
shuffled; rows are the same.

Texts are encoded as a space and the text. They are cut before a space that follows another character than white space: neither
vocabulary has a token that goes over such a border (checked for B when it is loaded). Workers remember a bounded number of words.

Rows: one out for each row in, null and repeated ids included. Texts that are null or empty, or whose tokens' bytes do not give
the text again, have no tokens: zeros and no groups. Repeated rows count as documents each. An empty table gives an empty result;
other columns are not read; ids keep their type.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from meridian.llm.common import by_bytes, give_back, stored
from meridian.llm.token_counts import _SAFE_CUT, _UNSAFE

#: Events of a row.
ROW_EVENTS = 8192
#: Words that a worker remembers, and the longest of them.
TABLE_LIMIT, LONGEST = 400_000, 64
#: Bytes of events worked on at once.
SLICE = 1 << 20
#: Pairs of ids whose counts are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 3_000_000
#: Pairs of a group that are spelled out; those of larger groups are counted by id.
SPELLED = 1 << 16
#: Places of a document's number in a key; offsets take the lower ones.
_DOC = 40
#: Fixed value: white space as pieces write it.
SPACE_MARK = "▁"


def _byte_level() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and what words have given so far."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        with open(byte_path, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        byte_of = _byte_level()
        bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in entries.items():
            if all(c in byte_of for c in entry):
                bytes_a[i] = bytes(byte_of[c] for c in entry)
        bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"{piece!r} goes over a border of words")
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode())
        self.bytes = (bytes_a, bytes_b)
        self.lengths = tuple(np.array([len(x) for x in own], np.int64) for own in self.bytes)
        self.kind = np.dtype("<u2") if max(len(bytes_a), len(bytes_b)) <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def code(self, pieces: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of pieces that each begin with a space, or None where bytes differ."""
        own_a, own_b = self.bytes
        coded_b = self.b.encode([p[1:] for p in pieces], num_threads=1)  # which adds the space
        alone = [self.b.piece_to_id(SPACE_MARK)]  # of a space at a text's end; the library gives nothing for an empty text
        out = []
        for piece, x, ids_b in zip(pieces, self.a.encode_batch_fast(pieces, add_special_tokens=False), coded_b, strict=True):
            data, ids_a, ids_b = piece.encode(), x.ids, ids_b if len(piece) > 1 else alone
            same = b"".join([own_a[i] for i in ids_a]) == data == b"".join([own_b[i] for i in ids_b])
            out.append((np.array(ids_a, self.kind).tobytes(), np.array(ids_b, self.kind).tobytes()) if same else None)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Packed ids of each text; nothing for those without tokens."""
        cuts = []
        for text in texts:
            if not text:
                cuts.append([])
            elif "  " in text or text[0] == " " or any(u in text for u in _UNSAFE):
                cuts.append([p[1:] for p in _SAFE_CUT.split(" " + text)])
            else:
                cuts.append(text.split(" "))
        new = list(set().union(*cuts).difference(self.words)) if cuts else []
        if len(self.words) + len(new) > TABLE_LIMIT:
            self.words.clear()
            new = list(set().union(*cuts))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.words.update(zip(part, self.code([" " + w for w in part]), strict=True))
        out = []
        for own in cuts:
            got = list(map(self.words.__getitem__, own))
            out.append((b"", b"") if None in got else (b"".join([x for x, _ in got]), b"".join([y for _, y in got])))
        for word in new:
            if len(word) > LONGEST:
                del self.words[word]
        return out


@lru_cache(maxsize=1)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


def events(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, side, start, ids): the events of both sides, A's as side 0, in rows of ROW_EVENTS; `row` tells rows of docs apart,
    and a row without tokens has one row without ids."""
    schema = StructType([docs.schema[id_col]])
    for f in StructType.fromDDL("row long, side int, start long, ids binary"):
        schema.add(f)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_path, piece_path)
        step = ROW_EVENTS * both.kind.itemsize
        try:
            for batch in batches:
                for part in by_bytes(batch):
                    at, rows, sides, starts, ids = [], [], [], [], []
                    row_ids = part.column(1).to_pylist()
                    for i, coded in enumerate(both.encode(part.column(2).to_pylist())):
                        for side, data in enumerate(coded):
                            if not data and side:
                                continue
                            start = 0
                            for k in range(0, max(len(data), 1), step):
                                own = data[k : k + step]
                                at.append(i)
                                rows.append(row_ids[i])
                                sides.append(side)
                                starts.append(start)
                                ids.append(own)
                                if k + step < len(data):
                                    start += int(both.lengths[side][np.frombuffer(own, both.kind)].sum())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at, pa.int64())), pa.array(rows, pa.int64()), pa.array(sides, pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                        schema=arrow,
                    )
        finally:
            both.words.clear()
            give_back()

    return docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(text_col)).mapInArrow(run, schema)


def _counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if times is None:
        keys = np.sort(keys)
        firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[firsts], np.diff(firsts, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(times, firsts) if len(keys) else times


_NOTHING = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2


class _Open:
    """The document that the machine is in."""

    def __init__(self, row: int):
        self.row = row
        self.rest = _NOTHING  # ends and ids of the open group
        self.numbers = np.zeros(4, np.int64)  # A tokens, B tokens, groups, links
        self.sum, self.text = hashlib.sha256(), []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add_pairs(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append((keys, times))
        if len(self.pairs) > 1 and sum(len(k) for k, _ in self.pairs[1:]) > len(self.pairs[0][0]):
            self.pairs = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _counted(np.concatenate([k for k, _ in self.pairs]), np.concatenate([t for _, t in self.pairs]))


class Machine:
    """Takes slices of sorted event rows and gives a result for each document that has ended."""

    def __init__(self, both: Tokenizers, texts: bool):
        self.both, self.texts, self.open, self.done = both, texts, None, []
        self.sizes = [len(x) for x in both.lengths]
        #: Ids with what stands before them: A's first of a document, of a group, others; B's first of a group, others.
        self.spelled = [f"{mark}{i}" for mark, n in (("", 0), (";", 0), (",", 0), ("|", 1), (",", 1)) for i in range(self.sizes[n])]

    def feed(self, part: pa.RecordBatch) -> None:
        rows = np.asarray(part.column("row"))
        change = np.concatenate(([True], rows[1:] != rows[:-1]))
        own = [_Open(int(r)) for r in rows[change]]
        if self.open is not None:
            if own[0].row == self.open.row:
                own[0] = self.open
            else:
                self.end(self.open)
        number = np.cumsum(change) - 1
        sides = np.asarray(part.column("side"))
        keys, ids = [], []
        for side in (0, 1):
            mask = sides == side
            picked = part.column("ids").filter(pa.array(mask))
            ends_at = np.frombuffer(picked.buffers()[1], np.int32)[picked.offset : picked.offset + len(picked) + 1] if len(picked) else np.zeros(1, np.int32)
            data = np.frombuffer(picked.buffers()[2], np.uint8)[ends_at[0] : ends_at[-1]].tobytes() if ends_at[-1] > ends_at[0] else b""
            found = np.frombuffer(data, self.both.kind).astype(np.int64)
            each = np.diff(ends_at) // self.both.kind.itemsize
            total = np.cumsum(self.both.lengths[side][found])
            before = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(each)))[:-1]]
            base = np.asarray(part.column("start"))[mask] - before + (number[mask] << _DOC)
            rest_ends, rest_ids = own[0].rest[side]
            keys.append(np.concatenate((rest_ends, total + np.repeat(base, each))))
            ids.append(np.concatenate((rest_ids, found)))
        own[0].rest = _NOTHING
        self._sweep(own, keys, ids)
        for one in own[:-1]:
            self.end(one)
        self.open = own[-1]

    def _sweep(self, own: list[_Open], keys: list[np.ndarray], ids: list[np.ndarray]) -> None:
        a, b = ids
        both = np.sort(np.concatenate(keys), kind="stable")  # two sorted runs
        cuts = both[1:][both[1:] == both[:-1]]
        last = [np.searchsorted(k, cuts) for k in keys]
        n_a, n_b = (np.diff(x, prepend=-1) for x in last)
        start_a, start_b = last[0] + 1 - n_a, last[1] + 1 - n_b
        doc = cuts >> _DOC
        rest = []  # the open group of the last document
        for side in (0, 1):
            after = int(last[side][-1]) + 1 if len(cuts) else 0
            rest.append((keys[side][after:] & ((1 << _DOC) - 1), ids[side][after:]))
        own[-1].rest = rest
        if not len(cuts):
            return
        n_docs = len(own)
        numbers = np.stack([np.bincount(doc, w, n_docs).astype(np.int64) for w in (n_a, n_b, None, n_a * n_b)], axis=1)
        # what the groups say, in order: A's ids, then B's
        total_a, total_b = int(last[0][-1]) + 1, int(last[1][-1]) + 1
        group_a, group_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
        size_a, size_b = self.sizes
        first_of_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
        first_of_doc[0] = not own[0].numbers[2] or doc[0] != 0
        mark_a = np.full(total_a, 2)
        mark_a[start_a] = np.where(first_of_doc, 0, 1)
        mark_b = np.full(total_b, 3 * size_a + size_b)
        mark_b[start_b] = 3 * size_a
        codes = np.empty(total_a + total_b, np.int64)
        codes[np.arange(total_a) + start_b[group_a]] = a[:total_a] + mark_a * size_a
        codes[np.arange(total_b) + last[0][group_b] + 1] = b[:total_b] + mark_b
        said = list(map(self.spelled.__getitem__, codes.tolist()))
        # links: groups of one token a side, small groups, large ones
        single = (n_a == 1) & (n_b == 1)
        large = n_a * n_b > SPELLED
        small = np.flatnonzero(~single & ~large)
        pair = lambda d, i, j: (d * size_a + i) * size_b + j
        each = n_a[small] * n_b[small]
        group = np.repeat(small, each)
        k = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        found = [pair(doc[single], a[last[0][single]], b[last[1][single]]), pair(doc[group], a[start_a[group] + k // n_b[group]], b[start_b[group] + k % n_b[group]])]
        pairs, times = _counted(np.concatenate(found))
        for g in np.flatnonzero(large):
            (ids_a, times_a), (ids_b, times_b) = _counted(a[start_a[g] : last[0][g] + 1]), _counted(b[start_b[g] : last[1][g] + 1])
            for i, t in zip(ids_a.tolist(), times_a.tolist(), strict=True):
                own[int(doc[g])].add_pairs(i * size_b + ids_b, t * times_b)
        bounds = np.searchsorted(pairs, np.arange(n_docs + 1) * (size_a * size_b))
        ends = np.cumsum(numbers[:, 0] + numbers[:, 1])
        at = 0
        for i, one in enumerate(own):
            one.numbers += numbers[i]
            if numbers[i, 2]:
                text = "".join(said[at : ends[i]])
                one.sum.update(text.encode())
                if self.texts:
                    one.text.append(text)
                one.add_pairs(pairs[bounds[i] : bounds[i + 1]] - i * size_a * size_b, times[bounds[i] : bounds[i + 1]])
            at = ends[i]

    def end(self, one: _Open) -> None:
        if any(len(ends) for ends, _ in one.rest):
            raise ValueError("tokens of both sides must end together at the end of a text")
        self.done.append(one)

    def given(self, schema: pa.Schema) -> pa.RecordBatch:
        """What has ended, as a batch."""
        done, self.done = self.done, []
        size_b = self.sizes[1]
        merged = [one.merged() for one in done]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(k) for k, _ in merged]))).astype(np.int32))
        flat = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in merged)])
        times = np.concatenate([np.zeros(0, np.int64), *(t for _, t in merged)])
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((flat // size_b, pa.int32()), (flat % size_b, pa.int32()), (times, pa.int64()))]
        numbers = np.stack([one.numbers for one in done]) if done else np.zeros((0, 4), np.int64)
        says = [("".join(one.text) if self.texts else one.sum.hexdigest()) if one.numbers[2] else "" for one in done]
        columns = [pa.array([one.row for one in done], pa.int64()), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(says, pa.string()), *lists]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sweep(found: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", texts: bool = False) -> DataFrame:
    """(id, row, n_a, n_b, n_groups, n_links, groups, a, b, times) of each document in events(): its groups as
    `a1,a2|b1;a3|b2,b3` or, unless `texts`, as the SHA-256 of that; the distinct pairs that are linked, and how often each is."""
    schema = StructType.fromDDL("row long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<long>")
    arrow = to_arrow_schema(schema)
    whole = StructType([found.schema[id_col], *schema])
    whole_arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(tokenizers(byte_path, piece_path), texts)
        ids: dict[int, object] = {}

        def given() -> pa.RecordBatch:
            out = machine.given(arrow)
            own = pa.array([ids.pop(r) for r in out.column(0).to_pylist()], whole_arrow.field(0).type)
            return pa.RecordBatch.from_arrays([own, *out.columns], schema=whole_arrow)

        for batch in batches:
            for part in by_bytes(batch, SLICE):
                if part.num_rows:
                    ids.update(zip(part.column("row").to_pylist(), part.column(0).to_pylist(), strict=True))
                    machine.feed(part)
                    yield given()
        if machine.open is not None:
            machine.end(machine.open)
            yield given()

    return found.repartition("row").sortWithinPartitions("row", "start", "side").mapInArrow(run, whole)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents each pair is linked, and whether no pair of its A id is in more."""
    pairs = swept.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("count"))
    pairs = stored(pairs)
    most = pairs.groupBy(F.col("a").alias("_a")).agg(F.max("count").alias("most"))
    return pairs.join(most, F.col("a") == F.col("_a")).select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document; groups as sweep() has them. A pair's count is
    the number of documents that hold it linked; n_best counts links whose pair is the most frequent of its A id,
    count_sum sums the counts over all links."""
    swept = stored(sweep(events(docs, byte_path, piece_path, id_col, text_col), byte_path, piece_path, id_col, texts))
    counts = stored(pair_counts(swept))
    links = swept.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.*")
    known = F.broadcast(counts) if counts.count() <= broadcast else counts
    sums = links.join(known, ["a", "b"]).groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return swept.join(sums, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
