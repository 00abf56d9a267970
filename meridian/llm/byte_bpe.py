"""Byte-level BPE: encoding and decoding that reproduce the exact merges in linear time.

The ranks define the merges. Bytes become Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds the longest token at every start in one pass. The encoder walks from longest matches and
backs up where two adjacent tokens are not compatible: two tokens can stand side by side only if no merge
across their border would have come before the merges inside them. Answers on pairs are memoised, and so are
whole pieces, within bounds. Each piece is encoded once; its ids are the unique compatible segmentation, which
is what merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from meridian.llm.common import map_text
from meridian.llm.token_counts import cut

#: Words, and pairs of tokens, that a task remembers: a million of each take some 400 MB.
TABLE_LIMIT = 1_000_000


class ByteBPE:
    """A vocabulary of ranks: token bytes -> rank. All 256 single bytes must be in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * self.size
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        for data, rank in ranks.items():
            key = data.decode("latin-1")
            self.token[rank] = data
            self.whole[key] = rank
            self.automaton.add_word(key, (len(key), rank))
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.token]
        self.decimal = [f" {i}" for i in range(self.size)]
        #: The longest token that is a proper prefix of each token, or -1.
        self.shorter = [-1] * self.size
        for key, rank in self.whole.items():
            for n in range(len(key) - 1, 0, -1):
                if (p := self.whole.get(key[:n])) is not None:
                    self.shorter[rank] = p
                    break
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        for rank in sorted(ranks.values()):
            first = self.shorter[rank]
            while first >= 0:
                second = self.whole.get(self.token[rank][self.length[first] :].decode("latin-1"))
                if second is not None and first < rank and second < rank and self._fits(first, second):
                    self.merged[first, second] = rank
                    self.left[rank], self.right[rank] = first, second
                    break
                first = self.shorter[first]
        self.limit = TABLE_LIMIT
        #: Of words after a space: number of ids, their decimals, the decoded bytes.
        self.coded: dict[str, tuple[int, str, bytes]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging by rank could leave a and b side by side: undo their merges, latest first, and
        look for a merge over the border that would have come earlier."""
        before = 1 << 62
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            if a > b:
                before, a = a, self.right[a]
                if a != before:
                    continue
                before, b = b + 1, self.left[b]
                if b + 1 == before:
                    return True
            else:
                before, b = b + 1, self.left[b]
                if b + 1 != before:
                    continue
                before, a = a, self.right[a]
                if a == before:
                    return True

    def compatible(self, a: int, b: int) -> bool:
        """The answer of _fits, kept for the next time."""
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        self.pairs[a, b] = known = self._fits(a, b)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1."""
        if (rank := self.whole.get(piece)) is not None:
            return [rank]
        n = len(piece)
        longest = [0] * n
        for end, (size, rank) in self.automaton.iter(piece):
            longest[end - size + 1] = rank  # ends come in ascending order, so the longest stays
        length, shorter, open_at, pairs = self.length, self.shorter, bytearray(b"\1") * (n + 1), self.pairs
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            fits = open_at[end]
            if fits and out and (fits := pairs.get((out[-1], token))) is None:
                fits = self.compatible(out[-1], token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing fits here: never end a token at this place again
                open_at[at] = 0
                token = out.pop()
                at -= length[token]

    def encode(self, text: str) -> list[int]:
        data = text.encode("utf-8").decode("latin-1")
        if len(data) == len(text) and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.encode_piece(data)  # ASCII letters, perhaps after a space: one match
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode("utf-8").decode("latin-1"))]

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])

    def forget(self) -> None:
        """Drops what was remembered of texts: the worker may go on with other work."""
        self.coded.clear()
        self.pairs.clear()

    def _code(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.encode(piece)
        decimal = self.decimal
        return len(ids), "".join([decimal[i] for i in ids]), self.decode(ids)

    def coded_pieces(self, text: str) -> list[tuple[int, str, bytes]]:
        """(number of ids, decimals each after a space, decoded bytes) of the text's pieces in order."""
        plain, spaced = cut(text)
        coded = self.coded
        got = list(map(coded.get, spaced))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    word = spaced[i]
                    if (v := coded.get(word)) is None:  # an earlier turn of this loop may have had it
                        v = self._code(" " + word)
                        if len(word) <= 64:
                            if len(coded) >= self.limit:
                                coded.clear()
                            coded[word] = v
                    got[i] = v
        return [self._code(p) for p in plain] + got


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remember: int = TABLE_LIMIT) -> DataFrame:
    """(id, n_tokens, ids array<int>, decoded_sha256) of every whole text; the hash is that of the decoded ids. Null text has no ids.
    `remember` bounds what a task keeps of words and pairs."""

    def make():
        bpe = vocabulary(path, pattern)
        bpe.limit = remember

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            coded = [[i for _, decimals, _ in bpe.coded_pieces(t.decode("utf-8")) for i in map(int, decimals.split())] for t in texts]
            return {id_col: ids, "n_tokens": [len(c) for c in coded], "ids": coded, "decoded_sha256": [hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded]}

        fn.done = bpe.forget
        return fn

    return map_text(docs, id_col, text_col, f"{id_col} long, n_tokens long, ids array<int>, decoded_sha256 string", make)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of arrays of ids; null decodes to null, an id outside the vocabulary fails."""
    from pyspark.sql import functions as F

    schema = f"{id_col} long, data binary"
    arrow = pa.schema([(id_col, pa.int64()), ("data", pa.binary())])

    def run(batches):
        bpe = vocabulary(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], schema=arrow)

    return coded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids again and hashes both, without
    keeping the ids. Null text is empty; one row out for each row in, nulls and repeats of the id included."""

    def make():
        bpe = vocabulary(path, pattern)
        bpe.limit = TABLE_LIMIT

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            n_tokens, id_sums, data_sums = [], [], []
            for t in texts:
                got = bpe.coded_pieces(t.decode("utf-8"))
                n_tokens.append(sum([n for n, _, _ in got]))
                id_sums.append(hashlib.sha256("".join([s for _, s, _ in got])[1:].encode()).hexdigest())
                data_sums.append(hashlib.sha256(b"".join([d for _, _, d in got])).hexdigest())
            return {id_col: ids, "n_tokens": n_tokens, "ids_sha256": id_sums, "decoded_sha256": data_sums}

        fn.done = bpe.forget
        return fn

    return map_text(docs, id_col, text_col, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
