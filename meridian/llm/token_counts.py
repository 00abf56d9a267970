"""Token counts: batch encoding inside Arrow functions that return lengths only.

The library's encoder is the slow part and prose repeats its words, so each Python worker keeps a bounded
table of the lengths of word pieces. A text is cut where the tokenizer cuts whatever the context is: before a
space that follows a character other than white space. What the table lacks is encoded by the library in
batches balanced by bytes; a batch is one string whose pieces stay apart, as all its cuts are safe ones. A
long run without a safe boundary stays one piece, as cutting it could change its tokens.

Rows: null text is empty (0 bytes, 0 tokens); null or repeated ids are kept, one row out for each row in;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from meridian.llm.common import map_text

#: White space, in Unicode's sense and Python's, before a space: there the space doesn't start a piece.
_UNSAFE = [f"{chr(c)} " for c in range(0x3001) if chr(c).isspace()]
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
#: Entries of a worker's table of lengths; it starts anew when full.
TABLE_LIMIT = 1_200_000
#: Bytes of one string given to the library, and strings of one call.
STRING_BYTES, CALL_STRINGS = 16 << 10, 16


@lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def lengths_tables(path: str) -> tuple[dict[str, int], dict[str, int]]:
    """Lengths of pieces as they stand, and of words after one space."""
    return {}, {}


def cut(text: str) -> tuple[list[str], list[str]]:
    """Pieces as they stand, then words that each follow one space; together they are the text."""
    for unsafe in _UNSAFE:
        if unsafe in text:
            return _SAFE_CUT.split(text), []
    rest = text.split(" ")
    return [rest.pop(0)], rest


def encode_lengths(tokenizer, texts: list[str], words: list[str]) -> tuple[list[int], list[int]]:
    """Tokens of each text, and of each word after a space. Words are joined to strings of some KB."""
    strings, groups, size = [], [], STRING_BYTES
    for word in words:
        # a word that is empty or ends in white space may only be the last of its string
        if size >= STRING_BYTES or not groups[-1][-1] or groups[-1][-1][-1].isspace():
            groups.append([])
            size = 0
        groups[-1].append(word)
        size += len(word) + 1
    strings = [*texts, *("".join([" " + w for w in g]) for g in groups)]
    plain: list[int] = []
    spaced: list[int] = []
    at = 0
    while at < len(strings):
        to, size = at, 0
        while to < len(strings) and (to == at or to - at < CALL_STRINGS and size + len(strings[to]) <= CALL_STRINGS * STRING_BYTES):
            size += len(strings[to])
            to += 1
        for i, enc in enumerate(tokenizer.encode_batch(strings[at:to], add_special_tokens=False), at):
            if i < len(texts):
                plain.append(len(enc))
                continue
            group = groups[i - len(texts)]
            ends = np.cumsum(np.fromiter((len(w) + 1 for w in group), np.int64, len(group)))
            last = np.array([e for _, e in enc.offsets], np.int64)  # a token ends within its own word
            spaced.extend(np.diff(np.searchsorted(last, ends, side="right"), prepend=0).tolist())
        at = to
    return plain, spaced


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, as the library counts with `vocabulary`, a byte-level
    BPE .json file; special strings inside texts are handled as its default, none are added."""

    def make():
        tokenizer, (plain, spaced) = library(vocabulary), lengths_tables(vocabulary)

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            parts = [cut(t.decode("utf-8")) for t in texts]
            if len(plain) > TABLE_LIMIT // 8:
                plain.clear()
            if len(spaced) > TABLE_LIMIT:
                spaced.clear()
            new_plain = list({p for own, _ in parts for p in own if p not in plain})
            new_spaced = list(set().union(*(own for _, own in parts)).difference(spaced))
            a, b = encode_lengths(tokenizer, new_plain, new_spaced)
            plain.update(zip(new_plain, a, strict=True))
            spaced.update(zip(new_spaced, b, strict=True))
            counts = pa.array([sum([plain[p] for p in x]) + sum(map(spaced.__getitem__, y)) for x, y in parts], pa.int64())
            for piece in new_plain:
                if len(piece) > 256:
                    del plain[piece]
            for word in new_spaced:
                if len(word) > 256:
                    del spaced[word]
            return {id_col: ids, "n_bytes": [len(t) for t in texts], "n_tokens": counts, "over_limit": pc.greater(counts, limit)}

        return fn

    return map_text(docs, id_col, text_col, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean", make)
