"""Hashes of word shingles, for whole batches of texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

from meridian.llm.common import LOWER_TABLE

#: Bytes of a word beyond which it is hashed by itself.
LONG = 128
_IS_SPACE = bytes(b == 32 or 9 <= b <= 13 for b in range(256))
#: By the bytes that are left of a word: which bits of its next lane are its own.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes], translation: bytes = LOWER_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word `[^\\x20\\x09-\\x0D]+` of all texts in order, translated byte by byte, and each text's number of words.
    A word's lanes of eight bytes are mixed one after the other; words over LONG bytes have a cryptographic hash."""
    joined = b"\n".join(texts).translate(translation) + b"\n"
    edge = np.flatnonzero(np.diff(np.frombuffer(joined.translate(_IS_SPACE), np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    size = ends - starts
    lanes = np.ndarray(len(joined), "<u8", joined + bytes(8), strides=(1,))
    hashes = mix(size.astype(np.uint64))
    left = np.flatnonzero(size <= LONG)
    at = starts[left]
    while len(left):
        rest = ends[left] - at
        hashes[left] = mix(hashes[left] + (lanes[at] & _MASKS[np.minimum(rest, 8)]))
        more = rest > 8
        left, at = left[more], at[more] + 8
    for i in np.flatnonzero(size > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of `size` words of each text; of fewer words, the whole sequence is one."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not texts:
        return out
    hashes, counts = words(texts)
    joined = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        m = len(hashes) - k
        joined[:m] = mix(joined[:m] + hashes[k:])
    first = 0
    for i, n in enumerate(counts.tolist()):
        if n >= size:
            own = np.sort(joined[first : first + n - size + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out[i] = own[new]
        elif n:
            value = np.array([n], np.uint64)
            for h in hashes[first : first + n]:
                value = mix(value + h)
            out[i] = value
        first += n
    return out
