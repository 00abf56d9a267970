"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to ORDER with the counts of what follows. A byte costs
-log2 of its share in the longest context that has it, plus the escapes from the longer ones (method C: an
unseen byte has the weight of as many sightings as the context has distinct successors), down to a uniform
order -1. Statistics are frozen after training, so the code length of a text is the exact sum of the costs of
its (ORDER + 1)-byte windows, and the trees of all languages become tables from windows to costs that NumPy
looks up. The language with the shortest code wins; its score is its posterior under equal priors.

Training takes a bounded sample: of each language SAMPLE_ROWS labelled rows, first those of at most SAMPLE_BYTES, then, where they
are too few, longer ones, of which SAMPLE_BYTES characters at most are learned; within both by the smallest hash of
their id. All other work covers every byte of every text.

Rows: null text, or one without a letter, is `und` with score 0; equal code lengths go to the language that
sorts first; without any training row everything is `und`; null or repeated ids are kept, one row out for each
row in; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import filter_text, map_text

ORDER = 3
#: The bound of the training sample, for each language, and of the number of languages.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_LANGUAGES = 140, 16 << 10, 256
UNDETERMINED = "und"
#: A text is noise in its language beyond so many times the median rate of that language's sample and so many bits more, which
#: names, numbers and short texts may take; samples of fewer texts tell no noise.
NOISE, NOISE_BITS, NOISE_TEXTS = 2.0, 512, 16
_CHUNK = 1 << 18


def _spread(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ORDER newlines; and the positions of their own bytes."""
    pad = b"\n" * ORDER
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t)]), np.uint8)
    own = np.ones(len(data), bool)
    starts = np.cumsum([0, *(len(t) + ORDER for t in texts)])[:-1]
    for k in range(ORDER):
        own[starts + k] = False
    return data, np.flatnonzero(own)


def _windows(data: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """The last `size` bytes up to each position, as one number."""
    out = np.zeros(len(data), np.uint32)
    for back in range(size):
        out[back:] |= data[: len(data) - back].astype(np.uint32) << np.uint32(8 * back)
    return out[at]


def train(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the windows seen (context and byte) and how often."""
    data, at = _spread(texts)
    return [np.unique(_windows(data, at, k + 1), return_counts=True) for k in range(ORDER + 1)]


class _Lookup:
    """From 32-bit keys to their places in a sorted array, or -1: open addressing, probed for all at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, self.probes = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            slot = self._slot(self.keys[left], self.probes)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several, one stays
            left = left[self.slots[slot] != left]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys * np.uint32(2654435769)
        return ((mixed >> np.uint32(32 - self.bits)) + np.uint32(probe)) & np.uint32((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        left = None
        for probe in range(self.probes):
            own = keys if left is None else keys[left]
            found = self.slots[self._slot(own, probe)]
            good = (self.keys[found] == own) & (found >= 0)
            if left is None:
                out = np.where(good, found, -1)
                left = np.flatnonzero(~good & (found >= 0))
            else:
                out[left[good]] = found[good]
                left = left[~good & (found >= 0)]
            if not len(left):
                break
        return out


class Model:
    """Costs in bits, for all languages at once."""

    def __init__(self, trees: dict[str, list[tuple[np.ndarray, np.ndarray]]], limits: dict[str, float] | None = None):
        self.languages = sorted(trees)
        #: Bits per byte beyond which a text is noise, for each language.
        self.limits = np.array([(limits or {}).get(x, np.inf) for x in self.languages])
        n = len(self.languages)
        self.seen: list[_Lookup] = []  # windows of each order that any language has
        self.cost: list[np.ndarray] = []
        self.contexts: list[_Lookup] = []
        self.escape: list[np.ndarray] = []
        for k in range(ORDER + 1):
            windows = np.unique(np.concatenate([trees[x][k][0] for x in self.languages]))
            contexts = np.unique(windows >> np.uint32(8))
            escape = np.zeros((len(contexts), n))
            cost = np.full((len(windows), n), np.nan)
            for j, x in enumerate(self.languages):
                own, counts = trees[x][k]
                parents, back, kinds = np.unique(own >> np.uint32(8), return_inverse=True, return_counts=True)
                total = np.bincount(back, counts, len(parents)) + kinds
                escape[np.searchsorted(contexts, parents), j] = np.log2(total) - np.log2(kinds)
                cost[np.searchsorted(windows, own), j] = np.log2(total[back]) - np.log2(counts)
            self.contexts.append(_Lookup(contexts))
            self.escape.append(escape)
            below = self._below(windows, k) if k else np.full((len(windows), n), 8.0)
            missing = np.isnan(cost)
            cost[missing] = (escape[np.searchsorted(contexts, windows >> np.uint32(8))] + below)[missing]
            self.seen.append(_Lookup(windows))
            self.cost.append(cost)

    def _below(self, windows: np.ndarray, k: int) -> np.ndarray:
        return self.costs(windows & np.uint32((1 << (8 * k)) - 1), k - 1)

    def costs(self, windows: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits for each window of k + 1 bytes (rows) and each language (columns)."""
        place = self.seen[k](windows)
        out = self.cost[k][place]
        new = np.flatnonzero(place < 0)
        if len(new):
            rest = windows[new]
            out[new] = self._below(rest, k) if k else 8.0
            context = self.contexts[k](rest >> np.uint32(8))
            known = context >= 0
            out[new[known]] += self.escape[k][context[known]]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        data, at = _spread(texts)
        whole = _windows(data, at, ORDER + 1)
        ends = np.cumsum([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.languages)))
        for start in range(0, len(whole), _CHUNK):
            part = self.costs(whole[start : start + _CHUNK])
            first, last = np.searchsorted(ends, [start, start + len(part) - 1], side="right")
            cuts = np.maximum(np.concatenate(([start], ends[first:last])), start) - start
            own = np.arange(first, last + 1)
            full = np.diff(np.append(cuts, len(part))) > 0  # texts without bytes have no part
            out[own[full]] += np.add.reduceat(part, cuts[full], axis=0)
        return out


def without_noise(texts: list[bytes]) -> tuple[list[bytes], float]:
    """The texts that are not noise beside the others, and the limit in bits per byte. Each half is measured by a model of the other
    one; as the limit comes from a median, up to half of the texts may be noise."""
    if len(texts) < NOISE_TEXTS:
        return texts, np.inf
    halves = texts[::2], texts[1::2]
    bits = [Model({"": train(other)}).code_lengths(own)[:, 0] for own, other in (halves, halves[::-1])]
    sizes = [np.array([len(t) for t in own]) for own in halves]
    limit = NOISE * float(np.median(np.concatenate(bits) / np.concatenate(sizes)))
    return [t for own, b, n in zip(halves, bits, sizes, strict=True) for t, k in zip(own, b <= limit * n + NOISE_BITS, strict=True) if k], limit


def has_letter(data: bytes) -> bool:
    return any(map(str.isalpha, data.decode("utf-8")))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, tell_noise: bool = False) -> Model | None:
    """Trees of each language, each trained in a task of its own on its bounded sample; with `tell_noise` on what is no noise there, with the
    limit that tells it."""
    long = (F.octet_length(text_col) > sample_bytes).cast("int")
    usable = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"), long.alias("long"))
    order = Window.partitionBy("l").orderBy("long", F.xxhash64("i"), "i", "h")
    chosen = usable.select("l", "i", "long", F.xxhash64("t").alias("h")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows).select("l", "i", "h").distinct()
    # at most sample_rows rows a language: a proven bound
    sample = usable.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["l", "i", "h"], "left_semi").withColumn("t", F.substring("t", 1, sample_bytes))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(set(rows["t"]))[: sample_rows]
        own, limit = [t.encode("utf-8") for t in texts], np.inf
        if tell_noise:
            own, limit = without_noise(own)
        trees = train(own)
        return pd.DataFrame({"limit": limit, "l": rows["l"].iloc[0], "k": range(ORDER + 1), "windows": [w.astype("<u4").tobytes() for w, _ in trees], "counts": [c.astype("<i8").tobytes() for _, c in trees]})

    trees: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    limits: dict[str, float] = {}
    for r in sample.select("l", "t").groupBy("l").applyInPandas(one, "limit double, l string, k int, windows binary, counts binary").toLocalIterator():
        limits[r.l] = r.limit
        trees.setdefault(r.l, {})[r.k] = (np.frombuffer(r.windows, "<u4"), np.frombuffer(r.counts, "<i8"))
        if len(trees) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Model({x: [t[k] for k in range(ORDER + 1)] for x, t in trees.items()}, limits) if trees else None


def judge(model: Model | None, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text."""
    n = len(texts)
    lang, score, rate = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
    if model is None or not n:
        return lang, score, rate
    bits = model.code_lengths(texts)
    best = bits.argmin(axis=1)
    least = bits[np.arange(n), best]
    posterior = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    for i, t in enumerate(texts):
        if has_letter(t):
            lang[i], score[i], rate[i] = model.languages[best[i]], posterior[i], least[i] / len(t)
    return lang, score, rate


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            lang, score, rate = judge(model, texts)
            return {id_col: ids, "lang_pred": lang, "score": score, "bits_per_byte": rate}

        return fn

    return map_text(docs, id_col, text_col, f"{id_col} long, lang_pred string, score double, bits_per_byte double", make)


def identified(docs: DataFrame, model: Model | None, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is told with at least this score and which are no noise in that language, if
    the model was fitted to tell noise."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def fn(texts: list[bytes]) -> list[bool]:
            lang, score, rate = judge(model, texts)
            limits = {UNDETERMINED: 0.0} | (dict(zip(model.languages, model.limits, strict=True)) if model else {})
            return [x != UNDETERMINED and s >= least_score and r * len(t) <= limits[x] * len(t) + NOISE_BITS for t, x, s, r in zip(texts, lang, score, rate, strict=True)]

        return fn

    return filter_text(docs, text_col, make)


def fold(id_col: str, parts: int) -> Column:
    """The part of a row in folds by crc32 of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts
