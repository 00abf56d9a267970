"""Language-model scoring over the lattice of subword segmentations.

The vocabulary and its scores are existing ones, read from a public tokenizer's file. A piece first weighs
exp(b * score), normalised over the vocabulary. The one number b brings scores of any scale (log probabilities, or ranks of
merges) to that of the training documents: it is the one for which the expected score of a piece equals the mean score of
the pieces that the vocabulary segments the training documents into, which is the most likely b. These weights are the
prior of those that the training documents' distinct words give: of the pieces that the vocabulary segments them into, then,
one step of expectation maximisation, of the pieces expected over all segmentations (words of over BATCHED characters count
by the vocabulary's segmentation). A word's lattice probability is the sum over all its segmentations into
pieces, computed by a forward recursion in log space, for many words of like length at once. Single characters can always be
spelt by byte pieces, which have the vocabulary's least score, so that every text has a probability over 0.

The pieces spell what was not seen: a word's probability is its discounted share of the training documents' words, and what the
discount leaves is the lattice's. The discount is that of words seen once and twice. A text's words are drawn from Polya
urns: the next word is that probability with weight MU, and each word of the text before it with weight 1. A text's
probability is the mean over the weights of MU, times that of its end, which has its share in the training documents. This is a
probability of the sequence of words; it does not depend on their order.

What grows with the corpus is shuffled, never gathered: the words' counts are a table. Only words with at least
1 / FREQUENT of all training tokens are broadcast, of which there are at most FREQUENT; all other words are
rare by that bound, so that joining them with the table has no hot key.

Rows: null text is empty, its only token is the end; null ids are in the held-out fold and are kept; a row that
repeats id and text of another is one row out each; with no training rows all counts are 0, all pieces weigh the same and spell
every word; other columns are not read.
"""

from __future__ import annotations

import copy
import hashlib
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_bytes, column_bytes, map_text, stored, tokens

#: Bound of the broadcast words, entries of a worker's table of word scores, and of a task's table of counts.
FREQUENT, TABLE_LIMIT, COUNT_LIMIT = 1_000_000, 800_000, 600_000
#: Bytes of words whose recursions run side by side, and how many do; longer ones run alone and are not kept.
BATCHED, BATCH = 64, 8192
_CODES = 0x110000
#: Weights of the word model against a text's own words, tried side by side.
MU = (25, 100, 400, 1600, 6400, 25600, 1e6)
#: What the prior of the pieces' weights counts for, in pieces, for each piece of the vocabulary.
PRIOR = 0.1
#: Fixed value: what sentencepiece puts before each word.
MARK = "▁"
END = b""  # no word is empty, so this stands for the end token in tables of counts


@lru_cache(maxsize=2)
def pieces(path: str):
    """The library's processor, the ids of ordinary pieces by their text, the ids of byte pieces, and the score of each id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual, single, score = {}, {}, {}
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            single[int(text[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            usual[text] = i
            score[i] = sp.get_score(i)
    least = min(score.values(), default=0.0)
    return sp, usual, single, score | dict.fromkeys(single.values(), least)


def tempered(scores: np.ndarray, mean: float | None) -> float:
    """The b for which exp(b * score), normalised, has this mean score: by bisection, as the mean grows with b."""
    if mean is None or not scores.min() < mean < scores.max():
        return 0.0
    away = scores - scores.max()

    def expected(b: float) -> float:
        w = np.exp(b * away) if b >= 0 else np.exp(b * (scores - scores.min()))
        return float((w * scores).sum() / w.sum())

    low, high = -1.0, 1.0
    while expected(low) > mean:
        low *= 2
    while expected(high) < mean:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < mean else (low, middle)
    return (low + high) / 2


def log_gamma(z, log=np.log):
    """Stirling's series, from 8 above; for z of at least 1, of arrays or (with another logarithm) of columns."""
    y, product = z + 8.0, z
    for k in range(1, 8):
        product = product * (z + float(k))
    i = 1.0 / y
    square = i * i
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680))) - log(product)


def spelling(codes: np.ndarray):
    """(where, bytes) for characters of one to four bytes: where they are, and the values of their bytes in UTF-8."""
    for n, low, high in ((1, 0, 0x80), (2, 0x80, 0x800), (3, 0x800, 0x10000), (4, 0x10000, _CODES)):
        where = np.flatnonzero((codes >= low) & (codes < high))
        c = codes[where]
        first = c if n == 1 else (0xF00 >> n) & 0xFF | c >> 6 * (n - 1)
        yield where, [first, *(0x80 | c >> 6 * k & 0x3F for k in range(n - 2, -1, -1))]


class Lattice:
    """Log weights of pieces in a trie; scores words by the sum over all segmentations."""

    def __init__(self, path: str, counts: dict[int, int], ends: int):
        _, usual, single, score = pieces(path)
        self.path, ids = path, list(score)
        scores = np.array([score[i] for i in ids])
        used = sum(counts.get(i, 0) for i in ids)
        self.temper = tempered(scores, sum(counts.get(i, 0) * score[i] for i in ids) / used if used else None)
        #: Of all tokens, ends included, the share that are ends; one more of each is taken as seen.
        self.end = math.log((ends + 1) / (used + ends + 2))
        raw = self.temper * scores
        top = float(raw.max())
        norm = top + math.log(np.exp(raw - top).sum()) - math.log1p(-math.exp(self.end))
        weight = dict(zip(ids, (raw - norm).tolist(), strict=True))
        self.prior = np.exp(raw - norm) / np.exp(raw - norm).sum()
        self.byte = np.array([weight.get(single.get(b), float(raw.min()) - norm) for b in range(256)])
        #: Log weights of pieces; of prefixes that are not pieces themselves, none.
        self.weight: dict[str, float | None] = {}
        for text, i in usual.items():
            for n in range(1, len(text)):
                self.weight.setdefault(text[:n], None)
            self.weight[text] = weight[i]
        state = {text: k + 1 for k, text in enumerate(self.weight)} | {"": 0}
        keys = np.array([state[text[:-1]] * _CODES + ord(text[-1]) for text in self.weight], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.arange(1, len(keys) + 1)[order]
        self.of_state = np.array([-np.inf, *(-np.inf if w is None else w for w in self.weight.values())])
        self.words: dict[bytes, float] = {}

    def learned(self, counts: dict[int, float]) -> Lattice:
        """The same pieces, weighing what these counts and the first weights as their prior give; no share is the end's."""
        _, usual, single, score = pieces(self.path)
        full = np.array([counts.get(i, 0.0) for i in score]) + PRIOR * len(score) * self.prior
        logs = np.log(full) - math.log(full.sum())
        weight, least = dict(zip(score, logs.tolist(), strict=True)), float(logs.min())
        out = copy.copy(self)
        out.byte = np.array([weight.get(single.get(b), least) for b in range(256)])
        out.weight = {t: None if w is None else weight[usual[t]] for t, w in self.weight.items()}
        out.of_state = np.array([-np.inf, *(-np.inf if w is None else w for w in out.weight.values())])
        out.words = {}
        return out

    def expected(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How often states and bytes are expected in all segmentations of all texts: forward and backward recursion, as below."""
        size, every = np.array([len(t) for t in texts]), np.arange(len(texts))
        arcs: list[tuple] = []
        reach, codes = self._forward(texts, size, arcs)
        whole = reach[size, every]
        back = np.full(reach.shape, -np.inf)
        back[size, every] = 0.0
        states, spelt = np.zeros(len(self.of_state)), np.zeros(256)
        for i, j, row, state, w in reversed(arcs):
            onward = w + back[j, row]
            back[i, row] = np.logaddexp(back[i, row], onward)
            share = np.exp(reach[i, row] + onward - whole[row])
            if state is not None:
                states += np.bincount(state, share, len(states))
            else:
                for where, values in spelling(codes[row, i]):
                    for v in values if len(where) else ():
                        spelt += np.bincount(v, share[where], 256)
        return states, spelt

    def spelt(self, codes: np.ndarray) -> np.ndarray:
        """The log weight of each character's byte pieces."""
        c = codes.astype(np.int64)
        b = self.byte
        two = b[0xC0 | (c >> 6) & 0x1F] + b[0x80 | c & 0x3F]
        three = b[0xE0 | (c >> 12) & 0x0F] + b[0x80 | (c >> 6) & 0x3F] + b[0x80 | c & 0x3F]
        four = b[0xF0 | (c >> 18) & 0x07] + b[0x80 | (c >> 12) & 0x3F] + b[0x80 | (c >> 6) & 0x3F] + b[0x80 | c & 0x3F]
        return np.select([c < 0x80, c < 0x800, c < 0x10000], [b[c & 0x7F], two, three], four)

    def _forward(self, texts: list[str], size: np.ndarray, arcs: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
        longest = int(size.max(initial=0))
        codes = np.zeros((len(texts), longest), np.int64)
        codes[np.arange(longest) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        reach = np.full((longest + 1, len(texts)), -np.inf)
        reach[0] = 0.0
        for i in range(longest):
            row = np.flatnonzero(size > i)
            here, w = reach[i, row], self.spelt(codes[row, i])
            reach[i + 1, row] = np.logaddexp(reach[i + 1, row], here + w)
            if arcs is not None:
                arcs.append((i, i + 1, row, None, w))
            state = np.zeros(len(row), np.int64)
            for j in range(i, longest):
                key = state * _CODES + codes[row, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = (self.keys[at] == key) & (size[row] > j)
                row, here, state = row[found], here[found], self.next[at[found]]
                if not len(row):
                    break
                w = self.of_state[state]
                reach[j + 1, row] = np.logaddexp(reach[j + 1, row], here + w)
                if arcs is not None and (some := np.flatnonzero(w > -np.inf)).size:
                    arcs.append((i, j + 1, row[some], state[some], w[some]))
        return reach, codes

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        """Forward recursion in log space, for texts of like length at once: place by place, the arcs of all texts that leave it."""
        size = np.array([len(t) for t in texts])
        return self._forward(texts, size)[0][size, np.arange(len(texts))]

    def log_probability(self, text: str) -> float:
        """The same recursion for one text of any length."""
        n, weight, missing = len(text), self.weight, self
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        spelt = self.spelt(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")).tolist()
        for i in range(n):
            arcs = into[i]
            if len(arcs) == 1:
                here = arcs[0]
            else:
                top = max(arcs)
                here = top + math.log(sum([math.exp(a - top) for a in arcs]))
            into[i] = []
            into[i + 1].append(here + spelt[i])
            for j in range(i + 1, n + 1):
                w = weight.get(text[i:j], missing)
                if w is missing:
                    break
                if w is not None:
                    into[j].append(here + w)
        top = max(into[n])
        return top + math.log(sum([math.exp(a - top) for a in into[n]]))

    def find(self, own: list[Counter], seen: dict[bytes, tuple[float, float]], left: float) -> dict[bytes, float]:
        """Log probabilities by word: of seen words, whose shares these are, those of the word model; of others, the lattice's."""
        new = sorted({w for counts in own for w in counts if w not in self.words}, key=len)
        if len(self.words) + len(new) > TABLE_LIMIT:
            self.words.clear()
            new = sorted({w for counts in own for w in counts}, key=len)

        def both(w: bytes, x: float) -> float:
            return math.log(seen[w][1] + left * math.exp(x)) if w in seen else x

        short = [w for w in new if len(w) <= BATCHED]
        for at in range(0, len(short), BATCH):
            part = short[at : at + BATCH]
            found = self.log_probabilities([MARK + w.decode("utf-8") for w in part]).tolist()
            self.words.update((w, both(w, x)) for w, x in zip(part, found, strict=True))
        long = {w: both(w, self.log_probability(MARK + w.decode("utf-8"))) for w in new[len(short) :]}
        return self.words | long if long else self.words

    def __reduce__(self):
        return _lattice, (dict(self.__dict__, words={}),)


def _lattice(state: dict) -> Lattice:
    out = Lattice.__new__(Lattice)
    out.__dict__.update(state)
    return out


def word_counts(train: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(word binary, n) over all training documents, ends of texts included under the empty word."""

    def run(batches):
        total: Counter = Counter()
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for part in by_bytes(batch):
                for t in column_bytes(part.column(0)):
                    total.update(tokens(t))
                    total[END] += 1
                if len(total) > COUNT_LIMIT:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], schema=schema)
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], schema=schema)

    return train.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, vocabulary: str) -> tuple[dict[int, int], dict[int, int]]:
    """How often the vocabulary's segmentation uses each piece, of the counted words and of distinct ones: one row a piece at most."""

    def run(batches):
        sp = pieces(vocabulary)[0]
        total: Counter = Counter()
        kinds: Counter = Counter()
        for batch in batches:
            words = [w.decode("utf-8") for w in batch.column(0).to_pylist()]
            for ids, n in zip(sp.encode(words, num_threads=1), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    total[i] += n
                    kinds[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64()), pa.array([kinds[i] for i in total], pa.int64())], names=["piece", "n", "kinds"])

    found = counts.where(F.octet_length("word") > 0).mapInArrow(run, "piece int, n long, kinds long")
    rows = found.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()
    return {r.piece: r.n for r in rows}, {r.piece: r.kinds for r in rows}


def expected_counts(counts: DataFrame, lattice: Lattice) -> dict[int, float]:
    """How often each piece is expected in all segmentations of the distinct counted words: one row a piece at most."""
    sent = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        lattice = sent.value
        sp, usual, single, _ = pieces(lattice.path)
        states, spelt, kinds = np.zeros(len(lattice.of_state)), np.zeros(256), Counter()
        for batch in batches:
            words = sorted(batch.column(0).to_pylist(), key=len)
            short = [w for w in words if len(w) <= BATCHED]
            for at in range(0, len(short), BATCH):
                more = lattice.expected([MARK + w.decode("utf-8") for w in short[at : at + BATCH]])
                states += more[0]
                spelt += more[1]
            for w in words[len(short) :]:
                kinds.update(sp.encode(w.decode("utf-8")))
        total: Counter = Counter(kinds)
        for text, n in zip(lattice.weight, states[1:].tolist(), strict=True):
            if n:
                total[usual[text]] += n
        for b, i in single.items():
            total[i] += spelt[b]
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([float(n) for n in total.values()], pa.float64())], names=["piece", "n"])

    found = counts.where(F.octet_length("word") > 0).select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r.piece: r.n for r in found.collect()}


def score(docs: DataFrame, is_train: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs.where(is_train), text_col, id_col))
    is_word = F.octet_length("word") > 0
    times = [F.count_if(is_word & (F.col("n") == k)).alias(f"times_{k}") for k in (1, 2)]
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(~is_word, F.col("n"))), F.lit(0)).alias("ends"), *times).first()
    total, ends, base_norm = sums.n, sums.ends, math.log10(sums.n + 0.1 * (sums.v + 1))
    # what a seen word's count is lessened by; the lattice has the rest, as if it were seen once more
    discount = (sums.times_1 + 0.5) / (sums.times_1 + 2 * sums.times_2 + 1)
    left = (discount * (sums.v - (ends > 0)) + 1) / (total - ends + 1)
    end = math.log((ends + 1) / (total + 2))
    onward = math.log1p(-math.exp(end))
    frequent_rows = counts.where(F.col("n") * FREQUENT >= total).toArrow()  # at most FREQUENT rows
    frequent = dict(zip(frequent_rows["word"].to_pylist(), frequent_rows["n"].to_pylist(), strict=True))
    tokens_of, kinds_of = piece_counts(counts, vocabulary)
    lattice = Lattice(vocabulary, tokens_of, ends).learned(kinds_of)
    lattice = lattice.learned(expected_counts(counts, lattice))
    seen = {w: (math.log10(n + 0.1) - base_norm, (n - discount) / (total - ends + 1)) for w, n in frequent.items()}
    sent = spark.sparkContext.broadcast((lattice, seen, ends))
    end_log = math.log10(ends + 0.1) - base_norm
    again = [f"again_{k}" for k in range(len(MU))]

    def make():
        lattice, seen, ends = sent.value

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            key, sha, word, n, spelt, at = [], [], [], [], [], []
            known, base, first, kinds, n_tokens = [], [], [], [], []
            more_at, more_n, more_log = [], [], []
            counted = [Counter(tokens(t)) for t in texts]
            find = lattice.find(counted, seen, left)
            for d, (i, t, own) in enumerate(zip(ids.to_pylist(), texts, counted, strict=True)):
                digest = hashlib.md5(t, usedforsecurity=False).digest()
                base_sum, known_sum, rare, logs = end_log, int(ends > 0), 0, []
                for w, k in own.items():
                    entry, x = seen.get(w), find[w]
                    if entry is None:
                        word.append(w)
                        n.append(k)
                        spelt.append(x)
                        rare += 1
                    else:
                        base_sum += k * entry[0]
                        known_sum += k
                        logs.append(x)
                        if k > 1:
                            more_at.append(d)
                            more_n.append(k)
                            more_log.append(x)
                key += [i] * (rare + 1)
                sha += [digest] * (rare + 1)
                at.append(len(word))
                known += [None] * rare + [known_sum]
                base += [None] * rare + [base_sum]
                first += [None] * rare + [math.fsum(logs)]
                kinds += [None] * rare + [len(own)]
                n_tokens += [None] * rare + [sum(own.values()) + 1]
                word.append(None)
                n.append(None)
                spelt.append(None)
            out = {"id": key, "sha": sha, "word": word, "n": n, "spelt": spelt, "known": known, "base": base, "first": first, "kinds": kinds, "n_tokens": n_tokens}
            where, places = np.array(more_at, np.int64), np.zeros(len(word), bool)
            places[at] = True
            for name, mu in zip(again, MU, strict=True):
                x = mu * np.exp(np.array(more_log, np.float64))
                of_text = np.bincount(where, log_gamma(x + np.array(more_n, np.float64)) - log_gamma(x + 1.0), len(texts))
                values = np.zeros(len(word))
                values[at] = of_text
                out[name] = pa.array(values, pa.float64(), mask=~places)
            return out

        return fn

    doubles = ", ".join(f"{x} double" for x in again)
    rows = stored(map_text(docs, id_col, text_col, f"id long, sha binary, word binary, n long, spelt double, known long, base double, first double, kinds long, n_tokens long, {doubles}", make))
    rare = counts.where(F.col("n") * FREQUENT < total).withColumnRenamed("n", "c")
    joined = rows.where("word is not null").select("id", "sha", "word", "n", "spelt").join(rare, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    log_p = F.when(c > 0, F.ln((c - discount) / (total - ends + 1) + left * F.exp("spelt"))).otherwise(math.log(left) + F.col("spelt"))
    sums_of = ("copies", "known", "base", "first", "kinds", "n_tokens", *again)
    # a word's first place, and for one that comes again a row for each weight
    urns = F.when(F.col("n") > 1, F.array(*(F.lit(k) for k in range(-1, len(MU))))).otherwise(F.array(F.lit(-1)))
    placed = joined.select("id", "sha", "n", c.alias("c"), log_p.alias("log_p"), F.explode(urns).alias("urn"))
    mu = F.element_at(F.array(*(F.lit(float(mu)) for mu in MU)), F.greatest("urn", F.lit(0)) + 1)
    placed = placed.withColumn("x", mu * F.exp("log_p"))
    placed = placed.withColumn("again", F.when(F.col("urn") >= 0, log_gamma(F.col("x") + F.col("n"), F.ln) - log_gamma(F.col("x") + 1.0, F.ln)).otherwise(0.0))
    whole = F.col("urn") < 0
    parts = placed.select(
        "id",
        "sha",
        F.lit(0).alias("copies"),
        F.when(whole & (F.col("c") > 0), F.col("n")).otherwise(0).alias("known"),
        F.when(whole, F.col("n") * (F.log10(F.col("c") + 0.1) - base_norm)).otherwise(0.0).alias("base"),
        F.when(whole, F.col("log_p")).otherwise(0.0).alias("first"),
        *(F.lit(0).cast("long").alias(x) for x in ("kinds", "n_tokens")),
        *(F.when(F.col("urn") == k, F.col("again")).otherwise(0.0).alias(name) for k, name in enumerate(again)),
    )
    mains = rows.where("word is null").select("id", "sha", F.lit(1).alias("copies"), *sums_of[1:])
    # rows with the same id and text add up to a multiple of one row's sums
    per_doc = mains.unionByName(parts).groupBy("id", "sha").agg(*(F.sum(x).alias(x) for x in sums_of))
    m = F.expr("n_tokens div copies") - 1
    by_urn = per_doc.withColumns(
        {
            name: (F.col("first") + F.col("kinds") * math.log(mu) + F.col(name)) / F.col("copies") - (log_gamma(m + float(mu), F.ln) - float(log_gamma(np.float64(mu))))
            for name, mu in zip(again, MU, strict=True)
        }
    ).withColumn("top", F.greatest(*again))
    text_log = F.col("top") + F.ln(sum((F.exp(F.col(a) - F.col("top")) for a in again), F.lit(0.0)) / len(MU))
    one = by_urn.select(
        F.col("id").alias(id_col),
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        ((text_log + m * onward + end) / math.log(10)).alias("score"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    )
    return one.select(id_col, (~is_train).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
