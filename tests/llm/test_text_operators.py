"""Operators on texts against the libraries, brute force, and the cases that every operator has to stand."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridian.llm import byte_bpe, decontamination, jaccard_join, language_id, lattice_lm, license_scan, shingles, suffix_dedup, token_counts

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew coffee near the old stone bridge of the town and sing"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéñü") for _ in range(r.randint(1, 7))) for _ in range(n))


BASE = prose(120, 1)
WORDS = BASE.split()
TEXTS = [
    (1, BASE),
    (2, BASE),  # an exact copy
    (3, " ".join(WORDS[:60] + ["changed"] + WORDS[61:])),  # a near copy
    (4, ""),
    (5, None),
    (6, "   \n\t "),
    (7, "Mit  license, APACHE LICENSE\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"),
    (8, prose(40, 2) + " " + PASSAGE + " " + prose(40, 3)),
    (9, prose(30, 4) + "\n" + PASSAGE + "\n" + prose(20, 5)),
    (10, "<|endoftext|> it's  I'll x  <|endoftext|>1234567890 漢字 a b"),
    (11, "a" * 3000),
    (12, "ab " * 2000),
    (13, prose(6000, 6)),  # a long one
    (14, "one two"),
    (15, "one two"),
    (None, "a row without an id"),
    (16, "4321 5678 !!"),
    (9, prose(30, 4) + "\n" + PASSAGE + "\n" + prose(20, 5)),  # a repeated row
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with those of results
    rows = [(i, t, "en" if (i or 0) % 2 else "fr", 7, "x", 1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long, labels string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def expected(fn):
    return sorted((fn(i, t) for i, t in TEXTS), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_token_counts(docs, empty):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)

    def one(i, t):
        n = len(library.encode(t or "", add_special_tokens=False))
        return (i, len((t or "").encode()), n, n > 512)

    assert collected(token_counts.count_tokens(docs, path)) == expected(one)
    assert token_counts.count_tokens(empty, path).collect() == []


def test_token_counts_at_unsafe_boundaries():
    library = token_counts.library(P.path("byte_bpe_50k.json"))
    for k in range(200):
        r = random.Random(k)
        text = "".join(r.choice(["a", "B", " ", "  ", "\n", "\t", " ", "　", "é", "'s", "1", ",", "<|endoftext|>", "漢"]) for _ in range(60))
        plain, spaced = token_counts.cut(text)
        assert "".join(plain) + "".join(" " + w for w in spaced) == text
        a, b = token_counts.encode_lengths(library, plain, spaced)
        assert sum(a) + sum(b) == len(library.encode(text, add_special_tokens=False))


def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, empty):
    path, library = P.path("byte_bpe_50k.tiktoken"), reference_bpe()

    def one(i, t):
        ids = library.encode_ordinary(t or "")
        return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert collected(byte_bpe.digests(docs, path, P.PATTERN)) == expected(one)
    assert byte_bpe.digests(empty, path, P.PATTERN).collect() == []
    coded = byte_bpe.encode(docs, path, P.PATTERN)
    back = byte_bpe.decode(coded, path, P.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t in TEXTS)


def test_byte_bpe_on_random_bytes():
    bpe, library = byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), reference_bpe()
    for k in range(150):
        r = random.Random(k)
        text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), r.randrange(0x4E00, 0x4F00)])) for _ in range(80))
        assert bpe.encode(text) == library.encode_ordinary(text)


def test_license_scan(docs, empty):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

    def one(i, t):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        starts = sorted((k, label) for p, label in phrases.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split())
        return (i, len(own), len(starts), starts[0][0] if starts else None, starts[-1][0] if starts else None, ",".join(sorted({x for _, x in starts})))

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = license_scan.scan_licenses(docs)
    assert collected(found.select(*names)) == expected(one)
    tagged = found.where("doc_id = 7").first()
    assert tagged.labels == "apache,apache-2.0 or mit,gpl-2.0-only with classpath-exception-2.0,mit" and 0 < tagged.score < 1
    assert license_scan.scan_licenses(empty).collect() == []


@pytest.mark.parametrize(
    ("expression", "order"),
    [("a and b or c", "a b and c or"), ("a or b and c", "a b c and or"), ("a and (b or c)", "a b c or and"), ("a with e or b", "a e with b or"), ("a and", None), ("(a", None), ("a b", None), ("", None), (")a", None)],
)
def test_shunting_yard(expression, order):
    assert license_scan.postfix(expression) == (order.split() if order else None)


@pytest.mark.parametrize(
    ("expression", "labels", "choices"),
    [
        ("MIT AND Apache-2.0", {"mit", "apache-2.0"}, 1),
        ("MIT OR Apache-2.0", {"apache-2.0 or mit"}, 2),
        ("(mit or apache-2.0) and gpl-2.0 with x", {"apache-2.0 or mit", "gpl-2.0 with x"}, 2),
        ("mit or gpl-2.0 and isc or mit", {"(gpl-2.0 and isc) or mit"}, 2),
        ("MIT OR MIT", {"mit"}, 1),
        ("(MIT OR MIT) WITH x AND (a or (b or a))", {"mit with x", "a or b"}, 2),
        ("(a or b) with (c or d)", {"(a or b) with (c or d)"}, 2),
        ("a and (b or c and (d or a))", {"a", "((a or d) and c) or b"}, 3),
        ("the", {"the"}, 1),
        ("Zlib", {"zlib"}, 1),
        ("a and", None, 0),
    ],
)
def test_licence_expressions(expression, labels, choices):
    assert license_scan.evaluated(expression) == ((labels, choices) if labels else None)


def test_leading_expression():
    assert license_scan.leading_expression("MIT OR Apache-2.0 see the file") == "MIT OR Apache-2.0"
    for line in ("the quick brown fox", "well-known format is used", "", " . "):
        assert license_scan.leading_expression(line) == ""
    for line in ("Minpack", "Minpack.", "Minpack */ x = 1;", "Minpack // more", "(Minpack) -->", "Minpack # more"):
        assert license_scan.evaluated(license_scan.leading_expression(line)) == ({"minpack"}, 1)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier : MIT", "mit"),
        ("see the SPDX license identifier list", ""),
        ("SPDX-License-Identifier without a colon\nSPDX-License-Identifier: ISC", "isc"),
        ("SPDX License Identifier: MIT", ""),  # the words, but not the tag
        ("SPDX-License-Identifier: Apache-2.0.", "apache-2.0"),
        ("SPDX-License-Identifier: MIT.", "mit"),
        ("SPDX-License-Identifier: Minpack", "minpack"),
        ("SPDX-License-Identifier: GPL-2.0+, or so", "gpl-2.0+"),
        ("SPDX-License-Identifier: well-known format is used", ""),
        ("SPDX-License-Identifier: MIT OR MIT", "mit"),
        ("SPDX-License-Identifier:", ""),
        ("spdx-license-identifier\n: MIT", ""),
    ],
)
def test_tags_of_licences(text, labels):
    phrases = ((license_scan.TAG, None, False),)
    row = license_scan.scan(text.encode(), license_scan.automaton(phrases))
    assert row["labels"] == labels
    assert row["score"] == (0.75 if labels else 0)


def ppm_bits(text, texts):
    order = language_id.ORDER
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k][t[i - k : i]][t[i]] += 1
    t, bits = b"\n" * order + text, 0.0
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            c = counts[k].get(t[i - k : i])
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if t[i] in c:
                bits -= math.log2(c[t[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_language_models_are_exact():
    own = {x: [prose(50, k).encode() for k in range(3)] for x in ("aa", "bb")}
    own["bb"] = [t.replace(b"a", b"z") for t in own["bb"]]
    model = language_id.Model({x: language_id.train(t) for x, t in own.items()})
    texts = [b"", b"a", prose(30, 9).encode(), bytes(range(256)), b"zzz zz", "漢字".encode()]
    for text, row in zip(texts, model.code_lengths(texts), strict=True):
        for x, bits in zip(model.languages, row, strict=True):
            assert bits == pytest.approx(ppm_bits(text, own[x]), rel=1e-9)


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(language_id.fold("doc_id", 4) != 2))
    rows = language_id.predict(docs, model).join(docs.where(language_id.fold("doc_id", 4) == 2).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_cases(docs, empty):
    model = language_id.fit(docs)
    found = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert {i for i, lang, _ in found if lang == "und"} == {4, 5, 6, 16}
    assert all(s == 0 for _, lang, s in found if lang == "und")
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    kept = language_id.identified(docs, model)
    assert kept.columns == docs.columns and {4, 5, 6, 16}.isdisjoint(r.doc_id for r in kept.collect())


def test_noise_is_told_from_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = {r.doc_id for r in language_id.identified(docs, language_id.fit(docs, tell_noise=True)).select("doc_id").collect()}
    noise, clean = set(), set()
    for r in docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "left").select("doc_id", "text", "quality").collect():
        if len(re.findall(r"!!|%%%|&&&|[*]{3}|[$]{3}|###", r.text or "")) > 10:
            noise.add(r.doc_id)
        elif r.quality == 1:
            clean.add(r.doc_id)
    assert len(clean & kept) >= 0.99 * len(clean)
    assert len(noise - kept) >= 0.5 * len(noise)


def test_limits_of_noise_are_exact():
    texts = [prose(60, k).encode() for k in range(20)] + [b"%%% !!" * 300]
    own, limit = language_id.without_noise(texts)
    halves = texts[::2], texts[1::2]
    bits = {t: ppm_bits(t, other) for one, other in (halves, halves[::-1]) for t in one}
    rates = sorted(b / len(t) for t, b in bits.items())
    assert limit == pytest.approx(2 * rates[len(rates) // 2])
    assert set(own) == {t for t, b in bits.items() if b <= limit * len(t) + 512} == set(texts[:-1])
    assert language_id.without_noise(texts[:5]) == (texts[:5], math.inf)


def crc_fold(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


def test_lattice_lm(docs, empty):
    path = P.path("piece_bpe_32k.model")
    is_train = language_id.fold("doc_id", 10) != 0
    rows = lattice_lm.score(docs, is_train, path).collect()
    assert len(rows) == len(TEXTS)
    train = Counter()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    for i, t in TEXTS:
        if crc_fold(i, 10):
            train.update([*words(t), None])
    total, kinds = sum(train.values()), len(train)
    want = sorted(
        ((i is None, i or 0), crc_fold(i, 10) == 0, len(words(t)) + 1, sum(train[w] > 0 for w in [*words(t), None]), round(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*words(t), None]), 6))
        for i, t in TEXTS
    )
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert got == want and {r.train_tokens for r in rows} == {total}
    assert all(r.score < 0 for r in rows)
    assert lattice_lm.score(empty, is_train, path).collect() == []


def test_lattice_lm_learns(spark):
    """F1: held-out texts of the training texts' kind score about as high as by their words' shares, and every score is the model's."""
    r = random.Random(5)
    parts = ["ing", "tion", "th", "er", "on", "ed", "ñe", "schö"]
    stock = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(300)]
    texts = [(i, " ".join([*r.choices(stock, [1 / k for k in range(1, 301)], k=60), *(["new" + r.choice(stock)] * r.randint(0, 2))])) for i in range(400)]
    texts += [(1000, "x" * 3000 + " é"), (1001, "漢字 😀 " * 50), (1002, None), (1003, "zq " * 5000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    path, is_train = P.path("piece_bpe_32k.model"), language_id.fold("doc_id", 10) != 0
    found = {x.doc_id: x for x in lattice_lm.score(rows, is_train, path).collect()}
    assert len(found) == len(texts) and all(math.isfinite(x.score) and x.score < 0 for x in found.values())
    held = [x for x in found.values() if x.held_out and x.doc_id < 1000]
    assert len(held) > 20 and sum(x.score for x in held) > 1.1 * sum(x.base_score for x in held)
    # by brute force, over all steps of every text
    train = Counter(w for i, t in texts if crc_fold(i, 10) for w in (t or "").split())
    ends, n, once, twice = sum(crc_fold(i, 10) > 0 for i, _ in texts), sum(train.values()), *(sum(c == k for c in train.values()) for k in (1, 2))
    cut = (once + 0.5) / (once + 2 * twice + 1)
    counts = spark.createDataFrame([(w.encode(), c) for w, c in train.items()], "word binary, n long")
    tokens_of, kinds_of = lattice_lm.piece_counts(counts, path)
    lattice = lattice_lm.Lattice(path, tokens_of, ends).learned(kinds_of)
    lattice = lattice.learned(lattice_lm.expected_counts(counts, lattice))
    end = (ends + 1) / (n + ends + 2)
    for i, t in texts:
        words, logs = (t or "").split(), []
        spelt = {w: math.exp(lattice.log_probability("▁" + w)) for w in set(words) if len(w) < 100}
        if len(spelt) < len(set(words)):
            continue  # too long for plain products
        for mu in lattice_lm.MU:
            own, log = Counter(), math.log(end)
            for k, w in enumerate(words):
                p = (max(train[w] - cut, 0) + (cut * len(train) + 1) * spelt[w]) / (n + 1)
                log += math.log((1 - end) * (mu * p + own[w]) / (mu + k))
                own[w] += 1
            logs.append(log)
        want = max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs) / len(logs))
        assert found[i].score == pytest.approx(want / math.log(10), rel=1e-9)


def test_lattice_expects_pieces():
    """Expected counts are the derivatives of the summed logarithms by the logarithms of weights."""
    path = P.path("piece_bpe_32k.model")
    lattice = lattice_lm.Lattice(path, {k: 20000 - k for k in range(300, 20000)}, 5)
    words = ["▁the", "▁singing", "▁😀éx漢", "▁thé"]
    states, spelt = lattice.expected(words)
    total = lambda: lattice.log_probabilities(words).sum()
    before, step = total(), 1e-6
    for where, got in ((lattice.byte, spelt), (lattice.of_state, states)):
        for k in np.flatnonzero(got > 1e-3):
            where[k] += step
            assert (total() - before) / step == pytest.approx(got[k], abs=1e-5)
            where[k] -= step
    learned = lattice.learned({})
    assert np.exp([w for w in learned.weight.values() if w is not None]).sum() + np.exp(learned.byte).sum() == pytest.approx(1, rel=1e-9)


def test_lattice_sums_all_segmentations():
    path = P.path("piece_bpe_32k.model")
    lattice = lattice_lm.Lattice(path, {k: 20000 - k for k in range(300, 20000)}, 5)

    def brute(text):
        if not text:
            return 1.0
        total = math.prod(math.exp(lattice.byte[b]) for b in text[0].encode()) * brute(text[1:])
        for n in range(1, len(text) + 1):
            if (w := lattice.weight.get(text[:n])) is not None:
                total += math.exp(w) * brute(text[n:])
        return total

    words = ("▁the", "▁a", "▁héllo", "▁漢x", "▁singing", "▁😀é")
    for word, batched in zip(words, lattice.log_probabilities(list(words)), strict=True):
        assert lattice.log_probability(word) == pytest.approx(math.log(brute(word)), rel=1e-12)
        assert batched == pytest.approx(math.log(brute(word)), rel=1e-12)
    for n in (64, 5000):
        assert lattice.log_probability("▁" + "x" * n) == pytest.approx(lattice.log_probabilities(["▁" + "x" * n])[0], rel=1e-12)


def test_lattice_weights_are_the_vocabularys_scores():
    path = P.path("piece_bpe_32k.model")
    _, usual, single, score = lattice_lm.pieces(path)
    counts = {i: 32000 - k for k, i in enumerate(usual.values())}
    lattice = lattice_lm.Lattice(path, counts, 7)
    weights = {i: lattice.weight[t] for t, i in usual.items()} | {i: lattice.byte[b] for b, i in single.items()}
    assert sum(map(math.exp, weights.values())) + math.exp(lattice.end) == pytest.approx(1, rel=1e-9)
    a, b = list(usual.values())[10], list(usual.values())[3000]
    assert weights[a] - weights[b] == pytest.approx(lattice.temper * (score[a] - score[b]), rel=1e-9) and lattice.temper > 0
    mean = sum(n * score[i] for i, n in counts.items()) / sum(counts.values())
    inside = sum(map(math.exp, weights.values()))
    assert sum(math.exp(w) * score[i] for i, w in weights.items()) / inside == pytest.approx(mean, rel=1e-6)
    assert lattice_lm.Lattice(path, {}, 0).temper == 0


def shingle_set(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(texts, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in texts]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[find(b)] = find(a)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        root = find(k)
        smallest[root] = min(smallest.get(root, i), i)
    return sorted((i, len(s), smallest[find(k)] if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, empty, size, percent):
    texts = [(i, t) for i, t in TEXTS if i is not None]
    r = random.Random(3)
    for k in range(60):  # a crowd of near copies of unlike distance, and of copies
        own = list(WORDS)
        for _ in range(k % 7):
            own[r.randrange(len(own))] = f"w{r.randrange(1000)}"
        texts.append((100 + k, " ".join(own)))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted(tuple(x) for x in jaccard_join.linked(rows, size, percent).collect())
    assert got == brute_components(texts, size, percent)
    if size == 4:
        assert jaccard_join.linked(empty, size, percent).collect() == []
        assert jaccard_join.linked(docs, size, percent).count() == len(TEXTS)


def brute_dedup(texts):
    seen, out = set(), []
    for i, t in sorted(texts):
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, empty):
    texts = [(i, t or "") for i, t in dict.fromkeys(TEXTS) if i is not None]
    line = "a line that is in very many documents and is short"
    for k in range(40):
        texts.append((200 + k, f"{prose(12, k)} {line}\n{prose(9, k + 1)} {PASSAGE if k % 3 else ''} {prose(12, k)}"))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = suffix_dedup.deduplicate(rows).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert sorted(tuple(x) for x in found.collect()) == brute_dedup(texts)
    assert suffix_dedup.deduplicate(empty).collect() == []
    assert suffix_dedup.deduplicate(docs).count() == len(TEXTS)
    clean = suffix_dedup.cleaned(docs)
    assert clean.columns == docs.columns and 2 not in {r.doc_id for r in clean.collect()}


def brute_hits(t, items):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    hit, who = set(), set()
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        for window in ([w[k : k + 10] for k in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []):
            for k in range(len(own) - len(window) + 1):
                if own[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    who.add(str(item))
    return len(own), len(hit), sorted(who)


ITEMS = [(1, PASSAGE), (2, "One, TWO"), (3, None), (4, "!!"), (5, prose(15, 99)), (1, PASSAGE), (None, "x"), (12, "ab ab ab ab ab ab ab ab ab ab ab")]


def test_decontamination(spark, docs, empty, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = expected(lambda i, t: (i, *with_null(*brute_hits(t, ITEMS))))
    names = ["doc_id", "n_words", "n_hit", "items"]
    assert collected(decontamination.contamination(docs, bench).select(*names)) == want
    monkeypatch.setattr(decontamination, "WINDOWS", 5)  # several groups of windows
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 4000)  # and many slices
    assert collected(decontamination.contamination(docs, bench).select(*names)) == want
    kept = decontamination.uncontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, t in TEXTS if not brute_hits(t, ITEMS)[1])
    assert decontamination.contamination(empty, bench).collect() == []
    assert {r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {0}


def with_null(n, hit, who):
    return n, hit, [w for w in who if w != "None"] + [None] * ("None" in who)


def test_proximity(spark, docs):
    found = decontamination.proximity(docs, [["wizards", "Coffee"], ["wizards", "fox"], []], 3).collect()
    assert {(r.doc_id, r["query"]) for r in found} == {(8, 0), (9, 0)}
    # all of a window's words within so many of its rarest, in any order; words of the neighbour document do not count
    rows = spark.createDataFrame([(1, "a x y b"), (2, "b a"), (3, "a a a a"), (4, "b"), (5, "a x x x x b"), (6, None)], "doc_id string, text string")
    near = decontamination.contamination(rows.coalesce(1), spark.createDataFrame([("i", "a b"), ("j", "b")], "item_id string, text string"), within=3)
    assert {r.doc_id: (list(r["items"]), r.near) for r in near.collect()} == {"1": (["j"], ["i", "j"]), "2": (["j"], ["i", "j"]), "3": ([], []), "4": (["j"], ["j"]), "5": (["j"], ["j"]), "6": ([], [])}


def test_lists_of_positions(monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    hashes = r.integers(0, 1 << 63, 40, dtype=np.uint64)[r.integers(0, 40, 3000)]
    at = np.cumsum(r.integers(1, 200, 3000))
    for own in (hashes, np.where(hashes % np.uint64(3) == 0, hashes[0], hashes[0] ^ np.uint64(1))):  # the second: like upper bits
        terms, first, position = decontamination._lists(own, at)
        packed = decontamination._packed(first, position).to_pylist()
        sizes = np.diff(np.append(first, len(position)))
        assert sorted(terms.tolist()) == sorted(set(own.tolist()))
        for t, data, n in zip(terms.tolist(), packed, sizes.tolist(), strict=True):
            assert decontamination.unpacked(data, n).tolist() == at[own == t].tolist()
    far = decontamination._packed(np.array([0, 2]), np.array([5, 70_000, 1, 2, 3]))
    assert decontamination.unpacked(far[0].as_py(), 2).tolist() == [5, 70_000] and decontamination.unpacked(far[1].as_py(), 3).tolist() == [1, 2, 3]


@pytest.mark.parametrize("bound", [suffix_dedup.BROADCAST_RUNS, -1])
def test_suffix_dedup_of_repeated_rows(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_RUNS", bound)
    texts = [(i, t) for i, t in TEXTS if i is not None]
    texts += [(20, prose(40, 20)), (20, prose(40, 20)), (20, prose(40, 20)), (21, prose(40, 20) + prose(9, 21))]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = suffix_dedup.deduplicate(rows).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    once = {r[0]: r for r in brute_dedup([(i, t or "") for i, t in dict.fromkeys(texts)])}
    assert sorted(tuple(x) for x in found.collect()) == sorted(once[i] for i, _ in texts)
    kept = [r.doc_id for r in suffix_dedup.cleaned(rows).collect()]
    assert kept.count(9) == 2 and kept.count(20) == 3


def test_jaccard_join_of_null_and_repeated_ids(spark):
    near = lambda *changed: " ".join(f"w{k}" if k in changed else w for k, w in enumerate(WORDS))
    far = prose(80, 77)
    # members that link directly, and copies of a text without an id that could be their hub
    texts = [(50 + k, near(119 - k % 3)) for k in range(3)] + [(None, BASE)] * 3 + [(None, None), (None, far)]
    # one id with two texts, one of them that of a smaller id, the other a near copy's
    texts += [(5, far), (70, far), (70, prose(90, 78)), (80, prose(90, 78)), (90, prose(30, 79)), (90, ""), (60, prose(30, 79)), (91, " ")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {}
    for r in jaccard_join.linked(rows, 4, 85).collect():
        got.setdefault(r.doc_id, []).append(r.component_id)
    assert got == {50: [50], 51: [50], 52: [50], None: [None] * 5, 5: [5], 70: [5, 5], 80: [5], 90: [60, 60], 60: [60], 91: [91]}
    assert {r.doc_id for r in jaccard_join.one_of_each(rows, 4, 85).collect()} == {50, 5, 60, 91, None}


def test_shingles_of_few_words():
    for size in (4, 5):
        for n in range(8):
            text = " ".join("one two three four five six seven".split()[:n]).encode()
            alone, among = shingles.sets([text], size), shingles.sets([text, BASE.encode()], size)
            assert len(alone[0]) == (max(1, n - size + 1) if n else 0) and alone[0].tolist() == among[0].tolist()


def test_license_scan_of_many_tags_and_long_expressions(spark):
    tag = "SPDX-License-Identifier:"
    many = f"/*! {tag} MIT */ x=1; /* {tag}Apache-2.0 */ y=2; // spdx-license-identifier: BSD-3-Clause OR ISC\r{tag}"
    long = f"{tag} " + " OR ".join(f"L{k}" for k in range(300)) + " text follows"
    rows = spark.createDataFrame([(1, many), (2, long), (3, f"{tag} MIT and or Zlib"), (4, f"{tag} MIT OR Apache-2.0"), (5, f"{tag} MIT AND Apache-2.0"), (6, f"{tag} the quick brown fox")], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(rows).collect()}
    assert found[1].labels == "apache-2.0,bsd-3-clause or isc,mit" and found[1].score == 1 - 0.5**5.5
    assert found[2].labels == " or ".join(sorted(f"l{k}" for k in range(300)))
    assert found[3].labels == "mit" and found[3].score == 0.75
    assert (found[4].labels, found[4].score, found[5].labels, found[5].score) == ("apache-2.0 or mit", 1 - 0.5**1.5, "apache-2.0,mit", 0.75)
    assert found[6].labels == "" and found[6].score == 0


def test_decontamination_by_items_without_id(spark, docs):
    items = [*ITEMS, (None, PASSAGE), (None, "it")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "items"]
    assert collected(decontamination.contamination(docs, bench).select(*names)) == expected(lambda i, t: (i, *with_null(*brute_hits(t, items))))
    kept = {r.doc_id for r in decontamination.uncontaminated(docs, bench).collect()}
    assert kept == {i for i, t in TEXTS if not brute_hits(t, items)[1]} and 10 not in kept


def thue_morse(n):
    out = b"a"
    while len(out) < n:
        out += out.translate(bytes.maketrans(b"ab", b"ba"))
    return out[:n], out[:n].translate(bytes.maketrans(b"ab", b"ba"))


def test_hashes_tell_strings_of_like_form_apart(spark):
    """Words and stretches that collide under any polynomial hash modulo a power of two."""
    import numpy as np

    one, two = thue_morse(1024)
    assert not set(shingles.sets([one], 4)[0].tolist()) & set(shingles.sets([two], 4)[0].tolist())
    rows = spark.createDataFrame([(1, one.decode()), (2, two.decode()), (3, two.decode() * 40), (4, one.decode() * 40)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.linked(rows, 4, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    for n in (128, 184, 1024):
        a, b = thue_morse(n)
        own = suffix_dedup.Hashes([a, b, a])
        start = np.array([0, n, 2 * n])
        x, y, z = own.of(start, start + n).tolist()
        assert x == z != y


def test_language_id_learns_languages_of_long_texts_only(spark):
    rows = [(k, "a", prose(20, k)) for k in range(5)] + [(10 + k, "b", " ".join(["zzz qqq xxyyx"] * 2000)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.fit(docs, sample_bytes=2000)
    assert model.languages == ["a", "b"]
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == {i: x for i, x, _ in rows}
