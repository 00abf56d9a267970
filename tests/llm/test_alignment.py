"""Cross-tokenizer alignment against the libraries and a brute-force version, and the cases that every operator has to stand."""

import bisect
import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from meridian.llm import cross_tokenizer, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokens(text, a, b, vocabulary, byte_of):
    """(id, end) of both sides, or None."""
    if not text:
        return None
    data = (" " + text).encode()
    out = []
    for ids, bytes_of in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte_of[c] for c in vocabulary[i])),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        own, at = [], b""
        for i in ids:
            at += bytes_of(i)
            own.append((i, len(at)))
        if at != data:
            return None
        out.append(own)
    return out


def expected(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    vocabulary = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}
    groups, links = [], []
    for _, text in rows:
        found, own = tokens(text, a, b, vocabulary, byte_of), []
        if found:
            cuts = sorted({e for _, e in found[0]} & {e for _, e in found[1]})
            of = [defaultdict(list), defaultdict(list)]
            for side, place in zip(found, of, strict=True):
                for i, e in side:
                    place[bisect.bisect_left(cuts, e)].append(i)
            own = [(of[0][k], of[1][k]) for k in range(len(cuts))]
        groups.append(own)
        links.append(Counter((i, j) for x, y in own for i in x for j in y))
    count = Counter(p for one in links for p in one)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for (doc, _), own, one in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        yield (
            doc, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), sum(one.values()),
            sum(n for p, n in one.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in one.items()), text,
        )


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0], r[1:]))


def same(got, rows):
    got, rows = ordered(got), ordered(rows)
    assert len(got) == len(rows)
    different = [(g[0], str(g)[:200], str(r)[:200]) for g, r in zip(got, rows, strict=True) if g != r]
    assert not different[:3]


def odd_rows():
    r = random.Random(2)
    bits = ["a", "the", "Über", " ", "  ", "\n", "\t ", "漢字", "é", "ünd", "　", "<s>", "<|endoftext|>", "'s", "1234", "!!", "it's", "\x00", "ﬁ", "👍🏽", "​", "zzzq"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(1, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "▁"), (205, "   x"), (None, "no id"), (206, "one two"), (206, "one two"), (207, "ab" * 3000), (208, "\n" * 500)]
    return [*rows, (209, " ".join(r.choice(["coffee", "house", "Zürich", "4711", "x,y"]) + "e" * r.randint(0, 3) for _ in range(30_000)))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", 0.5) for i, t in rows], "doc_id long, text string, row int, side string, a double")


@pytest.mark.parametrize("small", [False, True])
def test_align(spark, monkeypatch, small):
    if small:  # documents that go over many rows and slices, groups that are not spelled out, counts joined by a shuffle
        for name, value in (("ROW_EVENTS", 50), ("SLICE", 3000), ("SPELLED", 3)):
            monkeypatch.setattr(cross_tokenizer, name, value)
    rows = odd_rows()
    got = cross_tokenizer.align(table(spark, rows).repartition(3), A, B, texts=True, broadcast=0 if small else 1 << 20)
    same(got.collect(), expected(rows))


def test_align_of_empty_tables_and_text_ids(spark):
    assert cross_tokenizer.align(table(spark, []), A, B).collect() == []
    named = spark.createDataFrame([("x", "one two"), ("y", None)], "doc_id string, text string")
    same(cross_tokenizer.align(named, A, B, texts=True).collect(), expected([("x", "one two"), ("y", None)]))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    hashed = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in expected(rows)]
    same(queries.op13_cross_tokenizer(spark, path).collect(), hashed)
