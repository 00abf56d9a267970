"""Personal data against the rules' own patterns and a brute-force bootstrap, and the cases that every operator has to stand."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

from meridian.llm import personal_data, queries

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for place, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end()))
    return sorted(out)


def places(text):
    """(start, end, instance, seed, patterns)"""
    spans = base(text)
    found = [(s, e, True) for s, _, e in spans]
    for m in re.finditer(r"\S+", text or ""):
        s, e = m.span()
        while s < e and text[s] in personal_data._EDGE:
            s += 1
        while s < e and text[e - 1] in personal_data._EDGE:
            e -= 1
        if e - s >= 5 and re.search("[0-9@]", text[s:e]) and not any(a < e and s < b for a, _, b in spans):
            found.append((s, e, False))
    for s, e, seed in found:
        left = ["^", "^", *text[max(0, s - 72) : s].split()][-2:]
        right = [*text[e : e + 72].split(), "$", "$"][:2]
        left, right = ([re.sub("[1-9]", "0", w.lower()) for w in ws] for ws in ([w[-24:] for w in left], [w[:24] for w in right]))
        yield s, e, text[s:e], seed, [" ".join([*left, "_"]), " ".join(["_", *right]), f"{left[1]} _ {right[0]}"]


def expected(rows):
    seeds, edges = set(), defaultdict(set)
    for _, text in rows:
        for _, _, x, seed, patterns in places(text):
            for p in patterns:
                edges[p].add(x)
                if seed:
                    seeds.add((p, x))
    belief, accepted, n = defaultdict(float), {}, -1
    while len(accepted) > n:
        n = len(accepted)
        score = {p: [sum(1.0 if (p, x) in seeds else belief[x] for x in xs), len(xs)] for p, xs in edges.items()}
        accepted = {p: k / m for p, (k, m) in score.items() if k >= 3 and k / m >= 0.8}
        belief = defaultdict(float)
        for x in {x for xs in edges.values() for x in xs}:
            belief[x] = 1 - math.prod(1 - min(0.99, c) for p, c in accepted.items() if x in edges[p] and (p, x) not in seeds)
    for doc, text in rows:
        own = base(text)
        new = {(s, 4, e) for s, e, _, seed, patterns in places(text) if not seed and any(p in accepted for p in patterns)}
        write = lambda spans: ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        yield (doc, *(sum(k == i for _, k, _ in own) for i in range(4)), hashlib.sha256(write(own).encode()).hexdigest(), write([*own, *new]))


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0], r[1:]))


def planted():
    """Contexts with known and unknown identifiers, chained: `ring him on` leads to badges, whose other contexts follow."""
    r = random.Random(4)
    rows, word = [], lambda: "".join(r.choice("abcdeü") for _ in range(r.randint(2, 8)))
    fill = lambda n: " ".join(word() for _ in range(n))
    badge = [f"BX-{k}-77" for k in range(1000, 1004)]
    for i in range(12):
        rows.append(f"{fill(9)} please ring him on +1 (0{i + 10}) 555-77{i + 10} {fill(7)}")
    for b in badge[:2]:
        rows += [f"{fill(4)} ring him on {b} {fill(6)}", f"{fill(4)} visitor badge no {b}, {fill(6)}"]
    for i in range(12):
        rows.append(f"{fill(5)} visitor badge no 10.0.{i}.7 {fill(5)}")
    rows += [f"{fill(4)} visitor badge no {b} {fill(6)}" for b in badge[2:]]
    rows += [f"{fill(4)} was born in 19{i}5x {fill(6)}" for i in range(10, 30)]  # a context without seeds
    rows += [f"{fill(3)} room of {i}0000 {fill(3)}" for i in range(1, 9)] + [f"{fill(3)} room of a{i}@x.org {fill(3)}" for i in range(4)]
    return rows


def odd_rows():
    r = random.Random(1)
    bits = list("0123456789") + ["@", ".", "-", " ", "+", "(", ")", "a", "Zé", "x.org", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "+49 30 1234567", "\n", "漢", "_%", "..", "0001.2.3.4"]
    rows = ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(400)]
    rows += [None, "", "a@b.c@d.e", "a@b.c.d.@e.f", "1.2.3.4.5.6.7.8", "one two", "5555555555554444" * 3, "one two"]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(None if i == 3 else i // 2 * 2, t, 5, "x", True) for i, t in enumerate(rows)], "doc_id long, text string, row int, base string, seed boolean")


def found(df):
    from pyspark.sql import functions as F

    names = ["n_email", "n_ip", "n_card", "n_phone"]
    return ordered(df.select(df.columns[0], *names, F.sha2(F.encode(personal_data.written("base"), "UTF-8"), 256), personal_data.written("spans")).collect())


def test_find(spark):
    rows = planted() + odd_rows()
    docs = table(spark, rows)
    want = ordered(expected([(d.doc_id, d.text) for d in docs.collect()]))
    got = found(personal_data.find(docs.repartition(3)))
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]][:3] == []
    spans = " ".join(r[-1] for r in want)
    assert spans.count("identifier") >= 6  # the badges, where they are seen for the first time


def test_clean_contexts_stay_clean(spark):
    rows = list(enumerate(planted()))
    got = found(personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")))
    added = {r[0] for r in got if "identifier" in r[-1]}
    assert added == {i for i, t in rows if "BX-" in t}  # each badge, and neither years nor rooms


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "+1(" * 400_000, "1." * 800_000, "1 2-" * 400_000, "x " * 800_000 + "q9" * 10):
        spans = personal_data.base_spans(text)
        list(personal_data.instances(text, spans))
    assert time.time() - began < 30


def test_find_in_empty_tables_and_text_ids(spark):
    assert personal_data.find(table(spark, [])).collect() == []
    named = spark.createDataFrame([("x", "mail a@b.org"), ("y", None)], "doc_id string, text string")
    assert found(personal_data.find(named)) == ordered(expected([("x", "mail a@b.org"), ("y", None)]))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(queries.op12_personal_data(spark, path).collect()) == ordered(expected(rows))
