"""Conversation repair against a brute-force version, and the cases that every operator has to stand."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from meridian.llm import conversation_repair, queries

SPACE = " \t\n\x0b\x0c\r"
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(fate, 1)):
            yield conv, turn, role, text


def cheapest(rows):
    """Dijkstra's search over (rows done, state), ordered by cost and audit, so that the first end found is the answer."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        for to in FOLLOW[state]:
            if to in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", at, to, (*lines, ("user:" if to == "u" else "assistant:"))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for to in FOLLOW[state]:
                    if role[:1] == to:
                        heapq.heappush(heap, (cost + more, audit + "K", at + 1, to, (*lines, f"{role}:{text}")))
                    if to in "ua":
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, to, (*lines, f"{'user' if to == 'u' else 'assistant'}:{text}")))


def expected(rows):
    found = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        found[conv].append((turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        seen, faults, edits = set(), defaultdict(int), []
        for _, _, _, role, text in own:
            end = text.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            edits.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(edits, edits[1:], strict=False))
        cost, audit, lines = cheapest(edits)
        yield conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0]))


def odd_rows():
    r = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(r.randint(1, 9)):
            turn = r.choice([turn, turn, turn, turn + 2, None, 0])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = r.choice(["Hello.", "And so", "Why? \n", "", " \t", None, "Yes!", "é漢.", f"{turn}."])
            rows += [(conv, turn, role, text)] * r.choice([1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, key double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)


def repaired(table):
    return by_id(conversation_repair.repair(conversation_repair.damage(table), table).collect())


def test_repair_of_odd_rows(spark):
    rows = odd_rows()
    assert repaired(table(spark, rows).repartition(3)) == by_id(expected(rows))


def test_repair_of_long_conversations(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant", "assistant"]), r.choice(["Yes.", "no", f"{t}!"])) for t in range(5000)]
    rows += [(8, 3, "user", f"{t}.") for t in range(200)]  # one turn, many texts
    rows += [(9, None, "user", "Same.")] * 300 + [(9, 1, "assistant", "long. " * 300_000)]
    assert repaired(table(spark, rows)) == by_id(expected(rows))


def test_repair_of_empty_tables_and_text_ids(spark):
    assert repaired(table(spark, [])) == []
    rows = [(f"c{i}", t, ["user", "assistant"][t % 2], "Yes.") for i in range(9) for t in range(i)]
    named = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert repaired(named) == by_id(expected(rows))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_id(queries.op11_conversation_repair(spark, path).collect()) == by_id(expected(rows))
