"""License scans: Aho-Corasick automata find notice phrases and identifier tags, and a shunting-yard parser evaluates the
and/or/with expressions behind the tags.

A text becomes its words, lower-cased and joined by single spaces, so that a phrase is found wherever its
words stand consecutively. Phrases give the base labels. A tag is followed by an expression such as
`(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0`, which is evaluated: `and` gives a label for each
side, as all hold; `or` gives one label for the choice, `apache-2.0 or mit`; `with` ties an exception to its licence.
The score says how sure a text's licence is: 1 - 0.5^k with k the weighted evidence, 1 for a phrase and 1 + 1 / c for a
tag, where c is how many choices its expression leaves. A tag's expression ends at the latest with its line or where the
next tag begins. A single word counts if it has a digit or stands alone; other words behind a tag are a sentence about tags.

Rows: null text has no words; no place means null first and last word, empty labels and score 0; null or
repeated ids are kept, one row out for each row in; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from meridian.llm.common import LOWER_TABLE, map_text, words

#: Phrases of notices and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases that only the method adds.
MORE_PHRASES = {
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
#: Fixed value: the words of the identifier tag "SPDX-License-Identifier:".
TAG = "spdx license identifier"
RAW_TAG = "spdx-license-identifier"
_LINE_END = re.compile(rb"[\r\n]")
_COLON = re.compile(rb"[ \t]*:")
#: Brackets, and words that end in a letter, a digit or a plus: punctuation behind them belongs to the sentence.
_LEXEME = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?")
#: What follows a word that stands alone: punctuation at most, then the line's end or a comment mark.
_ALONE = re.compile(r"[\s.,;:\"'`]*(?:$|\*/|/[*/]|--|#|%|\]\]|\*\))")
#: Binding strength of the operators.
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's lexemes in postfix order, or None if it does not parse."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for lexeme in _LEXEME.findall(expression):
        low = lexeme.lower()
        if low == "(":
            if not operand_next:
                return None
            held.append(low)
        elif low == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif low in _STRENGTH:
            if operand_next:
                return None
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(low)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def leading_expression(line: str) -> str:
    """The longest start of a tag's line that parses: prose may follow the expression. A single word counts if it has a digit, as
    versions do, an operator follows, or it stands alone; so `well-known format is used` is prose and `Minpack` a licence."""
    lexemes: list[str] = []
    best = depth = end = 0
    before = None
    operand_next = True
    for found in _LEXEME.finditer(line):
        lexeme = found.group()
        low = lexeme.lower()
        if operand_next != (low not in (")", *_STRENGTH)) or before is not None and line[before : found.start()].strip():
            break  # another order, or punctuation in between
        before = found.end()
        depth += (low == "(") - (low == ")")
        if depth < 0:
            break
        lexemes.append(lexeme)
        operand_next = low == "(" or low in _STRENGTH
        if depth == 0 and not operand_next:
            best, end = len(lexemes), found.end()
    words = [x for x in lexemes[:best] if x not in "()"]
    if len(words) == 1 and len(lexemes) == best and not any(c.isdigit() for c in words[0]) and not _ALONE.match(line, end):
        return ""
    return " ".join(lexemes[:best])


def evaluated(expression: str) -> tuple[set[str], int] | None:
    """The labels that all hold, and how many different choices are left; or None if the expression does not parse. A choice is
    written with its sides in order, and with brackets around a side on which several hold. The smaller set goes into the
    larger, so that long expressions take about as long as they are."""
    order = postfix(expression)
    if order is None:
        return None
    # labels that hold, sides of a choice with the choices that each leaves if this is one, and the choices of the labels
    stack: list[tuple[set[str], dict[str, int], int]] = []
    for item in order:
        if item not in _STRENGTH:
            stack.append(({item}, {}, 1))
            continue
        (b, b_sides, n), (a, a_sides, m) = stack.pop(), stack.pop()
        if item == "with":
            stack.append(({f"{_side(a, a_sides)} with {_side(b, b_sides)}"}, {}, _choices(a_sides, m)))
        elif item == "and":
            more, less = sorted((_whole(a, a_sides), _whole(b, b_sides)), key=len, reverse=True)
            more |= less
            stack.append((more, {}, max(_choices(a_sides, m), _choices(b_sides, n))))
        else:
            more, less = sorted((a_sides or {_side(a, {}): m}, b_sides or {_side(b, {}): n}), key=len, reverse=True)
            more |= less
            stack.append((set(), more, 1))
    labels, sides, n = stack[0]
    return _whole(labels, sides), _choices(sides, n)


def _choices(sides: dict[str, int], otherwise: int) -> int:
    return sum(sides.values()) or otherwise


def _side(labels: set[str], sides: dict[str, int]) -> str:
    """One side of an operator as text."""
    if len(sides) > 1:
        return f"({' or '.join(sorted(sides))})"
    if sides:
        return next(iter(sides))
    if len(labels) == 1:
        return next(iter(labels))
    return f"({' and '.join(sorted(f'({x})' if ' or ' in x else x for x in labels))})"


def _whole(labels: set[str], sides: dict[str, int]) -> set[str]:
    return {" or ".join(sorted(sides))} if sides else labels


@lru_cache(maxsize=1)
def tag_automaton():
    found = ahocorasick.Automaton()
    found.add_word(RAW_TAG, len(RAW_TAG))
    found.make_automaton()
    return found


def tag_lines(data: bytes):
    """What follows each identifier tag and its colon, up to the line's end or the next tag. The tag's words without a colon, as in
    prose about tags, are none."""
    ends = [end + 1 for end, _ in tag_automaton().iter(data.translate(LOWER_TABLE).decode("latin-1"))]
    for k, start in enumerate(ends):
        after = ends[k + 1] - len(RAW_TAG) if k + 1 < len(ends) else len(data)
        if colon := _COLON.match(data, start, after):
            line_end = _LINE_END.search(data, colon.end(), after)
            yield data[colon.end() : line_end.start() if line_end else after]


@lru_cache(maxsize=4)
def automaton(phrases: tuple[tuple[str, str, bool], ...]):
    found = ahocorasick.Automaton()
    for phrase, label, base in phrases:
        found.add_word(f" {phrase} ", (len(phrase) + 1, label, base))
    found.make_automaton()
    return found


def scan(data: bytes, find) -> dict[str, object]:
    own = words(data)
    text = (b" " + b" ".join(own) + b" ").decode("latin-1") if own else ""
    base, more, starts = set(), set(), []
    evidence, tagged, at, word = 0.0, False, 0, -1
    hits = sorted((end - back, label, is_base) for end, (back, label, is_base) in find.iter(text))
    for place, label, is_base in hits:
        word += text.count(" ", at, place + 1)  # the words before: each has a space in front
        at = place + 1
        if label is None:
            tagged = True
            continue
        evidence += 1
        more.add(label)
        if is_base:
            base.add(label)
            starts.append(word)
    if tagged:
        for line in tag_lines(data):
            parsed = evaluated(leading_expression(line.decode("utf-8", "replace")))
            if parsed:
                more |= parsed[0]
                evidence += 1 + 1 / parsed[1]
    return {
        "n_words": len(own),
        "n_base": len(starts),
        "first_word": starts[0] if starts else None,
        "last_word": starts[-1] if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(more)),
        "score": 1.0 - 0.5 ** min(evidence, 1000),
    }


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text."""
    phrases = tuple(
        [(p, label, True) for p, label in BASE_PHRASES.items()] + [(p, label, False) for p, label in MORE_PHRASES.items()] + [(TAG, None, False)]
    )
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def make():
        find = automaton(phrases)

        def fn(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
            rows = [scan(t, find) for t in texts]
            return {id_col: ids} | {n: [r[n] for r in rows] for n in names}

        return fn

    schema = f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_text(docs, id_col, text_col, schema, make)
