"""Operator 8: licence scans.

An Aho-Corasick automaton over normalised words finds notice phrases and identifier tags; a shunting-yard parser evaluates the
and / or / with expression that follows a tag in the text. Texts are scanned whole, row by row, in Arrow batches; nothing is
shuffled.

Each licence has a restrictiveness from 0 (public domain) to 1 (all rights reserved). In an expression "and" takes the more
restrictive side, "or" the freer one, and "with" an exception halves what lies above permissive. A document's score is the
highest value of its findings: how much its licences restrict use.

Defined cases: null counts as empty; a text without findings has n_base 0, null first and last words, empty labels and score 0;
an expression that doesn't parse counts its known identifiers joined by "and"; overlapping places all count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ductwork.llm.common import small_batches
from ductwork.llm.tokens import ALNUM, LOWER, bounds, raw, slices

#: The contract's base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and labels.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "the mit license": "mit",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl-1.0",
    "this is free and unencumbered software": "unlicense",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0-1.0",
}
#: How much a licence restricts use; the longest prefix of an identifier counts.
RESTRICTS = {
    "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.1, "bsd": 0.1, "isc": 0.1, "apache": 0.1, "zlib": 0.1, "bsl": 0.1,
    "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.8, "cc-by-nd": 0.8,
    "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.9, "reserved": 1.0,
}
UNKNOWN = 0.6
#: The words of the tag before a licence expression.
TAG = "spdx license identifier"
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
BLANKS = re.compile(r"[ \t]*")
#: A word; and what may stand between the tag and its expression.
WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
AFTER_TAG = re.compile(r"[^A-Za-z0-9\x80-\U0010ffff\n(]*")
BINDS = {"or": 1, "and": 2, "with": 3}


def restricts(name: str) -> float:
    """The value of the longest known prefix of an identifier."""
    known = [k for k in RESTRICTS if name == k or name.startswith((k + "-", k + ".", k + "+"))]
    return RESTRICTS[max(known, key=len)] if known else UNKNOWN


def evaluate(expression: str, at: int = 0) -> tuple[float, list[str]]:
    """Value and identifiers of the licence expression from a place on, by the shunting-yard method; it ends where its grammar does, or its line.

    Operators are and, or, with in any case; with binds most tightly, or least."""
    values: list[float] = []
    waiting: list[str] = []
    names: list[str] = []
    operand, depth, good = True, 0, True

    def apply() -> None:
        op, right, left = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(min(left, 0.1 + (left - 0.1) / 2))
        else:
            values.append(max(left, right) if op == "and" else min(left, right))

    while m := TOKEN.match(expression, BLANKS.match(expression, at).end()):
        word = m[0].lower()
        if operand:
            if word == "(":
                waiting.append(word)
                depth += 1
            elif word in BINDS or word == ")":
                good = False
                break
            else:
                word = word.rstrip(".")
                excepted = bool(waiting) and waiting[-1] == "with"
                values.append(0.0 if excepted else restricts(word))
                if not excepted:
                    names.append(word)
                operand = False
        elif word in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word]:
                apply()
            waiting.append(word)
            operand = True
        elif word == ")" and depth:
            while waiting[-1] != "(":
                apply()
            waiting.pop()
            depth -= 1
        else:
            break
        at = m.end()
        if m[0].endswith(".") and not operand and not depth:
            break
    if good and not operand and not depth:
        while waiting:
            apply()
        return values[-1], names
    return max((restricts(x) for x in names), default=0.0), names


def automaton() -> ahocorasick.Automaton:
    """Phrases between blanks, so that only whole words match; each with its kind, label and number of words."""
    found = ahocorasick.Automaton()
    phrases: dict[str, list[tuple[str, str]]] = {}
    for kind, more in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in more.items():
            phrases.setdefault(phrase, []).append((kind, label))
    for phrase, what in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, what))
    found.make_automaton()
    return found


def scan_text(text: str, words: str, found: ahocorasick.Automaton) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Findings of one text. words: its words between single blanks, lower-cased.

    Returns the number of base places, their first and last word, the base labels, all labels and the score."""
    n_base, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    ends = None  # of the text's words
    seen, at = 0, 0  # words before position at
    hits = sorted((end - size + 1, what) for end, (size, what) in found.iter(words))
    for start, what in hits:
        seen += words.count(" ", at, start)
        at = start
        for kind, label in what:
            if kind == "base":
                n_base, first, last = n_base + 1, seen if first is None else first, seen
                base.add(label)
            if kind == "tag":
                ends = ends if ends is not None else [m.end() for m in WORD.finditer(text)]
                begin = AFTER_TAG.match(text, ends[seen + TAG.count(" ")]).end()
                value, names = evaluate(text, begin)
                labels.update(names)
                score = max(score, value)
            else:
                labels.add(label)
                score = max(score, restricts(label))
    return n_base, first, last, base, labels, score


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    small_batches(docs.sparkSession)
    chars = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = raw(batch.column(1))
                starts, _, rows = bounds(data, at, ALNUM)
                n_words = np.bincount(rows, minlength=batch.num_rows)
                clean = chars[data]
                blank = clean == 0x20
                keep = np.ones(len(data), bool)
                keep[1:] &= ~(blank[1:] & blank[:-1])
                edges = at[1:-1][at[1:-1] < len(data)]
                keep[edges] = True
                body, places = clean[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[at]
                source = data.tobytes()
                out = []
                for r in range(batch.num_rows):
                    words = f" {body[places[r] : places[r + 1]].decode().strip(' ')} "
                    out.append(scan_text(source[at[r] : at[r + 1]].decode(), words, found) if found_any(found, words) else NOTHING)
                n, first, last, base, labels, score = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score, pa.float64())],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


NOTHING = (0, None, None, (), (), 0.0)


def found_any(found: ahocorasick.Automaton, words: str) -> bool:
    return next(found.iter(words), None) is not None
