"""Licences of texts: identifier tags with their expressions, and phrases of notices.

Two automata (Aho-Corasick) read each text once: one over its words finds phrases, wherever lines break or signs stand
between the words; one over its letters finds tags such as ``SPDX-License-Identifier:``. What follows a tag is an
expression of licences with and, or, with and parentheses, which a shunting-yard parser turns into postfix order: the
longest well-formed stretch counts. It is worth the freest choice of an or, the strictest part of an and, and an
exception after with makes a strong copyleft a weak one. Texts are handled by themselves: no shuffle, no broadcast.

Defined results: null text counts as empty; an empty text has no words, no labels and score 0. Equal texts give equal
rows; repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from isomesh.llm.work import strings, texts

#: Phrases whose words, standing consecutively, are base places, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of public licences and their notices.
NOTICES = {
    "mit licence": "mit", "apache licence": "apache", "general public licence": "gpl",
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl",
    "bsd license": "bsd", "isc license": "isc", "zlib license": "zlib", "artistic license": "artistic", "boost software license": "bsl", "unlicense org": "unlicense",
    "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl",
    "cc0 1 0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "creative commons zero": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:", "license:", "licence:", '"license":', '"licence":')
#: Beginnings of identifiers and their labels; the longest that fits counts.
FAMILIES = {
    "mit": "mit", "mit-0": "mit", "x11": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "apache-": "apache", "gpl-": "gpl", "lgpl-": "lgpl", "agpl-": "agpl", "bsd-": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "bsl-": "bsl", "unlicense": "unlicense",
    "mpl-": "mpl", "epl-": "epl", "eupl-": "eupl", "artistic-": "artistic", "cc0-": "cc0", "cc-by-4": "cc-by", "cc-by-3": "cc-by", "cc-by-sa-": "cc-by-sa", "cc-by-nc-": "cc-by-nc", "cc-by-nd-": "cc-by-nd", "cc-by-nc-sa-": "cc-by-nc-sa", "cc-by-nc-nd-": "cc-by-nc-nd", "licenseref-": "other",
}
#: How freely what stands under a licence may be used.
FREEDOM = {
    **dict.fromkeys(("cc0", "unlicense"), 1.0), **dict.fromkeys(("mit", "apache", "bsd", "isc", "zlib", "bsl", "cc-by"), 0.9), **dict.fromkeys(("lgpl", "mpl", "epl", "eupl", "artistic"), 0.6),
    **dict.fromkeys(("gpl", "cc-by-sa"), 0.4), "agpl": 0.3, **dict.fromkeys(("cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"), 0.1), "reserved": 0.0, "other": 0.0,
}
#: What an exception makes of a copyleft.
EXCEPTED = 0.6
#: How sure each kind of evidence makes us that a text states its licence: a base phrase, a notice, a tag's expression.
SURE = {"base": 0.5, "notice": 0.6, "tag": 0.9}
BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[\x20\t\"']*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:+-]*))")
#: Every byte that no word has becomes a blank; capitals of ASCII are lowered before.
BLANKS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))


@cache
def phrases() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for base, of in ((True, BASE), (False, NOTICES)):
        for phrase, label in of.items():
            out.add_word(f" {phrase} ", (base, label, len(phrase) + 1))
    out.make_automaton()
    return out


@cache
def tags() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for tag in TAGS:
        out.add_word(tag, len(tag))
    out.make_automaton()
    return out


def family(identifier: str) -> str | None:
    """The label of a licence identifier; None if it is not known as one."""
    low = identifier.lower()
    fits = [k for k in FAMILIES if (low.startswith(k) if k.endswith("-") else low == k or low.startswith(k + "."))]
    return FAMILIES[max(fits, key=len)] if fits else None


class Expression(NamedTuple):
    """A parsed expression: its tokens in postfix order and as they stood."""

    postfix: tuple[str, ...]
    tokens: tuple[str, ...]

    def labels(self) -> set[str]:
        """Of all licences named; exceptions are none."""
        stack: list[set[str]] = []
        for t in self.postfix:
            if t in BINDS:
                right, left = stack.pop(), stack.pop()
                stack.append(left if t == "with" else left | right)
            else:
                stack.append({family(t)} - {None})
        return stack[0]

    def freedom(self) -> float:
        stack: list[float] = []
        for t in self.postfix:
            if t in BINDS:
                right, left = stack.pop(), stack.pop()
                stack.append(max(left, right) if t == "or" else min(left, right) if t == "and" else max(left, EXCEPTED))
            else:
                stack.append(FREEDOM.get(family(t) or "other", 0.0))
        return stack[0]


def parse(text: str, at: int) -> Expression | None:
    """The longest well-formed expression that begins at a place and names licences that are known."""
    out, waiting, tokens = [], [], []
    whole = None  # how much of each there was when the expression was last complete
    value_next, after_with, depth = True, False, 0
    while m := TOKEN.match(text, at):
        sign, word = m.groups()
        low, ended = (word or sign).lower(), False
        if value_next:
            if low == "(" and not after_with:
                waiting.append(low)
                depth += 1
            elif word and low not in BINDS and (after_with or family(word.rstrip(".:"))):
                # A full stop ends the sentence.
                word, ended = word.rstrip(".:"), word[-1] in ".:"
                out.append(word)
                value_next = after_with = False
            else:
                break
        elif low in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            value_next, after_with = True, low == "with"
        elif low == ")" and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        else:
            break
        tokens.append(low.upper() if low in BINDS else word or sign)
        at = m.end()
        if not value_next and not depth:
            whole = len(out), tuple(waiting), len(tokens)
        if ended:
            break
    if not whole:
        return None
    return Expression((*out[: whole[0]], *reversed(whole[1])), tuple(tokens[: whole[2]]))


LOWER = {c: c + 32 for c in range(65, 91)}


def expressions(text: str) -> list[Expression]:
    """What stands after the tags of a text, in order."""
    low = text.translate(LOWER)
    inside = lambda last, n: last >= n and low[last - n].isalnum()  # within a longer word
    return [e for last, n in tags().iter(low) if not inside(last, n) and (e := parse(text, last + 1))]


class Found(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    expressions: list[str]
    freedom: float | None


def scan(text: str) -> Found:
    """All that the report says of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(BLANKS).split()
    # A character for each byte: phrases are ASCII, and bytes of other characters never look like it.
    line = f" {b' '.join(words).decode('latin-1')} "
    places, base, notices = [], set(), set()
    word = upto = 0
    ends = sorted((last - n, is_base, label) for last, (is_base, label, n) in phrases().iter(line))
    for start, is_base, label in ends:
        if is_base:
            word, upto = word + line.count(" ", upto, start), start
            places.append(word)
            base.add(label)
        else:
            notices.add(label)
    found = expressions(text) if "licen" in line else []
    tagged = set().union(*(e.labels() for e in found))
    unsure = 1.0
    for kind, some in (("base", base), ("notice", notices), ("tag", tagged)):
        unsure *= 1 - SURE[kind] if some else 1
    stated = [e.freedom() for e in found] or [FREEDOM[x] for x in base | notices]
    shown = lambda e: " ".join(e.tokens).replace("( ", "(").replace(" )", ")")
    return Found(len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(base | notices | tagged)), round(1 - unsure, 6), [shown(e) for e in found], min(stated, default=None))


COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string()), "freedom": pa.float64()}


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t) for t in strings(batch.column("text"))]
        columns = list(zip(*rows, strict=True)) or [[]] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, COLUMNS.values(), strict=True))], ["doc_id", *COLUMNS])


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: words and places of base phrases, labels, how sure they are; the expressions found
    and the freedom that the strictest of them leaves."""
    return texts(docs).mapInArrow(scan_batches, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>, freedom double")
