"""Licences against plain searches and a recursive evaluation of expressions."""

import random
import re

import pytest

from isomesh.llm import licences
from tests.llm.helpers import SCHEMA, odd_documents, small_documents

ODD = [
    None, "", " ", "MIT License", "mit-license, MIT\nLICENSE; mit license license mit", "xmit license mit licensee mitlicense", "Apache\u00a0License apache é license", "GNU Lesser General Public License v3, general public license",
    "MİT LİCENSE K license", "general public general public license", "the mit license " * 3000, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nprint()", "License: MIT.", "license: see below", '{"license": "BSD-3-Clause"}',
    "Permission is hereby granted, free of charge, to any person\n# obtaining a copy", "licence: (MIT OR GPL-3.0", "x" * 100000, "((" * 20000 + " license: " + "(" * 20000 + "MIT" + ")" * 20000, "license: MIT OR see the file", "relicense: MIT",
]


def plainly(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    places = sorted((i, label) for p, label in base.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_places(spark):
    docs = odd_documents(spark, ODD).select("doc_id", "text").union(small_documents(spark).select("doc_id", "text"))
    got = licences.report(docs).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(g[:6]) for g in got), key=key) == sorted(((r.doc_id, *plainly(r.text)) for r in docs.collect()), key=key)
    for g in got:
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
        assert (g.score > 0) == (g.labels != "")
        assert g.labels.split(",") == sorted(set(g.labels.split(",")))


def test_tags_and_notices():
    of = lambda i: licences.scan(ODD[i])
    assert of(11).expressions == ["(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"]
    assert of(11).labels == "apache,gpl,mit" and of(11).freedom == licences.EXCEPTED and of(11).n_base == 0
    assert of(12).expressions == ["MIT"] and of(13).expressions == [] and of(14).labels == "bsd"
    assert of(15).labels == "mit" and of(15).base_labels == ""
    assert of(16).expressions == [] and of(19).expressions == ["MIT"] and of(20).expressions == []
    assert of(7).labels == "gpl,lgpl" and of(7).n_base == 2
    assert of(18).labels == "mit"
    assert licences.scan("Licensed under CC BY-NC 4.0.").labels == "cc-by,cc-by-nc"


def written_out(tree, rng):
    """A random way to write a tree, with the parentheses that it needs and some more."""
    if isinstance(tree, str):
        return f"({tree})" if rng.random() < 0.1 else tree
    op, left, right = tree
    if op == "with":
        return f"{left} WITH {right}"
    sides = [f"({s})" if isinstance(t, tuple) and t[0] != "with" and (op == "and" and t[0] == "or" or rng.random() < 0.2) else s for t in (left, right) for s in [written_out(t, rng)]]
    return f" {rng.choice([op, op.upper()])} ".join(sides)


def value(tree):
    if isinstance(tree, str):
        return licences.FREEDOM[licences.family(tree)]
    op, left, right = tree
    if op == "with":
        return max(value(left), licences.EXCEPTED)
    return (max if op == "or" else min)(value(left), value(right))


def named(tree):
    if isinstance(tree, str):
        return {licences.family(tree)}
    return named(tree[1]) if tree[0] == "with" else named(tree[1]) | named(tree[2])


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        leaf = rng.choice(["MIT", "Apache-2.0", "GPL-2.0+", "AGPL-3.0-only", "MPL-2.0", "CC-BY-NC-4.0", "LicenseRef-own"])
        return ("with", leaf, "Some-exception") if rng.random() < 0.2 else leaf
    return (rng.choice(["and", "or"]), grown(rng, depth - 1), grown(rng, depth - 1))


@pytest.mark.parametrize("seed", range(200))
def test_expressions_against_a_recursive_evaluation(seed):
    rng = random.Random(seed)
    tree = grown(rng, 4)
    found = licences.parse(f" {written_out(tree, rng)}", 0)
    assert found.freedom() == value(tree) and found.labels() == named(tree)


def test_what_is_no_expression():
    for text in ("", " ", "()", "AND MIT", "(MIT", "WITH x", "not known", "OR", ")", "MIT-like"):
        assert licences.parse(text, 0) is None, text
    for text, n in (("MIT AND", 1), ("MIT OR (GPL-2.0", 1), ("MIT) OR ISC", 1), ("MIT OR ISC nothing", 3), ("MIT Apache-2.0", 1), ("GPL-2.0 WITH (x)", 1)):
        assert len(licences.parse(text, 0).tokens) == n, text


def test_empty_table(spark):
    assert licences.report(spark.createDataFrame([], SCHEMA)).count() == 0
