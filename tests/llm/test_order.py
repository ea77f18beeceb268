"""Order MinHash against a plain version, and the pairing of documents with the next."""

import hashlib

import numpy as np

from isomesh.llm import order
from tests.llm.helpers import odd_documents, small_documents

TEXTS = [None, "", "a", "ab", "abcdef", "aaaaaaaaaaaa", "é𝒳 " * 9, "x" * 500 + "y", "the quick brown fox jumps over the lazy dog " * 3, "same", "same", "z" * 30000]


def plain(text):
    """Occurrence-numbered k-mers, the two smallest of each permutation, in the order of the text."""
    kmers = order.numbered_kmers(text)
    seen, grams = {}, []
    for i in range(max(1, len(text) - order.K + 1)):
        g = text[i : i + order.K]
        grams.append((g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert len(set(grams)) == len(set(kmers.tolist())) or not text  # equal numbered k-mers have equal hashes, others differ
    out = []
    for s, f in zip(order.SEEDS.tolist(), order.FACTORS.tolist(), strict=True):
        ranked = sorted(range(len(kmers)), key=lambda i: ((int(kmers[i]) ^ s) * f & 0xFFFFFFFF, i))[:2]
        out.append(tuple(grams[i] for i in sorted(ranked)))
    return out


def test_components_agree_as_the_plain_version():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "beta beta", "epsilon"]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(8)] + [t for t in TEXTS if t and len(t) < 1000]
    for a in texts:
        for b in texts:
            expected = np.mean([x == y for x, y in zip(plain(a), plain(b), strict=True)])
            assert order.likeness(order.fingerprint(a), order.fingerprint(b)) == expected


def test_order_matters():
    rng = np.random.default_rng(1)
    words = [f"{rng.integers(10**9)}" for _ in range(60)]
    text, turned = " ".join(words), " ".join(words[30:] + words[:30])
    assert order.likeness(order.fingerprint(text), order.fingerprint(turned)) < 0.8
    assert order.likeness(order.fingerprint(text), order.fingerprint(text + "x")) > 0.8


def test_pairs_and_edits(spark):
    docs = odd_documents(spark, TEXTS).select("doc_id", "text", "score").unionByName(small_documents(spark).selectExpr("doc_id + 100 as doc_id", "text"), allowMissingColumns=True)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (order.fingerprint(x) for x in (text, edited, following))
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), order.as_text(a), order.as_text(b), order.likeness(a, b), order.likeness(a, c)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, order.report(docs).collect()), key=key) == sorted(expected, key=key)


def test_one_row_and_none(spark):
    docs = small_documents(spark)
    one = order.report(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert order.report(docs.where("false")).count() == 0
    assert order.fingerprints(docs).select("fingerprint").distinct().count() == docs.select("text").distinct().count()
