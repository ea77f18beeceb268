"""Near-duplicate classes against all pairs, and signatures against exact similarities."""

from collections import Counter

import numpy as np

from isomesh.llm import bags, near
from tests.llm.helpers import odd_documents, small_documents


def bag(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_force(rows):
    """Class ids by all pairs of distinct texts."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    distinct = sorted({r[1] for r in rows})
    all_bags = [bag(t) for t in distinct]
    for i, a in enumerate(all_bags):
        for j in range(i):
            if a and all_bags[j] and similarity(a, all_bags[j]) >= 0.8:
                parent[find(distinct[i])] = find(distinct[j])
    heads = {}
    for doc_id, text in rows:
        heads.setdefault(find(text), []).append(doc_id)
    return sorted((str(d), str(min((x for x in heads[find(t)] if x is not None), default=None))) for d, t in rows)


def variants(base, n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(len(words)))] = f"w{rng.integers(99)}"
        out.append(" ".join(words))
    return out


def cases(spark):
    rng = np.random.default_rng(0)
    words = [f"v{i}" for i in range(400)]
    texts = [None, "", " ", "a", "a", "a b c d", "a b c d e", "a b a b a b a b a b a b", "x y " * 300, "x y " * 290, "é𝒳 " * 50]
    for k in range(6):
        texts += variants(" ".join(rng.choice(words, 180)), 14, k)
    passage = " ".join(rng.choice(words, 60))
    texts += [f"{passage} {' '.join(rng.choice(words, 12))}" for _ in range(25)]
    docs = odd_documents(spark, texts).select("doc_id", "text", "score", "kept")
    return docs.unionByName(small_documents(spark).selectExpr("doc_id + 1000 as doc_id", "text"), allowMissingColumns=True)


def test_classes_equal_brute_force(spark):
    docs = cases(spark).cache()
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near.report(docs).collect())
    assert got == brute_force([(r.doc_id, r.text or "") for r in docs.collect()])


def test_one_of_each_class_stays(spark):
    docs = cases(spark).cache()
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    expected = brute_force([(r.doc_id, r.text or "") for r in docs.collect()])
    ids = sorted(str(r.doc_id) for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for _, c in expected} - {"None"})


def test_large_bands_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    docs = cases(spark).cache()
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near.report(docs).collect())
    assert got == brute_force([(r.doc_id, r.text or "") for r in docs.collect()])


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    elements = near.mixed(np.arange(1, 301, dtype=np.uint64))
    errors = []
    for _ in range(30):
        w = rng.integers(0, 7, (2, 300))
        sig = []
        for x in w:
            has = np.flatnonzero(x)
            sig.append(bags.signatures(elements[has], x[has].astype(float), np.zeros(len(has), dtype=np.int64), 1, 1024)[0])
        errors.append((sig[0] == sig[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum())
        elements = near.mixed(elements)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.025


def test_empty_table(spark):
    docs = small_documents(spark).where("false")
    assert near.report(docs).count() == near.keep_one(docs).count() == 0


def test_a_large_band_needs_no_second_one(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    bag_of = lambda *xs: np.array(sorted(xs), np.uint32).tobytes()
    node = lambda i: bytes([i])
    # Eight nodes of one component that overlap nothing, two pairs of alike ones: all share one band only.
    bags_ = [(node(i), bag_of(*range(100 * i, 100 * i + 10))) for i in range(8)] + [(node(i), bag_of(*range(9000 + 100 * (i // 2), 9009 + 100 * (i // 2)), 7777 + i)) for i in range(10, 14)]
    members = spark.createDataFrame([(1, n, node(0) if n < node(8) else n, 10) for n, _ in bags_], "key bigint, node binary, label binary, size bigint")
    found = near.across(members, spark.createDataFrame(bags_, "node binary, bag binary")).collect()
    assert {(bytes(r.a), bytes(r.b)) for r in found} == {(node(10), node(11)), (node(12), node(13))}
