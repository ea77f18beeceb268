"""Toxicity: the kernel against its definition, and accuracy on rows that gave no labels."""

from itertools import combinations

import numpy as np

from isomesh.llm import strings, toxic
from tests.llm.helpers import SMALL, odd_documents, small_documents


def plain_kernel(a, b):
    def weights(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < strings.SPAN:
                u = word[i] + word[j] + word[k]
                out[u] = out.get(u, 0) + strings.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_is_as_defined():
    words = ["idiot", "idxiot", "idiiot", "patient", "pathetic", "banana", "aaaaaa", "loser", "closer", "tion"]
    marks = strings.Landmarks(words, len(words), 0.0)
    near, values = marks.values(words)
    expected = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert near.tolist() == list(range(len(words))) and np.allclose(values, expected, atol=1e-5)
    assert abs(strings.kernel("idiot", "idxiot") - plain_kernel("idiot", "idxiot")) < 1e-9
    floored = strings.Landmarks(words, 3, 0.6)
    near, values = floored.values(words)
    assert near.tolist() == [i for i in range(len(words)) if expected[i, :3].max() >= 0.6]
    assert np.allclose(values, np.where(expected[near] >= 0.6, expected[near], 0), atol=1e-5)


def test_letters():
    assert [strings.letters(t) for t in ("Idiot!", "1d10t", "i*d*i*o*t,", "***", "p@thetic")] == ["idiot", "idiot", "idiot", "", "pathetic"]


def test_inserted_characters_and_spelt_words(spark):
    clean = [f"you are an old friend and everyone near river {i} knows the quiet town and house {i % 7}" for i in range(60)]
    bad = [f"you are an {w} and everyone near river {i} knows" for i, w in enumerate(["idiot", "moron", "pathetic loser"] * 12)]
    machine = toxic.fit(clean + bad, np.array([False] * 60 + [True] * 36))
    for text in ("what an idiot", "what an idxiot", "what an i.d.i.o.t", "such an i d i o t here", "an idiiot", "a m0r0n", "p-a-t-h-e-t-i-c"):
        assert machine.probability([text])[0] >= toxic.THRESHOLD, text
    assert (machine.probability(["", "the river near town", "a quiet idea", "patient people"]) < toxic.THRESHOLD).all()


def test_held_out_accuracy(spark):
    sf = SMALL.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxic.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxic.THRESHOLD) for r in rows)
    out = [r for r in rows if r.held_out]
    hits = [r.score for r in out if r.toxic]
    others = [r.score for r in out if not r.toxic]
    auc = np.mean([(h > o) + (h == o) / 2 for h in hits for o in others])
    assert len(hits) > 50 and auc > 0.9
    # Of held-out labels nothing is learnt.
    docs = docs.where("doc_id < 300")
    labels = labels.where("doc_id < 300")
    before = {r.doc_id: r.score for r in toxic.score(docs, labels).collect()}
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxic.score(docs, turned).collect()}
    assert again == before


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = odd_documents(spark, [None, "", "idiot " * 20000, "x" * 50000, "é 𝒳"])
    assert toxic.score(odd, labels).count() == 6
    assert toxic.score(odd, labels.where("false")).where("score = 0").count() == 6
    assert toxic.score(small_documents(spark).where("false"), labels).count() == 0
