"""Toxicity: a support vector machine over a subsequence string kernel, approximated by Nyström landmarks.

Words are compared with landmark words by the kernel of ``strings``, which tolerates gaps and inserted characters.
A sentence has, for each landmark, its nearest word's value; the Nyström map turns these values into features in
which the kernel is a dot product. A linear machine with squared hinge loss is trained on the labelled sentences:
all sentences of clean documents, and of each toxic one the sentence that the machine so far finds worst. A
document scores as its worst sentence, scaled to a probability on the training documents.

The machine is fitted on MOST_LABELLED labelled documents at most, those with the smallest hashes of their ids;
every document is scored over its whole text. Labels come only from rows whose crc32(doc_id as text) mod 4 is not
2; language, source and id are no inputs.

Defined results: null text counts as empty; a text without a word near a landmark has the machine's lowest score.
Null ids are not held out and have no label. Conflicting labels of an id count as toxic. Repeated rows each give a
row. Extra columns are ignored. Without toxic or without clean labels, all scores are the share of toxic labels
(0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isomesh.llm.strings import Landmarks, letters, parts
from isomesh.llm.work import chosen, runs, texts

#: Production parameters. FLOOR: kernel values below it count as 0. THRESHOLD: of the score, for predicted.
MOST_LABELLED, LANDMARKS, FLOOR, THRESHOLD = 6000, 96, 0.55, 0.3
CHUNK, KEPT = 4_000_000, 300_000
SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)|\n")
#: Single letters in a row, read as one word.
SPELT = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")


class Machine:
    """Landmarks and a linear machine on the Nyström features; gives the probability of the worst sentence."""

    def __init__(self, landmarks: Landmarks | None, weights: np.ndarray, bias: float, slope: float, shift: float, constant: float = 0.0):
        self.landmarks, self.weights, self.bias, self.slope, self.shift, self.constant = landmarks, weights, bias, slope, shift, constant
        self.known: dict[str, np.ndarray | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def learn_words(self, tokens: set[str]) -> None:
        """Kernel values of new tokens, at once."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(tokens.difference(self.known))
        self.known.update(dict.fromkeys(new))
        for a in range(0, len(new), 20000):
            words, of = [], []
            for t in new[a : a + 20000]:
                for p in parts(letters(t)):
                    if len(p) >= 3:
                        words.append(p)
                        of.append(t)
            if words:
                near, values = self.landmarks.values(words)
                for i, v in zip(near, values, strict=True):
                    old = self.known[of[i]]
                    self.known[of[i]] = v if old is None else np.maximum(old, v)

    def sentences(self, texts_: list[str]) -> list[np.ndarray]:
        """For each text the values of its sentences that have a word near a landmark."""
        split = [t.lower().split() for t in texts_]
        spelt = [[m[0].replace(" ", "") for m in SPELT.finditer(t.lower())] for t in texts_]
        self.learn_words(set().union(*split, *spelt))
        known, out = self.known, []
        for text, words, extra in zip(texts_, split, spelt, strict=True):
            rows = [known[w] for w in extra if known[w] is not None]
            if any(known[w] is not None for w in set(words)):
                for s in SENTENCE.split(text.lower()):
                    if near := [v for w in s.split() if (v := known.get(w)) is not None]:
                        rows.append(np.max(near, axis=0))
            out.append(np.stack(rows) if rows else np.zeros((0, len(self.landmarks.words)), dtype=np.float32))
        return out

    def worst(self, sentences: list[np.ndarray]) -> np.ndarray:
        return np.array([max(self.bias, float((s @ self.weights).max()) + self.bias) if len(s) else self.bias for s in sentences])

    def probability(self, texts_: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts_), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(self.sentences(texts_)) + self.shift, -50, 50)))


def choose_landmarks(bodies: list[str], toxic: np.ndarray) -> Landmarks:
    """Words that speak for toxic documents, and the clean words that are most easily taken for them."""
    seen = [{w for t in b.split() if 3 <= len(w := letters(t)) <= 16} for b in bodies]
    bad, good = Counter(), Counter()
    for words, y in zip(seen, toxic, strict=True):
        (bad if y else good).update(words)
    n, m = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least = max(3, n // 60)
    odds = {w: np.log((k + 0.1) / n) - np.log((good[w] + 0.1) / m) + 0.3 * np.log(k) for w, k in bad.items() if k >= least}
    strong = sorted((w for w, s in odds.items() if bad[w] / n > 4 * good[w] / m), key=lambda w: (-odds[w], w))[: LANDMARKS * 3 // 4]
    if not strong:
        return Landmarks(["".join(chr(97 + i) for i in range(5))], 1, FLOOR)
    clean = sorted((w for w in good if good[w] >= 3 and bad[w] / n <= 2 * good[w] / m), key=lambda w: (-good[w], w))[:20000]
    near, value = Landmarks(strong, len(strong), FLOOR).values(clean)
    likely = sorted((-good[clean[i]] * float(v.max()), clean[i]) for i, v in zip(near, value, strict=True))
    return Landmarks(strong + [w for _, w in likely[: LANDMARKS // 4]], len(strong), FLOOR)


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        margin = 1 - y * (z @ w)
        on = margin > 0
        grad = keep * w - 2 * z[on].T @ (weight[on] * y[on] * margin[on])
        hess = np.diag(keep) + 2 * (z[on].T * weight[on]) @ z[on]
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn machine values into probabilities."""
    z, w = np.column_stack([s, np.ones(len(s))]), np.zeros(2)
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + 1e-6 * np.eye(2), z.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(bodies: list[str], toxic: np.ndarray) -> Machine:
    if not len(toxic) or toxic.all() or not toxic.any():
        return Machine(None, np.zeros(0), 0.0, 0.0, 0.0, float(toxic.mean()) if len(toxic) else 0.0)
    marks = choose_landmarks(bodies, toxic)
    machine = Machine(marks, np.zeros(len(marks.words)), 0.0, 1.0, 0.0)
    bags = machine.sentences(bodies)
    # Nyström: features of values v are v times the inverse root of the landmarks' own kernel.
    own = marks.table.T.astype(np.float64) @ marks.table
    value, vector = np.linalg.eigh(own)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    none = np.zeros((1, len(marks.words)), dtype=np.float32)
    clean = np.vstack([none, *(s for s, y in zip(bags, toxic, strict=True) if not y)])
    bad = [s if len(s) else none for s, y in zip(bags, toxic, strict=True) if y]
    pick = [int(s.max(axis=1).argmax()) for s in bad]
    for _ in range(4):
        chosen = np.vstack([s[i] for s, i in zip(bad, pick, strict=True)])
        x = np.vstack([clean, chosen]).astype(np.float64) @ root
        y = np.concatenate([-np.ones(len(clean)), np.ones(len(chosen))])
        w, bias = fit_linear(x, y, np.concatenate([np.full(len(clean), 1.0), np.full(len(chosen), 1.0)]))
        machine.weights, machine.bias = root @ w, bias
        now = [int((s @ machine.weights).argmax()) for s in bad]
        if now == pick:
            break
        pick = now
    machine.slope, machine.shift = fit_logistic(machine.worst(bags), toxic)
    return machine


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on MOST_LABELLED labelled documents at most, which come to the driver."""
    known = chosen(labels, ("doc_id", "bigint"), ("toxic", "int")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).select(F.col("doc_id").alias("l_id"), "toxic")
    # The labels are at most MOST_LABELLED rows.
    rows = docs.join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(MOST_LABELLED).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_numpy() == 1)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    docs = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            group = batch.column("text").to_pylist()
            scores = np.concatenate([np.zeros(0), *(machine.probability(group[a:b]) for a, b in runs([len(t) for t in group], CHUNK))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
