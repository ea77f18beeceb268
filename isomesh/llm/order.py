"""Order MinHash: fingerprints of texts that follow edit distance, not only which k-mers occur.

For each of SLOTS permutations the two smallest of the text's k-mers, each numbered by its occurrence, are put in
the order in which they stand in the text; the hash of that pair is one component. Two texts agree in a component
only if they share both k-mers in the same order. The likeness of two fingerprints is the share of equal components.

``report`` also fingerprints an edited form of every text, whose last half is replaced by the start of the next
document's text, by descending id. The documents are dealt by ranges of ids once; every task walks its range in
order and keeps one text. Only the first and last document of each range meet their neighbours in a second step.

Defined results: null text counts as empty. A text of fewer than K code points is one k-mer; a text with a single
k-mer pairs it with itself; the empty text has a fingerprint of its own. Documents with equal ids follow each
other by text, null ids come last. Repeated rows each give a row. Of one document alone, it is its own next one.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isomesh.llm.bags import mixed
from isomesh.llm.work import texts, written

#: Production parameters: code points in a k-mer, components, and hashes worked out at once.
K, SLOTS, AT_ONCE = 6, 32, 4_000_000

rng = np.random.default_rng(20240607)
SEEDS = rng.integers(1 << 32, size=SLOTS, dtype=np.uint32)
FACTORS = rng.integers(1 << 32, size=SLOTS, dtype=np.uint32) | np.uint32(1)
POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, K + 1)], dtype=np.uint64)


def numbered_kmers(text: str) -> np.ndarray:
    """A 32-bit hash of each k-mer and of how often it has occurred before, in order of the text."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = max(1, len(cps) - K + 1) if len(cps) else 0
    hashes = np.zeros(n, dtype=np.uint64)
    for i in range(min(K, len(cps))):
        hashes += cps[i : i + n] * POWERS[i]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if n else np.zeros(0, dtype=np.int64)
    if len(starts) == n:
        return (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    before = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = before
    return (mixed(hashes ^ occurrence * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """SLOTS components as unsigned 32-bit integers."""
    kmers = numbered_kmers(text)
    if not len(kmers):
        return np.zeros(SLOTS, dtype=np.uint32)
    out = np.empty(SLOTS, dtype=np.uint32)
    step = max(1, AT_ONCE // len(kmers))
    for a in range(0, SLOTS, step):
        values = (kmers[None, :] ^ SEEDS[a : a + step, None]) * FACTORS[a : a + step, None]
        rows = np.arange(len(values))
        one = values.argmin(axis=1)
        values[rows, one] = 0xFFFFFFFF
        other = values.argmin(axis=1) if len(kmers) > 1 else one
        first, second = kmers[np.minimum(one, other)].astype(np.uint64), kmers[np.maximum(one, other)].astype(np.uint64)
        out[a : a + step] = (mixed((first << np.uint64(32) | second) + np.arange(a, a + len(rows), dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([as_text(fingerprint(t.as_py())) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fingerprint string")


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
#: A row is a result (side 0), or the first (1) or last (2) document of a range, with its text.
WALKED = [*RESULT, ("side", pa.int32()), ("part", pa.int32()), ("text", pa.string())]
TYPES = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double", pa.int32(): "int"}
SCHEMA = lambda fields: ", ".join(f"{n} {TYPES[t]}" for n, t in fields)


def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, next_: np.ndarray) -> tuple:
    """The result of a document, given the next one's text and fingerprint."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, next_)


def batch_of(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each document of a range with the next one."""
    part = TaskContext.get().partitionId()
    last = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = fingerprint(text)
            if last:
                rows.append((*compared(*last, text, own), 0, part, None))
            else:
                rows.append((doc_id, *[None] * 6, 1, part, text))
            last = doc_id, text, own
        yield batch_of(rows, WALKED)
    if last:
        yield batch_of([(last[0], *[None] * 6, 2, part, last[1])], WALKED)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [compared(d, t, fingerprint(t), f, fingerprint(f)) for d, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
        yield batch_of(rows, RESULT)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document, as the module says."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = texts(docs).repartitionByRange(parts, by[0]).sortWithinPartitions(*by)
    walked = written(dealt.mapInArrow(walk, SCHEMA(WALKED)), "walked")
    ends = walked.where("side > 0")
    # One row for each range, without texts: which range follows.
    following = ends.where("side = 1").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after"))
    lasts = ends.where("side = 2").select("doc_id", "text", "part")
    firsts = ends.where("side = 1").select(F.col("part").alias("after"), F.col("text").alias("following"))
    met = lasts.join(following, "part").join(firsts, "after").select("doc_id", "text", "following").mapInArrow(meet, SCHEMA(RESULT))
    return walked.where("side = 0").select(*(n for n, _ in RESULT)).union(met)
