"""Vector bin packing of examples into training sequences.

Every example has a demand vector: tokens, segments (always 1) and loss-bearing tokens. A sequence has a capacity
for each. The dot-product heuristic fills one sequence at a time: among the waiting examples that fit it takes the
one whose demand, scaled by the capacities, has the largest dot product with what is left. When none fits, an
example is cut to fill the sequence; cuts are free. Examples longer than a sequence give full sequences first.

Every task packs the rows of its own partition, so nothing is shuffled. What a task has left at its end is cut at
powers of two, sequences that need no padding. Memory: one Arrow batch and the waiting examples.

Defined results: null text counts as empty; an empty document is the single end token. Repeated rows are packed
as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from isomesh.llm.tokens import BytePieces, vocabulary
from isomesh.llm.work import texts

#: Production parameters: capacities of a sequence, and waiting examples from which a sequence is filled.
LENGTH, SEGMENTS, WAITING = 1024, 128, 1024


class Limits(NamedTuple):
    tokens: int = LENGTH
    segments: int = SEGMENTS
    loss: int = LENGTH


#: Of conversations: at most three quarters of a sequence bear loss.
TURN_LIMITS = Limits(loss=LENGTH * 3 // 4)


class Piece(NamedTuple):
    """A stretch of one example, placed in a sequence."""

    example: int
    start: int
    length: int
    sequence: int
    offset: int


class Packer:
    """Places examples, given by their length and the running count of their loss-bearing tokens."""

    def __init__(self, limits: Limits = Limits(), waiting: int = WAITING):
        if min(limits) < 1 or waiting < 1:
            raise ValueError("every limit must be 1 or more")
        self.limits, self.most = limits, waiting
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.sequence = 0
        # Waiting: example, start, tokens, loss-bearing tokens; loss: running counts by example, None if all count.
        self.rows = np.zeros((0, 4), dtype=np.int64)
        self.loss: dict[int, np.ndarray | None] = {}

    def lost(self, example: int, start: int, length: int) -> int:
        run = self.loss[example]
        return length if run is None else int(run[start + length] - run[start])

    def longest(self, example: int, start: int, tokens: int, loss: int) -> int:
        """The longest stretch from start within so many tokens and loss-bearing tokens."""
        run = self.loss[example]
        return min(tokens, loss) if run is None else min(tokens, int(np.searchsorted(run, run[start] + loss, side="right")) - 1 - start)

    def add(self, example: int, length: int, loss: np.ndarray | None = None) -> Iterator[Piece]:
        """Takes an example; gives the full sequences that it makes by itself."""
        self.loss[example] = loss
        start = 0
        while length - start > self.limits.tokens or self.lost(example, start, length - start) > self.limits.loss:
            n = self.longest(example, start, min(length - start, self.limits.tokens), self.limits.loss)
            if n < self.limits.tokens:
                break  # the loss limit binds: other examples may fill the rest
            yield Piece(example, start, n, self.sequence, 0)
            self.sequence += 1
            start += n
        if start < length:
            self.rows = np.vstack([self.rows, [[example, start, length - start, self.lost(example, start, length - start)]]])

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def fill(self, length: int) -> Iterator[Piece]:
        """One sequence of that length, or shorter if the waiting examples or another limit end it."""
        left = self.cap.copy()
        left[0] = length
        while left[0] > 0 and left[1] > 0 and len(self.rows):
            demand = np.column_stack([self.rows[:, 2], np.ones(len(self.rows)), self.rows[:, 3]])
            fits = (demand <= left).all(axis=1)
            if fits.any():
                gain = np.where(fits, (demand / self.cap) @ (left / self.cap), -1.0)
                i = int(gain.argmax())
                n = int(self.rows[i, 2])
            else:
                # Cut the one that can fill most of what is left.
                sizes = [self.longest(int(r[0]), int(r[1]), min(int(r[2]), int(left[0])), int(left[2])) for r in self.rows[:32]]
                i = int(np.argmax(sizes))
                if (n := sizes[i]) <= 0:
                    break
            example, start, tokens, loss = map(int, self.rows[i])
            used = self.lost(example, start, n)
            yield Piece(example, start, n, self.sequence, int(length - left[0]))
            left -= [n, 1, used]
            if n < tokens:
                self.rows[i] = (example, start + n, tokens - n, loss - used)
            else:
                self.rows = np.delete(self.rows, i, axis=0)
        self.sequence += 1

    def drain(self) -> Iterator[Piece]:
        """Places all that waits, the last of it in sequences of lengths that are powers of two."""
        while int(self.rows[:, 2].sum()) >= self.limits.tokens:
            yield from self.fill(self.limits.tokens)
        while rest := int(self.rows[:, 2].sum()):
            yield from self.fill(1 << (rest.bit_length() - 1))


PIECES = "sequence_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, ids array<int>"


def pack_rows(batches: Iterator[pa.RecordBatch], encode: Callable[[pa.RecordBatch], Iterator[tuple[bytes, np.ndarray | None]]], keys: list[str], limits: Limits, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """encode gives for each row its ids as little-endian bytes, and running loss counts or None."""
    packer = Packer(limits)
    base = TaskContext.get().partitionId() << 40
    held: dict[int, tuple[bytes, tuple]] = {}
    seen = 0
    out: list[tuple] = []

    def take(pieces: Iterator[Piece]) -> None:
        for p in pieces:
            ids, key = held[p.example]
            part = ids[4 * p.start : 4 * (p.start + p.length)]
            out.append((*key, base + p.sequence, p.start, p.length, zlib.crc32(part), len(ids) // 4, p.offset, np.frombuffer(part, "<i4") if with_ids else None))

    def flushed(schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[] for _ in schema]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    schema = None
    for batch in batches:
        schema = schema or pa.schema([(k, batch.schema.field(k).type) for k in keys] + [(n, pa.int64()) for n in ("sequence_id", "start", "length", "ids_crc32", "doc_tokens", "offset")] + [("ids", pa.list_(pa.int32()))])
        rows = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
        for key, (ids, loss) in zip(rows, encode(batch), strict=True):
            held[seen] = (ids, key)
            take(packer.add(seen, len(ids) // 4, loss))
            seen += 1
            if packer.full():
                # Half of the examples stay, so that later ones still find complements.
                while len(packer.rows) > packer.most // 2:
                    take(packer.fill(limits.tokens))
                waiting = set(packer.rows[:, 0].tolist())
                held = {k: v for k, v in held.items() if k in waiting}
                packer.loss = {k: v for k, v in packer.loss.items() if k in waiting}
        yield flushed(schema)
    if schema:
        take(packer.drain())
        yield flushed(schema)


def pack_documents(docs: DataFrame, limits: Limits = Limits(), vocabulary_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id and PIECES: every document's ids and the end token 0, packed; all tokens bear loss."""
    path = vocabulary_file or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = BytePieces(path)
        end = (0).to_bytes(4, "little")
        yield from pack_rows(batches, lambda b: ((pieces.encode(t.as_py()) + end, None) for t in b.column("text")), ["doc_id"], limits, with_ids)

    return texts(docs).mapInArrow(run, f"doc_id bigint, {PIECES}")


def pack_turns(turns: DataFrame, limits: Limits = TURN_LIMITS, vocabulary_file: str | None = None, trained: str = "assistant") -> DataFrame:
    """conv_id, turn and PIECES for instruction data: only tokens of turns by the trained role bear loss."""
    path = vocabulary_file or vocabulary("byte_bpe_50k.json")
    rows = texts(turns, ("turn", "bigint"), ("role", "string"), key="conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = BytePieces(path)
        end = (0).to_bytes(4, "little")

        def encode(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray | None]]:
            for text, role in zip(batch.column("text").to_pylist(), batch.column("role").to_pylist(), strict=True):
                ids = pieces.encode(text) + end
                yield ids, None if role == trained else np.zeros(len(ids) // 4 + 1, dtype=np.int64)

        yield from pack_rows(batches, encode, ["conv_id", "turn"], limits, True)

    return rows.mapInArrow(run, f"conv_id bigint, turn bigint, {PIECES}")


def report_turns(turns: DataFrame) -> DataFrame:
    """One row for each piece of a turn."""
    return pack_turns(turns).select("conv_id", "turn", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def report(docs: DataFrame) -> DataFrame:
    """One row for each piece."""
    return pack_documents(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
