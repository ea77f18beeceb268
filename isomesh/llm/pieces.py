"""Encoding and decoding with a public SentencePiece vocabulary, as a lattice of pieces over each word.

The substrings of a word, of bounded length, are joined to the piece table; the matches are the edges of the
word's lattice, and a fold over the lattice picks the path. The public model is a byte-pair model: its encoding is
the path that merging the best-scored adjacent pair leads to, not the one of the best sum of scores, so the fold
merges edges instead of running Viterbi.

``encode`` does this inside tasks, with numpy over all new words of a batch at once: substrings are polynomial
hashes, the piece table is an open hash table of bounded size, and one fold step is one step for all words.
``encode_words`` is the same method as relations, for tables of words: explode, equi-join, group, and Spark's
``aggregate``. On whole documents that form would shuffle a row for each word of the corpus; see the README.

Defined results: null text counts as empty; an empty text has no pieces. Characters without a piece become byte
pieces. Repeated rows each give a row. Extra columns are ignored. A literal U+2581 decodes as a space.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isomesh.llm.bags import mixed
from isomesh.llm.tokens import vocabulary
from isomesh.llm.work import runs, texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CHUNK, KEPT = 4_000_000, 300_000
#: Words of more code points are folded one at a time.
LONGEST, AT_ONCE = 24, 40_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The piece table: ids and scores by piece, and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        normal = [i for i in range(len(self.names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.names[i]: i for i in normal}
        self.score = {i: model.get_score(i) for i in normal}
        # The order of merging: the best score first.
        self.rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: -self.score[i]))}
        self.bytes = {int(self.names[i][1:-1], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [of_byte.get(i, b"" if model.is_control(i) else n.replace(SPACE, " ").encode()) for i, n in enumerate(self.names)]
        assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids), "pieces must not reach beyond a word"
        names = list(self.ids)
        keys = hashes_of(names)
        assert len(set(keys.tolist())) == len(names)
        size = self.mask = (1 << (4 * len(names)).bit_length()) - 1
        self.table_key = np.zeros(size + 1, dtype=np.uint64)
        self.table_id = np.full(size + 1, -1, dtype=np.int32)
        self.steps = 1
        for key, name in zip(keys.tolist(), names, strict=True):
            at, n = key & size, 1
            while self.table_id[at] >= 0:
                at, n = (at + 1) & size, n + 1
            self.table_key[at], self.table_id[at] = key, self.ids[name]
            self.steps = max(self.steps, n)
        self.rank_of = np.full(len(self.names) + 1, 1 << 30, dtype=np.int32)  # the last is for "no piece"
        for i, r in self.rank.items():
            self.rank_of[i] = r

    def find(self, key: np.ndarray) -> np.ndarray:
        """Ids by hash, -1 if there is no such piece: the join of substrings with the piece table."""
        at = (key & np.uint64(self.mask)).astype(np.int64)
        out = np.full(key.shape, -1, dtype=np.int32)
        for _ in range(self.steps):
            hit = (self.table_key[at] == key) & (self.table_id[at] >= 0)
            out[hit] = self.table_id[at[hit]]
            at = (at + 1) & self.mask
        return out

    def fold_one(self, word: str) -> list[int]:
        """Pieces of one word of any length, by a queue of adjacent pairs."""
        end = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        alive = [True] * len(word)
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < len(word):
                i = self.ids.get(word[a : end[end[a]]]) if end[end[a]] - a <= self.longest else None
                if i is not None:
                    heapq.heappush(queue, (self.rank[i], a, end[a], end[end[a]]))

        for a in range(len(word)):
            offer(a)
        while queue:
            _, a, middle, last = heapq.heappop(queue)
            if not (alive[a] and end[a] == middle and alive[middle] and end[middle] == last):
                continue
            alive[middle] = False
            end[a] = last
            if last < len(word):
                before[last] = a
            offer(before[a])
            offer(a)
        out: list[int] = []
        for a in range(len(word)):
            if alive[a]:
                i = self.ids.get(word[a : end[a]])
                out += [i] if i is not None else [self.bytes[b] for b in word[a : end[a]].encode("utf-8", "replace")]
        return out

    def fold(self, words: list[str]) -> list[bytes]:
        """The pieces of each word as little-endian 32-bit ids."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = np.asarray(self.fold_one(w), "<i4").tobytes()
        for a in range(0, len(short), AT_ONCE):
            part = short[a : a + AT_ONCE]
            for i, ids in zip(part, self.fold_together([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def fold_together(self, words: list[str]) -> list[bytes]:
        width = max(map(len, words))
        n = np.array([len(w) for w in words])
        padded = "".join([w.ljust(width, "\0") for w in words])
        cps = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width).astype(np.uint64)
        prefix = prefixes(cps)
        cut = np.minimum(np.arange(width + 1)[None, :], n[:, None])  # where pieces begin; then the end, repeated
        rank = np.full((len(words), width), 1 << 30, dtype=np.int32)
        for j in range(width - 1):
            rank[:, j] = self.pair_rank(prefix, np.arange(len(words)), cut[:, j], cut[:, j + 1], cut[:, j + 2])
        row = np.arange(len(words))
        place = np.arange(width + 1)[None, :]
        live = row
        while len(live):
            r = rank[live]
            j = r.argmin(axis=1)
            some = r[np.arange(len(live)), j] < 1 << 30
            live, j = live[some], j[some]
            if not len(live):
                break
            # Drop the cut between the pair; what stands behind moves up.
            shift = np.minimum(place + (place > j[:, None]), width)
            cut[live] = np.take_along_axis(cut[live], shift, axis=1)
            rank[live] = np.take_along_axis(np.hstack([rank[live], np.full((len(live), 1), 1 << 30, dtype=np.int32)]), shift[:, :-1], axis=1)
            for k in (j - 1, j):
                ok = (k >= 0) & (k + 2 <= width)
                at, c = live[ok], k[ok]
                rank[at, c] = self.pair_rank(prefix, at, cut[at, c], cut[at, c + 1], cut[at, c + 2])
        starts, ends = cut[:, :-1], cut[:, 1:]
        real = ends > starts
        of = np.nonzero(real)[0]
        ids = self.find(span_hash(prefix, of, starts[real], ends[real]))
        first = np.searchsorted(of, row)
        last = np.searchsorted(of, row, side="right")
        raw = ids.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        for i in set(of[ids < 0].tolist()):  # characters without a piece
            out[i] = np.asarray(self.fold_one(words[i]), "<i4").tobytes()
        return out

    def pair_rank(self, prefix: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.full(len(a), 1 << 30, dtype=np.int32)
        ok = np.flatnonzero((b > a) & (c > b) & (c - a <= self.longest))
        out[ok] = self.rank_of[self.find(span_hash(prefix, row[ok], a[ok], c[ok]))]
        return out


@cache
def powers() -> np.ndarray:
    return np.array([pow(int(BASE), i, 1 << 64) for i in range(LONGEST + 2)], dtype=np.uint64)


def prefixes(cps: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all beginnings of each row."""
    out = np.zeros((cps.shape[0], cps.shape[1] + 1), dtype=np.uint64)
    for j in range(cps.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + cps[:, j] + np.uint64(1)
    return out


def span_hash(prefix: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(prefix[row, b] - prefix[row, a] * powers()[b - a])


def hashes_of(names: list[str]) -> np.ndarray:
    width = max(map(len, names))
    cps = np.frombuffer("".join(n.ljust(width, "\0") for n in names).encode("utf-32-le"), "<u4").reshape(len(names), width).astype(np.uint64)
    n = np.array([len(x) for x in names])
    rows = np.arange(len(names))
    return span_hash(prefixes(cps), rows, np.zeros(len(names), dtype=np.int64), n)


@cache
def loaded(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts; a word is folded once and then remembered by the worker."""

    def __init__(self, path: str):
        self.pieces = loaded(path)
        self.words: dict[str, bytes] = {}

    def encode(self, group: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        known = self.words
        if len(known) > KEPT:
            known.clear()
        units = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in group]
        new = list(set().union(*units).difference(known))
        known.update(zip(new, self.pieces.fold(new), strict=True))
        return [b"".join([known[u] for u in us]) for us in units]

    def decode(self, ids: list[int]) -> str:
        raw = self.pieces.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, round_trip (the ids decode to the text again)."""
    path = model_file or vocabulary(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            group = batch.column("text").to_pylist()
            for a, b in runs([len(t) for t in group], CHUNK):
                coded = encoder.encode(group[a:b])
                counts = [len(c) // 4 for c in coded]
                flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
                same = [encoder.decode(np.frombuffer(c, "<i4").tolist()) == t for c, t in zip(coded, group[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in group[a:b]], pa.int64()), pa.array(counts, pa.int64()), ids, pa.array(same, pa.bool_())], ["doc_id", "n_chars", "n_pieces", "ids", "round_trip"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: none)."""
    path = model_file or vocabulary(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encoder.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def piece_table(spark: SparkSession, model_file: str | None = None) -> DataFrame:
    """piece, id, rank: a table of the model's size."""
    pieces = loaded(model_file or vocabulary(MODEL))
    return spark.createDataFrame([(p, i, pieces.rank[i]) for p, i in pieces.ids.items()], "piece string, id int, rank int")


def encode_words(words: DataFrame, model_file: str | None = None) -> DataFrame:
    """word, ids for a table of distinct words (column ``word``, spaces as U+2581, all characters in the vocabulary).

    The relational form: substrings of bounded length, equi-joined to the piece table, grouped by word, folded.
    """
    pieces = piece_table(words.sparkSession, model_file)
    n = F.length("word")
    longest = loaded(model_file or vocabulary(MODEL)).longest
    starts = words.where(n > 0).select("word", F.explode(F.sequence(F.lit(1), n)).alias("a"))
    spans = starts.select("word", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("a") + 1))).alias("n"))
    edges = spans.withColumn("piece", F.substring(F.col("word"), F.col("a"), F.col("n"))).join(F.broadcast(pieces), "piece")  # the vocabulary's size
    lattice = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "a", F.col("a") + F.col("n")), F.struct("rank", "id")))).alias("edges"))
    at = lambda a, b: F.element_at(F.col("edges"), F.concat_ws(":", a, b))

    def step(cuts, _):
        pairs = F.transform(F.slice(cuts, 1, F.greatest(F.size(cuts) - 2, F.lit(0))), lambda a, i: F.struct(at(a, cuts[i + 2])["rank"].alias("rank"), (i + 1).alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c, i: i != best["i"]))

    cuts = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(1), n + 1), step)
    ids = lattice.select("word", "edges", cuts.alias("cuts"))
    return ids.select("word", F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda a, i: at(a, F.col("cuts")[i + 1])["id"]).alias("ids"))
