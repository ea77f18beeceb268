"""Near-duplicate classes by BagMinHash: signatures, bands, and an exact check of multiset overlap.

A document is the multiset of its five-word shingles. Two documents are linked if the weighted Jaccard similarity
of their multisets (sum of the smaller counts over sum of the larger) is LEAST or more; a class is a connected
component of links. Equal texts are one node from the start, so copies are never paired with each other.

1. Every node meets the most central node of each band that it shares (the one that shares most bands with most
   nodes: the original among its edited copies); links are checked and merged into components.
2. In bands that still hold several components, nodes of different components are compared exactly, in blocks, by
   an inverted index over their shingles; of the links found, a block returns those that join components. Of a band
   with more than BLOCK nodes, those outside its largest component are compared with all, a pair of blocks at a time,
   so no group has to fit one task, none is capped, and no pair needs more to be compared for its band's size.

With 32 bands of 4 components, a pair of similarity 0.8 shares no band with probability 5e-8; the cut on signatures before the check in step 1 is seven standard deviations below 0.8.
Shingles are compared as 32-bit hashes, numbered by occurrence: of n shingles, n * n / 2**32 meet by chance.

Defined results: null text counts as empty; a text without words is linked to equal texts only. A text of one
to four words is a single shingle. Words are what white space separates, as written. The class id is the smallest
doc_id of the class, null if all its ids are null. Repeated rows and repeated ids each give a row. Extra columns
are ignored by the report and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomesh.llm.bags import band_keys, mixed, signatures
from isomesh.llm.work import dropped, packed, runs, texts, unpacked, written

#: Production parameters.
WORDS, LEAST = 5, 0.8
SIZE, ROWS = 128, 4
#: Signatures that agree in a smaller share are not checked.
LIKELY = 0.55
#: A block has at most about so many nodes, and so many shingles.
BLOCK, BLOCK_SHINGLES = 1500, 4_000_000
#: Code points handled at once by a task.
CHUNK = 500_000
WORD_BASE = 0x9FB21C651E98DF25

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


@cache
def white() -> np.ndarray:
    """Which code points of the basic plane are white space, as ``str.split`` has it."""
    return np.array([chr(i).isspace() for i in range(65536)])


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts as 64-bit hashes, in order, repeated ones repeated; the text of each."""
    joined = " ".join(group)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.cumsum([0, *(len(t) + 1 for t in group)])[:-1]
    edge = np.diff(np.concatenate([[0], (~white()[np.minimum(cps, 65535)]).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word's hash is a polynomial in its code points: a difference of running sums, moved to the word's own place.
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((cps + np.uint64(1)) * powers(WORD_BASE, len(cps)), dtype=np.uint64)])
    word = mixed((run[end] - run[start]) * powers(inverse(WORD_BASE), len(cps) + 1)[start] + (end - start).astype(np.uint64))
    of = np.searchsorted(begins, start, side="right") - 1
    n = max(0, len(word) - WORDS + 1)
    whole = of[:n] == of[len(of) - n :] if n else np.zeros(0, dtype=bool)
    five = mixed(sum((word[i : i + n] * MULTIPLIERS[i] for i in range(WORDS)), np.zeros(n, dtype=np.uint64)))[whole]
    # Texts of fewer words are one shingle.
    words = np.bincount(of, minlength=len(group))
    short, first = np.flatnonzero((words > 0) & (words < WORDS)), np.cumsum(words) - words
    few = [mixed((word[first[i] : first[i] + words[i]] * MULTIPLIERS[: words[i]]).sum(keepdims=True) + np.uint64(words[i])) for i in short]
    owner = np.concatenate([of[:n][whole], short])
    by = np.argsort(owner, kind="stable")
    return np.concatenate([five, *few])[by], owner[by]


def each(group: list[str]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Some texts at a time, as a range of the group, with the shingles of each."""
    for a, b in runs([len(t) for t in group], CHUNK):
        found, owner = shingles(group[a:b])
        yield a, b, np.split(found, np.searchsorted(owner, np.arange(1, b - a)))


def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, node, signature (binary; null without words), size (its shingles)."""
    for batch in batches:
        for a, b, found in each(batch.column("text").to_pylist()):
            sets = [np.unique(x, return_counts=True) for x in found]
            sizes = [len(e) for e, _ in sets]
            owner = np.repeat(np.arange(b - a), sizes)
            sig = signatures(np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(np.float64), owner, b - a, SIZE)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array([s.tobytes() if n else None for s, n in zip(sig, sizes, strict=True)], pa.binary()), pa.array([len(x) for x in found], pa.int64())], ["doc_id", "node", "signature", "size"])


def band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size, key: a row for each band of a signature."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, SIZE)
        keys = pa.array(band_keys(sig, ROWS).reshape(-1), pa.int64())
        places = pa.array(np.repeat(np.arange(len(sig)), SIZE // ROWS))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(places), batch.column("size").take(places), keys], ["node", "size", "key"])


def bag_of(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: every shingle is numbered by its occurrence."""
    e = np.sort(shingles)
    if not len(e):
        return np.zeros(0, dtype=np.uint32)
    new = np.concatenate([[True], e[1:] != e[:-1]])
    place = np.arange(len(e))
    occurrence = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return np.unique((mixed(e + occurrence * MULTIPLIERS[0]) >> np.uint64(32)).astype(np.uint32))


def shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, found in each(batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([bag_of(x).tobytes() for x in found], pa.binary())], ["node", "bag"])


def overlap(a: bytes, b: bytes) -> float:
    """The weighted Jaccard similarity of two bags."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def node_of(text: Column) -> Column:
    """Equal texts have equal nodes."""
    return F.unhex(F.md5(text))


def links(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose bags overlap enough."""
    left, right = (bags.select(F.col("node").alias(s), F.col("bag").alias(f"bag_{s}")) for s in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [overlap(x.as_py(), y.as_py()) >= LEAST for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b")
    return written(both.select("a", "b", "bag_a", "bag_b").mapInArrow(check, "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for all nodes with an edge.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until nothing changes.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u != v").distinct(), "edges")
    before = None
    while True:
        for step in ("large", "small"):
            around = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
            if step == "large":
                around = around.union(edges.select("u", "v"))
            least = around.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("c"), F.least("m", "x").alias("m"))
            met = around.join(least, F.col("x") == F.col("c"))
            if step == "large":
                out = met.where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
            else:
                out = met.select(F.col("y").alias("v"), F.col("m").alias("u")).union(least.select("c", "m"))
            edges = written(out.where("u != v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).union(edges.select("u", "u").distinct())


def compare_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """Links that join components, of the nodes of one block or between two blocks."""
    block, label, node = frame["block"].to_numpy(), frame["label"].tolist(), frame["node"].tolist()
    bags = [np.frombuffer(b, np.uint32) for b in frame["bag"]]
    low, high = frame["pair_low"].iloc[0], frame["pair_high"].iloc[0]
    one, other = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out: list[tuple[bytes, bytes]] = []
    if len(one) and len(other):
        sizes = np.array([len(bags[j]) for j in other])
        flat = np.concatenate([bags[j] for j in other])
        by = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(other)), sizes)[by]
        element, start = np.unique(flat[by], return_index=True)
        end = np.append(start[1:], len(flat))
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for i in one:
            shared = np.zeros(len(other), dtype=np.int64)
            for a in range(0, len(bags[i]), 4096):
                part = bags[i][a : a + 4096]
                at = np.minimum(np.searchsorted(element, part), len(element) - 1)
                at = at[element[at] == part]
                if len(at):
                    n = end[at] - start[at]
                    places = np.repeat(start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    shared += np.bincount(owner[places], minlength=len(other))
            for j in other[shared >= LEAST * (len(bags[i]) + sizes - shared)]:
                x, y = find(label[i]), find(label[j])
                if x != y:
                    root[x] = y
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
    return pd.DataFrame(out, columns=["a", "b"])


def weight(nodes: Column, shingles: Column) -> Column:
    """How many nodes of usual length so many with so many shingles are worth."""
    return F.greatest(nodes, F.ceil(shingles * BLOCK / BLOCK_SHINGLES))


def mixed_groups(members: DataFrame) -> DataFrame:
    """g, n: one key of each set of nodes that shares a key and holds several components; n counts its nodes, or more if
    they are long."""
    nodes = [F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("first"), F.max("node").alias("last"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")]
    groups = members.groupBy("key").agg(*nodes, F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    return groups.groupBy("n", "total", "first", "last", "sum").agg(F.min("key").alias("g")).select("g", weight(F.col("n"), F.col("total")).alias("n"))


def across(members: DataFrame, bags: DataFrame) -> DataFrame:
    """Links between nodes of different components that share a band. members: key, node, label, size."""
    groups = written(mixed_groups(members), "groups")
    inside = members.join(groups, F.col("key") == F.col("g"))
    whole = F.lit(0).cast("bigint")
    small = inside.where(F.col("n") <= BLOCK).select("key", "node", "label", whole.alias("block"), whole.alias("pair_low"), whole.alias("pair_high"))
    # Of two nodes that lie apart, one is outside the band's largest component: those are held against all, in blocks.
    big = inside.where(F.col("n") > BLOCK).select("key", "node", "label", "size", "n")
    tally = big.groupBy("key", "label").agg(F.count("*").alias("many"), F.sum("size").alias("long"))
    main = tally.groupBy("key").agg(F.max(F.struct("many", "label", "long")).alias("main"), F.sum("many").alias("many"), F.sum("long").alias("long"))
    outside = weight(F.col("many") - F.col("main.many"), F.col("long") - F.col("main.long"))
    placed = big.join(main.select("key", F.col("main.label").alias("main"), F.ceil(outside / BLOCK).alias("low_blocks")), "key").withColumn("high_blocks", F.ceil(F.col("n") / BLOCK))
    low, high = F.pmod(F.xxhash64("node"), F.col("low_blocks")), F.col("low_blocks") + F.pmod(F.xxhash64("node"), F.col("high_blocks"))
    apart = placed.where("label != main").select("key", "node", "label", low.alias("block"), low.alias("pair_low"), F.explode(F.expr("sequence(low_blocks, low_blocks + high_blocks - 1)")).alias("pair_high"))
    every = placed.select("key", "node", "label", high.alias("block"), F.explode(F.expr("sequence(0L, low_blocks - 1)")).alias("pair_low"), high.alias("pair_high"))
    rows = small.union(apart).union(every).join(bags.select(F.col("node").alias("s"), "bag"), F.col("node") == F.col("s"))
    return written(rows.groupBy("key", "pair_low", "pair_high").applyInPandas(compare_blocks, "a binary, b binary"), "across")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, first_node: a row for each document; first_node has the text that stands for the class."""
    docs = texts(docs).withColumn("node", node_of(F.col("text")))
    signed = written(docs.mapInArrow(sign_batches, "doc_id bigint, node binary, signature binary, size bigint"), "signed")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature"), F.min("size").alias("size")), "nodes")
    bands = nodes.where("signature is not null").select("node", "signature", "size").mapInArrow(band_batches, "node binary, size bigint, key bigint")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    members = written(bands.join(shared, F.col("key") == F.col("k")).select("key", "node", "size", "n"), "members")
    # 1. Every node and the most central one of each of its bands.
    central_ = written(members.groupBy("node").agg(F.sum("n").alias("met")), "central")
    central = central_.select(F.col("node").alias("c"), "met")
    leaders = members.join(central, F.col("node") == F.col("c")).groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("less"), "node")).alias("best")).select(F.col("key").alias("k"), F.col("best.node").alias("leader"))
    met = members.join(leaders, F.col("key") == F.col("k")).where("node != leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    # Bags of the nodes that share a band, each read from the node's first document.
    wanted = central.join(nodes.select("node", "first"), F.col("c") == F.col("node")).select(F.col("c").alias("w"), "first")
    found = docs.join(wanted, (F.col("node") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    bags = written(found.select("node", "text").mapInArrow(shingle_batches, "node binary, bag binary").dropDuplicates(["node"]), "bags")
    signature = lambda s: nodes.select(F.col("node").alias(s), F.col("signature").alias(f"sig_{s}"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIZE) for c in ("sig_a", "sig_b")]
            yield batch.select(["a", "b"]).filter(pa.array((sig[0] == sig[1]).mean(axis=1) >= LIKELY))

    joined = met.join(signature("a"), "a").join(signature("b"), "b").select("a", "b", "sig_a", "sig_b")
    linked = links(written(joined.mapInArrow(likely, "a binary, b binary"), "likely"), bags)
    labels = written(components(linked), "labels")
    # 2. What still lies apart within a band.
    labelled = members.select("key", "node", "size").join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled, "labelled")
    more = across(labelled, bags)
    dropped(members, central_, labelled, bags)
    last = components(linked.union(more)).select(F.col("node").alias("l_node"), "label")
    own = signed.select("doc_id", "node").join(last, F.col("node") == F.col("l_node"), "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    own = written(own, "own")
    dropped(signed, nodes)
    heads = own.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"))
    heads = heads.select(F.col("label").alias("h_label"), F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("first_node"))
    return own.join(heads, F.col("label") == F.col("h_label")).select("doc_id", "node", "class_id", "first_node")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document, with its class."""
    return classes(docs).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id; all its columns stay."""
    heads = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first_node")))
    heads = written(heads.groupBy(F.col("doc_id").alias("id"), F.col("node").alias("first")).agg(F.count("*").alias("times")), "heads")
    keyed = packed(docs, ("doc_id", "bigint"), ("text", "string")).withColumn("node", node_of(F.coalesce("text", F.lit(""))))
    kept = keyed.join(heads, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("first")))
    # Rows with the same id and text, of which one stays, are rare: only they are dealt out again.
    return unpacked(kept.where("times = 1").select("row", "text").union(kept.where("times > 1").dropDuplicates(["id", "node"]).select("row", "text")), docs)
