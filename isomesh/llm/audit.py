"""Interaction of filters: what each removes alone, after others, and on average over all orders.

Five filters are held against every document: A too few words, B too few different words, C too many capitals, D signs of
markup, E a copy of a document with a smaller id. Which filters a document fails is a mask of five bits; all that
orders of filters can show follows from how many documents of a part have each mask, so texts are read once.

Copies are found through an RDD. A task keeps, for each fingerprint (xxhash64) of its own rows, a chain of entries: full
text, smallest id, and the masks of the rows with that id. Rows whose id is not the smallest are copies for sure; they
travel on without their text, wherever there is room. The others are routed to the partition of their fingerprint, so
a text that a third of all rows share crosses the network once a task. There rows come in the order of fingerprints,
chains are joined, and ids that are not the smallest are marked. Different texts of one fingerprint are told apart by
the text itself.

Defined results: null text counts as empty; null and empty ``lang`` are the part ''. A row with a null id is no copy and
makes none. Rows of the same id and text are not copies of each other. Labels of one id: any that is 1 counts; others,
nulls and rows without a label count as 0. An empty table has no parts and no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby, permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomesh.llm.work import chosen

FILTERS = "ABCDE"
#: Production parameters: least words, least different words of 100, most capitals of 100 code points.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 100, 80, 10
MARKUP = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Characters of text that a task keeps in chains before it sends them on.
HELD = 1 << 24

#: What is routed: text (None: settled), id, mask counts by (part, mask).
Entry = tuple[str | None, int | None, dict[tuple[str, int], int]]
Loss = tuple[int | None, str, int, int]  # id, part, mask, rows


def mask_of(text: str) -> int:
    """The filters that a text fails by itself, as bits."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DIFFERENT * len(words),
        100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(text),
        len(raw.translate(None, MARKUP)) < len(raw),
    )
    return sum(f << i for i, f in enumerate(fails))


class Chains:
    """Of each fingerprint the entries of its different texts: [text, smallest id, mask counts of that id]."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.held = 0

    def add(self, print_: int, text: str, doc_id: int, counts: dict) -> Entry | None:
        """Takes rows in; the rows that turn out to be copies, if any, come back with their ids."""
        chain = self.of.setdefault(print_, [])
        for entry in chain:
            if entry[0] == text:
                if doc_id == entry[1]:
                    for k, n in counts.items():
                        entry[2][k] = entry[2].get(k, 0) + n
                    return None
                if doc_id > entry[1]:
                    return None, doc_id, counts
                before, entry[1:] = (entry[1], entry[2]), [doc_id, counts]
                return None, *before
        chain.append([text, doc_id, counts])
        self.held += len(text)
        return None

    def entries(self) -> Iterator[tuple[int, Entry]]:
        for print_, chain in self.of.items():
            for entry in chain:
                yield print_, tuple(entry)


def copies(counts: dict) -> dict:
    return {(part, mask | COPY): n for (part, mask), n in counts.items()}


def spread(doc_id: int) -> int:
    """Where an entry without a text goes: anywhere, but the same place in every run."""
    return doc_id * 0x9E3779B97F4A7C15 >> 7 & (1 << 62) - 1


def route(rows: Iterable) -> Iterator[tuple[int, Entry]]:
    """(fingerprint, entry) of a task's rows (fingerprint, doc_id, text, part), copies among themselves settled."""
    chains, unnamed = Chains(), Counter()
    for print_, doc_id, text, part in rows:
        mask = mask_of(text)
        if doc_id is None:
            unnamed[part, mask] += 1
            continue
        loss = chains.add(print_, text, doc_id, {(part, mask): 1})
        if loss:
            yield spread(loss[1]), (None, loss[1], copies(loss[2]))
        if chains.held > HELD:
            yield from chains.entries()
            chains = Chains()
    yield from chains.entries()
    if unnamed:
        yield 0, (None, None, dict(unnamed))


def settle(routed: Iterable[tuple[int, Entry]]) -> Iterator[Loss]:
    """Rows with their masks, from entries in the order of their fingerprints; one fingerprint's chain at a time."""
    told = lambda doc_id, counts: ((doc_id, part, mask, n) for (part, mask), n in counts.items())
    for print_, group in groupby(routed, key=lambda x: x[0]):
        chains = Chains()
        for _, (text, doc_id, counts) in group:
            if text is None:
                yield from told(doc_id, counts)
            elif loss := chains.add(print_, text, doc_id, counts):
                yield from told(loss[1], copies(loss[2]))
        for _, (_, doc_id, counts) in chains.entries():
            yield from told(doc_id, counts)


def masked(docs: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """doc_id, part, mask, n: how many rows of an id and part fail just the filters of the mask."""
    spark = docs.sparkSession
    rows = chosen(docs, ("doc_id", "bigint"), ("text", "string"), ("lang", "string")).fillna("", ["text", "lang"])
    keyed = rows.select((F.xxhash64("text") if fingerprint is None else fingerprint).alias("print"), "doc_id", "text", F.col("lang").alias("part"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = keyed.rdd.mapPartitions(route).repartitionAndSortWithinPartitions(parts, lambda print_: print_ % parts)
    return spark.createDataFrame(routed.mapPartitions(settle), "doc_id bigint, part string, mask int, n bigint", verifySchema=False)


def labelled(labels: DataFrame) -> DataFrame:
    """id, good, toxic (0 or 1) for each id."""
    rows = chosen(labels, ("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")).where("doc_id is not null")
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return rows.groupBy(F.col("doc_id").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


Row = tuple[int, int, int, int]  # mask, rows, good, toxic


def empty_vector() -> np.ndarray:
    return np.zeros((3, MASKS), dtype=np.int64)


def put(vector: np.ndarray, row: Row) -> np.ndarray:
    mask, n, good, toxic = row
    vector[:, mask] += n, n * good, n * toxic
    return vector


@cache
def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def audit(vector: np.ndarray) -> Iterator[tuple]:
    """filter_order, step and its counts, for all orders, from the rows, good and toxic ones of each mask."""
    masks = np.arange(MASKS)
    out, removed_by = [], Counter()
    for order in orders():
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails = (masks & bit) > 0
            here = fails & ((masks & before) == 0)
            removed, good, toxic = (int(v[here].sum()) for v in vector)
            redundant, alone = int(vector[0][fails & ~here].sum()), int(vector[0][bit])
            before |= bit
            out.append((order, step, int(vector[0][(masks & before) == 0].sum()), removed, redundant, alone, good, toxic))
            removed_by[name] += removed
    for row in out:
        yield *row, removed_by[row[0][row[1] - 1]]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def report(docs: DataFrame, labels: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """A row for each part, order of the filters and step; an error if these don't account for every row."""
    spark = docs.sparkSession
    met = masked(docs, fingerprint).join(labelled(labels), F.col("doc_id") == F.col("id"), "left")
    rows = met.select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd
    # A vector for each part and task crosses the network, however many rows a part has.
    vectors = rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: put(empty_vector(), row), put, np.add, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = vectors.flatMap(lambda kv: ((kv[0], int(kv[1][0].sum()), *row) for row in audit(kv[1])))
    steps = spark.createDataFrame(made, ", ".join(["part string, counted bigint, filter_order string, step int", *(f"{c} bigint" for c in COUNTS)]), verifySchema=False)
    # An audit that lost or doubled rows on its way is worth nothing: every part must come to what the table itself has.
    held = chosen(docs, ("lang", "string")).fillna("").groupBy(F.col("lang").alias("held")).agg(F.count("*").alias("rows"))
    whole = F.assert_true(F.col("counted").eqNullSafe(F.col("rows")), F.concat(F.lit("rows were lost or doubled in part "), F.col("held")))
    return held.join(steps, F.col("held") == F.col("part"), "left").withColumn("kept", F.coalesce(whole.cast("bigint"), "kept")).select("part", "filter_order", "step", *COUNTS)


#: The report for DuckDB: every document against every order.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
least_id AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 10 * length(w.text),
    'D': regexp_matches(w.text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least_id.least, false)} AS x
  FROM w JOIN least_id ON w.text = least_id.text LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, x.A AS A, x.B AS B, x.C AS C, x.D AS D, x.E AS E, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
perms AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS own, substr(filter_order, 1, s - 1) AS before FROM perms, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
g AS (
  SELECT part, filter_order, step, own, n, good, toxic,
    CASE own WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END AS fails,
    (A AND contains(before, 'A')) OR (B AND contains(before, 'B')) OR (C AND contains(before, 'C')) OR (D AND contains(before, 'D')) OR (E AND contains(before, 'E')) AS gone,
    A::INT + B::INT + C::INT + D::INT + E::INT AS failed FROM m, steps),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
