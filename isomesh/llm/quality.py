"""Quality rules: plain counts, and perplexity under a modified Kneser-Ney model of the corpus itself.

The language model is over ORDER lower-case characters as they are, of any script, with a model for each language that
one row in LEAST_SHARE declares and one for all others together. Tasks count n-grams, Spark sums them over all
documents and derives continuation counts, discounts and back-off weights by grouped aggregation and joins. An n-gram gets an
entry if MIN_TEXTS texts have it, since a text tells nothing of itself; scoring backs off where it is missing, with the
weight that the n-grams without an entry leave. Discounts come from the counts of all. The model grows with the corpus
and is a table of n-grams.

For scoring, the table becomes sorted arrays of 64-bit hashes with their values, which tasks search by bisection. They
are cut into shards of about SHARD entries by the last two characters of the context, so that a shard has all that
its n-grams ask for; each shard is sent to the tasks in a pass of its own over the documents, which scores the n-grams of
that shard. A model of one shard takes one pass.

A document fails if its mean log-probability lies outside its language's band, which is set by the quartiles, from a
histogram, of the documents that pass the base rules.

Defined results: null text counts as having no words; a text without words fails the base rules; an empty text has
null perplexity. Null and rare languages share the model and band "other". A language none of whose documents pass
the base rules has no band and rejects nothing by it. Extra columns, whatever their names, are ignored by the report and kept by
``keep_good``. Repeated rows each count and each give a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isomesh.llm.bags import mixed, stride
from isomesh.llm.work import chosen, packed, runs, strings, unpacked, written

#: Production parameters.
ORDER, MIN_TEXTS, LEAST_SHARE = 5, 2, 1000
#: Characters that the model knows nothing of are equally likely among so many.
ALPHABET = 1 << 16
#: Quartile ranges that a band reaches below the lower and above the upper quartile; bins of a histogram for each nat.
BELOW, ABOVE, BINS = 5.0, 8.0, 1000
#: Code points handled at once by a task; entries of the model (12 bytes each) sent to tasks at once.
CHUNK, SHARD = 300_000, 4_000_000
#: A worker remembers the values of up to 2 ** RECENT n-grams that it met lately.
RECENT = 20
#: Stands before the first characters of a text.
START = "\x02"
OTHER = "other"
BASE = np.uint64(0x9E3779B97F4A7C15)


def languages(docs: DataFrame) -> list[str]:
    """The declared languages that have a model of their own: LEAST_SHARE at most. docs: lang."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    total = docs.count()
    return sorted(r.lang for r in counts.where((F.col("n") * LEAST_SHARE >= total) & F.col("lang").isNotNull()).collect())


def model_of(langs: list[str]) -> Column:
    """The place of a row's language in the list; behind its end for all others."""
    found = F.array_position(F.array(*map(F.lit, langs)).cast("array<string>"), F.col("lang")) if langs else F.lit(0)
    return F.when(F.coalesce(found, F.lit(0)) > 0, found - 1).otherwise(len(langs)).cast("int")


def stretches(group: list[str]) -> list[tuple[int, str]]:
    """Of each text (place, characters) with what stands before its first one; long texts in overlapping stretches."""
    out = []
    for i, t in enumerate(group):
        t = START * (ORDER - 1) + t.lower()
        out += [(i, t[a : a + CHUNK + ORDER - 1]) for a in range(0, max(1, len(t) - ORDER + 1), CHUNK)]
    return out


def windows(group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points, the places where an n-gram ends, and the text of each such place."""
    cps = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in group], dtype=np.int64)
    text = np.repeat(np.arange(len(group)), sizes)
    place = np.arange(len(cps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.flatnonzero(place >= ORDER - 1)
    return cps, ends, text[ends]


def rolled(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the n-gram that ends at each place."""
    h = np.zeros(len(ends), dtype=np.uint64)
    for back in range(ORDER - 1, -1, -1):
        h = h * BASE + cps[ends - back]
    return h


def gram_counts(parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different n-grams of some stretches, how often they stand there, and in how many stretches."""
    cps, ends, text = windows(parts)
    if not len(ends):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = rolled(cps, ends)
    order = np.argsort(key, kind="stable")
    key, text, ends = key[order], text[order], ends[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    new_text = new | np.concatenate([[True], text[1:] != text[:-1]])
    joined = cps[ends[first][:, None] + np.arange(1 - ORDER, 1)].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode()
    grams = [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]
    return grams, np.diff(np.append(first, len(key))), np.add.reduceat(new_text, first, dtype=np.int64)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """model, gram, n, texts: for some texts at a time. The stretches of a long text count as one text."""

    def told(model: int, grams: list[str], n: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), model, dtype=np.int32)), pa.array(grams, pa.string()), pa.array(n), pa.array(texts)], ["model", "gram", "n", "texts"])

    for batch in batches:
        models = batch.column("model").to_numpy()
        for model in np.unique(models):
            rows = strings(batch.column("text").filter(pa.array(models == model)))
            parts, long = [], {}
            for i, s in stretches(rows):
                (parts.append(s) if len(rows[i]) <= CHUNK // 2 else long.setdefault(i, []).append(s))
            for a, b in runs([len(p) for p in parts], CHUNK):
                yield told(model, *gram_counts(parts[a:b]))
            for one in long.values():
                total: Counter = Counter()
                for s in one:
                    grams, n, _ = gram_counts([s])
                    for g, k in zip(grams, n.tolist(), strict=True):
                        total[g] += k
                yield told(model, list(total), np.fromiter(total.values(), np.int64, len(total)), np.ones(len(total), np.int64))


def count_grams(docs: DataFrame) -> DataFrame:
    """model, gram, n, texts of all n-grams. docs: text, model."""
    counts = docs.select("text", "model").mapInArrow(count_batches, "model int, gram string, n bigint, texts bigint")
    return counts.groupBy("model", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def discounts(own: DataFrame) -> DataFrame:
    """model, d1, d2, d3: what counts of 1, 2 and more lose, from how many n-grams have counts of 1 to 4."""
    times = [F.sum((F.col("n") == k).cast("bigint")).alias(f"n{k}") for k in range(1, 5)]
    c = lambda k: F.greatest(F.col(f"n{k}"), F.lit(1))
    y = c(1) / (c(1) + 2 * c(2))
    by = [F.least(F.greatest(k - (k + 1) * y * c(k + 1) / c(k), F.lit(0.1)), F.lit(k - 0.1)).alias(f"d{k}") for k in (1, 2, 3)]
    return own.groupBy("model").agg(*times).select("model", *by)


def kneser_ney(counts: DataFrame, order: int = ORDER, least_texts: int = MIN_TEXTS) -> DataFrame:
    """model, gram, kind, value: for n-grams of each size the log of the interpolated probability of their last
    character (kind p), for contexts of each size the log of the back-off weight (kind b).

    counts: model, gram, n, texts, of all n-grams of the largest size. Those that too few texts have get no entry; they
    take part in the discounts, and what they would have had goes to their contexts' back-off weights.
    """
    # Every level is a table of its own, so that no plan holds the levels below it again.
    levels = {order: counts.withColumn("kept", F.col("texts") >= least_texts)}
    for size in range(order - 1, 0, -1):
        # In how many different ways the shorter gram continues something.
        levels[size] = written(levels[size + 1].where("kept").groupBy("model", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n")), "level").withColumn("kept", F.lit(True))
    lower, out = None, None
    for size in range(1, order + 1):
        own = levels[size]
        less = F.when(~F.col("kept"), F.col("n")).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        # Discounts: one row for each model, LEAST_SHARE + 1 at most.
        cut = own.join(F.broadcast(discounts(own)), "model").select("model", "gram", F.substring("gram", 1, size - 1).alias("ctx"), "n", less.cast("double").alias("cut"), "kept")
        # A context without entries backs off as one that was never seen.
        sums = cut.groupBy("model", "ctx").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("back"), F.max("kept").alias("some"))
        contexts = written(sums.where("some").drop("some"), "contexts")
        p = cut.where("kept").join(contexts, ["model", "ctx"]).withColumn("own", (F.col("n") - F.col("cut")) / F.col("total"))
        if lower is None:
            p = p.select("model", "gram", (F.col("own") + F.col("back") / ALPHABET).alias("p"))
        else:
            shorter = lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("less"))
            p = p.withColumn("suffix", F.substring("gram", 2, size - 1)).join(shorter, ["model", "suffix"]).select("model", "gram", (F.col("own") + F.col("back") * F.col("less")).alias("p"))
        lower = written(p, "interpolated")
        entries = lower.select("model", "gram", F.lit("p").alias("kind"), F.log("p").cast("float").alias("value"))
        entries = entries.union(contexts.select("model", "ctx", F.lit("b"), F.log("back").cast("float")))
        out = entries if out is None else out.union(entries)
    return out


def seeds(model: np.ndarray) -> np.ndarray:
    return mixed((model.astype(np.uint64) + np.uint64(1)) * stride(1))


def key_of(cps: np.ndarray, seed: np.ndarray, kind: str) -> np.ndarray:
    """The 64-bit hash of each row of code points, of its length, its model's seed and its kind."""
    h = seed + stride(2 * cps.shape[1] + (kind == "b"))
    for i in range(cps.shape[1]):
        h = mixed(h * BASE + cps[:, i])
    return h


def group_of(cps: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """By the two characters before the last of a gram, a number that picks its shard."""
    return (key_of(cps[:, -3:-1], seed, "b") >> np.uint64(34)).astype(np.int64)


def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, value, group (-1: in every shard) of the model's rows."""
    for batch in batches:
        grams = np.array(batch.column("gram").to_pylist(), dtype=object)
        kinds = np.array(batch.column("kind").to_pylist(), dtype=object)
        seed = seeds(batch.column("model").to_numpy())
        sizes = np.array([len(g) for g in grams], dtype=np.int64)
        key, group = np.zeros(len(grams), dtype=np.uint64), np.full(len(grams), -1, dtype=np.int64)
        for size in np.unique(sizes):
            for kind in "pb":
                at = np.flatnonzero((sizes == size) & (kinds == kind))
                if len(at):
                    cps = np.frombuffer("".join(grams[at]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), size)
                    key[at] = key_of(cps, seed[at], kind)
                    if kind == "p" and size >= 3:
                        group[at] = group_of(cps, seed[at])
                    elif kind == "b" and size >= 2:
                        # Of a context, the characters that come before the last of a gram are its own last ones.
                        group[at] = group_of(np.hstack([cps, cps[:, :1]]), seed[at])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("value"), pa.array(group)], ["hash", "value", "group"])


class Model:
    """One shard: hashes in ascending order and their values."""

    def __init__(self, rows: pa.Table, place: int = 0, shards: int = 1):
        keys = rows.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], rows.column("value").to_numpy()[order]
        self.place, self.shards = place, shards
        self.recent_keys = self.recent_values = None  # made by each task's worker

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.values[at]

    def log_probability(self, cps: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Of the last character of each row after the others, backing off to shorter contexts."""
        out = np.zeros(len(cps))
        left = np.arange(len(cps))
        for size in range(ORDER, 0, -1):
            known, value = self.find(key_of(cps[left, ORDER - size :], seed[left], "p"))
            out[left[known]] += value[known]
            left = left[~known]
            has, back = self.find(key_of(cps[left, ORDER - size : -1], seed[left], "b"))
            out[left[has]] += back[has]
        out[left] -= np.log(ALPHABET)
        return out

    def sums(self, group: list[str], models: np.ndarray) -> np.ndarray:
        """For each text the log-probabilities of the n-grams of this shard, summed."""
        out = np.zeros(len(group))
        parts = stretches(group)
        seed_of = seeds(models)
        for a, b in runs([len(p) for _, p in parts], CHUNK):
            cps, ends, text = windows([p for _, p in parts[a:b]])
            if not len(ends):
                continue
            owner = np.array([i for i, _ in parts[a:b]])[text]
            key = rolled(cps, ends) ^ seed_of[owner]
            slot, known, value = self.recall(key)
            new = np.flatnonzero(~known)
            if len(new):
                _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
                first = new[first]
                grams, seed = cps[ends[first][:, None] + np.arange(1 - ORDER, 1)], seed_of[owner[first]]
                found = np.zeros(len(first))
                mine = np.arange(len(first)) if self.shards == 1 else np.flatnonzero(group_of(grams, seed) % self.shards == self.place)
                found[mine] = self.log_probability(grams[mine], seed[mine])
                # Rounded, so that sums don't depend on how a text was cut.
                found = np.round(found * 2**20)
                value[new] = found[which]
                self.recent_keys[slot[first]], self.recent_values[slot[first]] = key[first], found
            out += np.bincount(owner, value, minlength=len(group))
        return out / 2**20

    def recall(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each n-gram its slot among RECENT ones, whether it is the one in there, and the value there."""
        if self.recent_keys is None:
            self.recent_keys, self.recent_values = np.zeros(1 << RECENT, np.uint64), np.zeros(1 << RECENT)
            self.recent_keys[0] = 1  # no key of slot 0
        slot = (key * BASE >> np.uint64(64 - RECENT)).astype(np.int64)
        return slot, self.recent_keys[slot] == key, self.recent_values[slot]


class Shards:
    """A model as a table of hashes, from which one shard at a time is taken."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n = max(1, -(-rows.count() // SHARD))

    def take(self, place: int) -> Model:
        """Brings one shard to the driver: about SHARD entries, and what all shards share."""
        own = self.rows.where((F.col("group") < 0) | (F.col("group") % self.n == place))
        return Model(own.select("hash", "value").toArrow(), place, self.n)


def train(docs: DataFrame) -> Shards:
    """The model of documents with text and model."""
    entries = kneser_ney(written(count_grams(docs), "grams"))
    return Shards(written(entries.mapInArrow(hash_batches, "hash bigint, value float, group bigint"), "model"))


def word_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows_ = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows_)) < len(windows_):
        times, covered = Counter(windows_), 0
        for i, w in enumerate(windows_):
            if times[w] > 1:
                repeated += i + 3 - max(covered, i)
                covered = i + 3
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(rows: DataFrame, shards: Shards) -> DataFrame:
    """rows (text, model, others) with the counts and loss: the mean negative log-probability, null if empty. The text
    itself goes along with a packed row only."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "text" or "row" in rows.columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def loss(total: np.ndarray, group: list[str]) -> list:
        return [-x / n if (n := len(t.lower())) else None for x, t in zip(total.tolist(), group, strict=True)]

    if shards.n == 1:
        shared = spark.sparkContext.broadcast(shards.take(0))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                group = strings(batch.column("text"))
                counts = list(zip(*map(word_counts, group), strict=True)) or [[]] * 5
                total = model.sums(group, batch.column("model").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in counts), pa.array(loss(total, group), pa.float64())], [*names, *MEASURES, "loss"])

        return rows.mapInArrow(whole, ", ".join([kinds, *(f"{m} bigint" for m in MEASURES), "loss double"]))
    # A pass for each shard; the sums of equal texts meet by a hash, with which they come back to the rows.
    keyed = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")), "model"))
    parts = None
    for place in range(shards.n):
        shared = spark.sparkContext.broadcast(shards.take(place))

        def one(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.sums(strings(batch.column("text")), batch.column("model").to_numpy()))], ["key", "total"])

        part = written(keyed.select("key", "text", "model").dropDuplicates(["key"]).mapInArrow(one, "key bigint, total double"), "sums")
        shared.unpersist()
        parts = part if parts is None else parts.union(part)
    sums = parts.groupBy(F.col("key").alias("s_key")).agg(F.sum("total").alias("total"))
    met = keyed.join(sums, F.col("key") == F.col("s_key"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = strings(batch.column("text"))
            counts = list(zip(*map(word_counts, group), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in counts), pa.array(loss(batch.column("total").to_numpy(), group), pa.float64())], [*names, *MEASURES, "loss"])

    return met.select(*dict.fromkeys([*names, "text", "total"])).mapInArrow(counted, ", ".join([kinds, *(f"{m} bigint" for m in MEASURES), "loss double"]))


def quartiles(rows: DataFrame) -> DataFrame:
    """model, low, high: the quartiles of the loss, as bins of a histogram. rows: model, loss."""
    bins = rows.where("loss is not null").groupBy("model", F.floor(F.col("loss") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    # A model has at most log(ALPHABET) * BINS bins or so, whatever the corpus.
    upto = Window.partitionBy("model").orderBy("bin")
    ranked = bins.select("model", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("model")).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / BINS
    return ranked.groupBy("model").agg(at(0.25).alias("low"), at(0.75).alias("high"))


def judged(rows: DataFrame, again: bool) -> DataFrame:
    """rows (text, lang and others) with model, the counts, loss, base_failed and kept; without lang. again: documents
    are scored a second time, once their bands are known, instead of writing them all to disk."""
    langs = languages(rows)
    rows = rows.withColumn("model", model_of(langs)).drop("lang")
    plain = rows.select(F.coalesce("text", F.lit("")).alias("text"), "model")
    shards = train(plain)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = scored(rows, shards)
    if not again:
        out = written(out, "scored")
    bands = quartiles((scored(plain, shards) if again else out).where(~failed)).collect()  # a row for each model
    reach = lambda b: b.high - b.low + 0.01
    band = F.create_map(*(x for b in bands for x in (F.lit(b.model), F.array(F.lit(b.low - BELOW * reach(b)), F.lit(b.high + ABOVE * reach(b))))))
    inside = F.lit(True)
    if bands:
        own = F.try_element_at(band, F.col("model"))
        inside = F.coalesce(F.col("loss").between(own[0], own[1]), F.lit(True))
    name = F.element_at(F.array(*map(F.lit, [*langs, OTHER])), F.col("model") + 1)
    return out.withColumn("base_failed", failed).withColumns({"kept": ~F.col("base_failed") & inside, "model": name})


def report(docs: DataFrame) -> DataFrame:
    """One row for each document."""
    rows = judged(chosen(docs, ("doc_id", "bigint"), ("text", "string"), ("lang", "string")), again=False)
    return rows.select("doc_id", *MEASURES, "base_failed", "kept", F.exp("loss").alias("perplexity"), "model")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass; all their columns stay."""
    return unpacked(judged(packed(docs, ("text", "string"), ("lang", "string")), again=True).where("kept"), docs)
