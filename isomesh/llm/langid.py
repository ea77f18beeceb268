"""Language identification by fusing evidence with Bayes' rule.

For each document: the likelihood of its text under letter-trigram models, one per language and a uniform one
for "no known language"; the declared markup language, weighed by how often each declaration goes with each
language; and a prior by host, smoothed towards its address suffix, which is smoothed towards the whole corpus.
Trigram counts, declarations and priors come from grouped aggregation over all rows. The known languages are those
that one row in LEAST_SHARE declares. A rarer one can't be learnt: where the text is none of the known ones for sure, its
declaration stands, if it is a language's code, and the text is kept.

Defined results: null text counts as empty. A text without letters, or whose best language has a posterior
under LEAST, or for which the uniform model wins, is "und" and rejected, but for the declarations of rare languages. Null hosts and declarations are
values of their own; a host without a dot has no suffix. Repeated rows each count and each give a row. Extra columns,
whatever their names, are ignored by the report and kept by ``keep_identified``. In an empty table, or one without
declared languages, nothing can be learnt, and texts come out as "und".
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomesh.llm.codes import lowered, points
from isomesh.llm.work import chosen, let, packed, runs, strings, unpacked, written

#: Production parameters. LEAST_SHARE: a language is known if one row in so many declares it.
LEAST, LEAST_SHARE = 0.5, 1000
#: What a declaration looks like that names a language.
CODE = r"^[a-z]{2,3}([-_][a-z0-9]+)*$"
#: Trigrams are hashed to so many bits.
BITS = 16
#: A text counts as at most so many independent trigrams.
EFFECTIVE = 60
#: Weight of the suffix's prior in a host's, of the corpus's in a suffix's; share of texts in no known language.
HOST_WEIGHT, SUFFIX_WEIGHT, UNKNOWN = 20.0, 200.0, 0.01
#: Likelihoods (code points times languages) that a task works out at once.
CHUNK = 2_000_000
#: The hosts' priors are broadcast up to so many bytes; beyond, hosts are dealt out over so many tasks each.
BROADCAST, SALTS = 32 << 20, 16


def languages(rows: DataFrame) -> list[str]:
    """The known languages, LEAST_SHARE at most. rows: declared."""
    total = rows.count()
    found = rows.groupBy("declared").agg(F.count("*").alias("n")).where((F.col("n") * LEAST_SHARE >= total) & F.col("declared").isNotNull())
    return sorted(r.declared for r in found.collect() if r.declared.strip())


def parts_of(group: list[str], most: int) -> list[tuple[int, str, bool]]:
    """Texts as (place, characters, continued), long ones in stretches that overlap by two characters."""
    return [(i, t[max(0, a - 2) : a + most], a > 0) for i, t in enumerate(group) for a in range(0, max(1, len(t)), most)]


def trigrams(group: list[str], continued: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letter trigrams of texts end to end, which of them count, and where texts begin. Those that go on from an
    earlier stretch have counted the trigrams that end at their first two characters."""
    cps, begins = points(group, 2)
    c = lowered()[cps].astype(np.uint32)
    code = np.zeros(len(c), dtype=np.uint32)
    code[2:] = ((c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - BITS)
    real = np.zeros(len(c), dtype=bool)
    real[2:] = (c[2:] > 32) | (c[1:-1] > 32)
    real[begins] = real[begins + 1] = False
    on = begins[np.array(continued, dtype=bool)]
    real[on + 2] = real[on + 3] = False
    return code, real, begins


def train(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probabilities, trigram by language, from the rows that declare one. Collects at most
    len(langs) * 2**BITS sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            group, declared = strings(batch.column("text")), batch.column("declared").to_pylist()
            for lang in set(declared):
                total = counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                parts = parts_of([t for t, d in zip(group, declared, strict=True) if d == lang], CHUNK // 4)
                for a, b in runs([len(p) + 2 for _, p, _ in parts], CHUNK // 4):
                    code, real, _ = trigrams([p for _, p, _ in parts[a:b]], [c for *_, c in parts[a:b]])
                    total += np.bincount(code[real], minlength=1 << BITS)
        for lang, total in counts.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(total[found])], ["lang", "gram", "n"])

    table = np.full((1 << BITS, len(langs)), 0.1)
    if langs:
        counts = rows.where(F.col("declared").isin(*langs)).select("text", "declared").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        at = {a: i for i, a in enumerate(langs)}
        columns = np.array([at[a] for a in counts.column("lang").to_pylist()], dtype=np.int64)
        table[counts.column("gram").to_numpy(), columns] += counts.column("n").to_numpy()
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows and ll: log-likelihoods of the text by language, the uniform model's last; null without a letter. The text
    itself goes along with a packed row only."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "text" or "row" in rows.columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    n_langs = model.shape[1]
    most = max(2, CHUNK // (n_langs + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            group = strings(batch.column("text"))
            sums, times = np.zeros((len(group), n_langs)), np.zeros(len(group), dtype=np.int64)
            parts = parts_of(group, most)
            for a, b in runs([len(p) + 2 for _, p, _ in parts], most):
                code, real, begins = trigrams([p for _, p, _ in parts[a:b]], [c for *_, c in parts[a:b]])
                score = model[code]
                score[~real] = 0
                own = [i for i, *_ in parts[a:b]]
                np.add.at(times, own, np.add.reduceat(real, begins, dtype=np.int64))
                np.add.at(sums, own, np.add.reduceat(score, begins, axis=0, dtype=np.float64))
            mean = sums / np.maximum(times, 1)[:, None]
            ll = np.hstack([mean, np.full((len(group), 1), -BITS * np.log(2))]) * np.minimum(times, EFFECTIVE)[:, None]
            out = [x.tolist() if k else None for x, k in zip(ll, times, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], [*names, "ll"])

    return rows.mapInArrow(run, f"{kinds}, ll array<double>")


def softmax(logs: Column) -> Column:
    """Probabilities from an array of log-weights."""
    raw = lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    share = lambda x: let(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(x, lambda v: v / total))
    return let(let(logs, raw), share)


class Evidence(NamedTuple):
    """What the corpus says of declarations (log-probabilities by language) and hosts (host, suffix, prior)."""

    langs: list[str]
    reliance: dict[str, list[float]]
    prior: DataFrame


def named(langs: list[str]) -> Column:
    """The declaration if it is a known language, else "?" for others and "-" for none."""
    return F.when(F.col("declared").isin(*langs), F.col("declared")).when(F.col("declared").isNull(), F.lit("-")).otherwise(F.lit("?"))


def gather(alone: DataFrame, langs: list[str]) -> Evidence:
    """alone: ll, declared, host, suffix."""
    n = len(langs)
    p = alone.where("ll is not null").select("declared", "host", "suffix", softmax(F.col("ll")).alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    hosts = written(p.groupBy("host", "suffix", named(langs).alias("named")).agg(*sums), "hosts")
    # One row for each of the known declarations: bounded.
    said = {r[0]: list(r[1:]) for r in hosts.groupBy("named").agg(*again).collect()}
    kinds = [*langs, "?", "-"]
    total = [sum(v[i] for v in said.values()) + 1.0 for i in range(n)]
    reliance = {d: [float(np.log((said.get(d, [0.0] * n)[i] + 1.0) / (total[i] + len(kinds)))) for i in range(n)] for d in kinds}
    everywhere = [t / sum(total) for t in total]
    all_of = sum((F.col(f"s{i}") for i in range(n)), F.lit(0.0))
    smooth = lambda weight, prior: F.array(*((F.col(f"s{i}") + weight * prior[i]) / (all_of + weight) for i in range(n)))
    suffix = hosts.groupBy("suffix").agg(*again).select(F.col("suffix").alias("s"), smooth(SUFFIX_WEIGHT, [F.lit(float(x)) for x in everywhere]).alias("by_suffix"))
    host = hosts.groupBy("host", "suffix").agg(*again).join(suffix, F.col("suffix").eqNullSafe(F.col("s")), "left")
    prior = host.select(F.col("host").alias("h"), F.col("suffix").alias("hs"), smooth(HOST_WEIGHT, F.col("by_suffix")).alias("prior"))
    return Evidence(langs, reliance, written(prior, "prior"))


def fuse(scored: DataFrame, known: Evidence) -> DataFrame:
    """Adds posterior (by language, "no known language" last; null without a letter) to rows with ll, declared,
    host, suffix."""
    n, prior = len(known.langs), known.prior
    size = prior.agg(F.count("*"), F.sum(F.coalesce(F.length("h"), F.lit(0)))).first()
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("hs"))
    if size[0] * (64 + 8 * n) + 4 * (size[1] or 0) <= BROADCAST:
        joined = scored.join(F.broadcast(prior), same, "left")
    else:
        many = prior.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = scored.withColumn("own_salt", F.pmod(F.xxhash64("ll"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(many, same & (F.col("own_salt") == F.col("salt")), "left").drop("salt", "own_salt")
    rely = F.element_at(F.create_map(*(x for d, v in known.reliance.items() for x in (F.lit(d), F.array(*map(F.lit, v))))), named(known.langs))
    # A declaration says nothing about texts in no known language.
    unknown = F.element_at("ll", n + 1) + float(np.log(UNKNOWN)) + F.array_min(rely)
    logs = F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("ll")[i] + rely[i] + F.log(F.col("prior")[i] * (1 - UNKNOWN))), F.array(unknown))
    return joined.withColumn("posterior", F.when(F.col("ll").isNotNull(), softmax(logs))).drop("h", "hs", "prior")


def identified(rows: DataFrame, again: bool) -> DataFrame:
    """rows (text, declared, host, suffix and others) with language ("und" if none is sure enough),
    probability and kept. again: likelihoods are worked out a second time instead of writing all columns to disk."""
    langs = languages(rows)
    model = train(rows, langs)
    code = F.coalesce(F.col("declared").rlike(CODE), F.lit(False))
    if not langs:
        stands = code & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return rows.withColumns({"language": F.when(stands, F.col("declared")).otherwise("und"), "probability": F.lit(0.0), "kept": stands})
    narrow = rows.select("text", "declared", "host", "suffix") if again else rows
    alone = written(likelihoods(narrow, model), "likelihoods")
    fused = fuse(likelihoods(rows, model) if again else alone, gather(alone, langs))
    best = F.array_max("posterior")
    at = F.array_position("posterior", best).cast("int")
    sure = F.coalesce((best >= LEAST) & (at <= len(langs)), F.lit(False))
    stands = ~sure & code & ~F.col("declared").isin(*langs) & F.col("ll").isNotNull()
    found = F.when(sure, F.element_at(F.array(*map(F.lit, langs), F.lit("und")), at)).when(stands, F.col("declared")).otherwise("und")
    return fused.withColumns({"kept": sure | stands, "language": found, "probability": F.coalesce(best, F.lit(0.0))}).drop("posterior", "ll")


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))


def evidence_of_documents(rows: DataFrame) -> DataFrame:
    """Documents have a declared language in ``lang`` and a host in ``source``."""
    host = F.lower("source")
    return rows.withColumns({"declared": F.lower(F.trim("lang")), "host": host, "suffix": suffix_of(host)}).drop("lang", "source")


WANTED = ("text", "string"), ("lang", "string"), ("source", "string")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document."""
    found = identified(evidence_of_documents(chosen(docs, ("doc_id", "bigint"), *WANTED)), again=False)
    return found.select("doc_id", "declared", "language", F.round("probability", 6).alias("probability"), "kept")


def report_pages(pages: DataFrame) -> DataFrame:
    """Of raw pages: the declared language is the html element's, host and suffix are the address's."""
    plain = chosen(pages, ("page_id", "bigint"), ("url", "string"), ("html", "string")).fillna("", ["html"])
    host = F.lower(F.nullif(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))
    declared = F.lower(F.nullif(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&#?[a-zA-Z0-9]+;", " ")
    rows = plain.select("page_id", bare.alias("text"), declared.alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"))
    return identified(rows, again=False).select("page_id", "host", "declared", "language", F.round("probability", 6).alias("probability"), "kept")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in a known language; all their columns stay, ``lang`` becomes what was found."""
    found = identified(evidence_of_documents(packed(docs, *WANTED)), again=True)
    return unpacked(found.where("kept"), docs, lang=F.col("language"))
