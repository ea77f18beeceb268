"""Personal data: proposed by patterns, confirmed by checksums, weighed by the words around them.

The main path is Spark SQL functions only. Every row is handled by itself: no shuffle, no broadcast.

Defined results: null text counts as empty; an empty text has no spans, counts of 0 and the SHA-256 of the
empty string. Repeated rows each give a row. Positions are code points, the end is exclusive. Extra columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomesh.llm.work import let, texts


class Kind(NamedTuple):
    """A kind of personal data. ``hint`` is a cheap test that every text with a match passes."""

    name: str
    pattern: str
    hint: str
    confirm: Callable[[Column], Column]
    prior: float
    context: str
    base: bool = True


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a digit string passes the Luhn check."""
    backwards = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(part(i), F.lit(0)))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account number's remainder by 97 is 1, its first four characters moved to the end."""
    plain = F.regexp_replace(code, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        value = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(value < 65, (acc * 10 + value - 48) % 97).otherwise((acc * 100 + value - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def between(s: Column, low: int, high: int) -> Column:
    return F.length(only_digits(s)).between(low, high)


#: Characters of an account number, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())


# The patterns start only where a match of the plain pattern can be leftmost, and take runs whole, so that long
# runs of word characters or digits cost linear time.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.7, r"mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")), 0.6, r"\bip\b|host|server|address|from"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", lambda m: F.when(between(m, 13, 19), luhn(only_digits(m))).otherwise(False), 0.8, r"card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: between(m, 9, 15), 0.6, r"phone|call|tel\b|tel:|mobile|fax"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])", "", mod97, 0.8, r"iban|account|bank|konto", base=False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, r"\bssn\b|social security|national id|tax id", base=False),
)
#: Code points before and after a span, up to the next of its kind, in which a context word counts, and what it adds.
NEAR, NEARBY = 48, 0.3


def spans_of(text: Column, kind: Kind) -> Column:
    """The kind's spans in a text as array<struct<kind,start,end,score>>, in order of their start.

    Places are running sums of lengths. A fold that appends to an array copies it each time, so matches are folded in
    blocks of about the root of their number, whose own places come from a fold over the blocks' lengths: for n matches
    that takes n ** 1.5 steps, not n ** 2.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    word = lambda s: F.lower(s).rlike(kind.context)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        near = word(F.right(x["gap"], F.lit(NEAR))) | word(F.left(x["after"], F.lit(NEAR)))
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), F.when(near, F.lit(min(1.0, kind.prior + NEARBY))).otherwise(F.lit(kind.prior)).alias("score"))
        kept = F.coalesce(kind.confirm(x["match"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(kept, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def blocks(parts: Column) -> Column:
        n = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(parts))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / n).cast("int")), lambda i: F.slice(parts, i * n + 1, n))

    def places(of: Column) -> Column:
        sizes = F.transform(of, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + F.length(x["gap"]) + F.length(x["match"])))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def folded(of: Column) -> Column:
        return F.flatten(F.zip_with(of, places(of), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    # What lies between matches gives their places: n matches, n + 1 gaps.
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    parts = let(F.split(text, kind.pattern, -1), lambda gaps: F.transform(matches, lambda m, i: F.struct(gaps[i].alias("gap"), m.alias("match"), gaps[i + 1].alias("after"))))
    spans = let(let(parts, blocks), folded)
    possible = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    return F.when(possible & text.rlike(kind.pattern), spans).otherwise(none)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, found: array of spans with scores, by kind as in KINDS, then start.

    Spans of the base kinds stay whatever their score; the others need ``least``, so a number shaped like a
    national id counts only where a context word stands near it.
    """
    docs = texts(docs)
    each = [F.filter(s, lambda x: x["score"] >= least) if not k.base else s for k in KINDS for s in [spans_of(F.col("text"), k)]]
    return docs.select("doc_id", F.concat(*each).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of their spans, and all spans."""
    found = F.col("found")
    base = [k.name for k in KINDS if k.base]
    of = lambda names: F.filter(found, lambda s: s["kind"].isin(names))
    return find_personal_data(docs).select(
        "doc_id",
        *(F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base),
        F.sha2(listed(of(base)), 256).alias("base_sha256"),
        listed(found).alias("spans"),
        F.transform(found, lambda s: s["score"]).alias("scores"),
    )
