"""Fill-in-the-middle: a text is cut into prefix, middle and suffix by its id, and put together with sentinels.

The units are lines. The cuts and the form come from the SHA-256 of a seed and the document's id, so every run and
every partitioning gives the same. All is Spark SQL functions on the row itself: no shuffle, no Python.

Defined results: null text counts as empty and stays plain; a text that holds a sentinel stays plain, since it could
not be told apart again; a null id hashes as the empty string. Repeated rows each give a row. Extra columns are ignored
by the report and kept by ``transform``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isomesh.llm.work import packed, texts, unpacked

#: Production parameters: seed of the hashes; percentages of texts taken apart, and of these put suffix first.
SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Lines with their end; possessive, so that a long last line is read once.
UNIT = r"[^\n]*+\n|[^\n]++"


def drawn(digest: Column, i: int) -> Column:
    """The i-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("bigint")


def cut(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` (doc_id, text without nulls, others) with n, form and prefix, middle, suffix; these are null if plain."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.withColumns({"units": F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), "digest": digest}).withColumn("n", F.size("units").cast("bigint"))
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | marked | (drawn(F.col("digest"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(drawn(F.col("digest"), 4) % 100 < spm_rate, "spm").otherwise("psm")
    at = [drawn(F.col("digest"), i) % (F.col("n") + 1) for i in (1, 2)]
    rows = rows.withColumns({"form": form, "first": F.least(*at).cast("int"), "second": F.greatest(*at).cast("int")})
    part = lambda a, b: F.when(F.col("form") != "plain", F.array_join(F.slice("units", a + 1, b - a), ""))
    first, second, n = F.col("first"), F.col("second"), F.col("n").cast("int")
    parts = {"prefix": part(F.lit(0), first), "middle": part(first, second), "suffix": part(second, n)}
    return rows.withColumns(parts).drop("units", "digest", "first", "second")


def arranged() -> Column:
    """The output, of text, form and the parts."""
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    return F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("text"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The sentinels stand once each, as no taken text has one."""
    after = lambda mark: F.substring_index(output, mark, -1)
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(MIDDLE)
    psm = F.concat(upto(after(PREFIX), SUFFIX), middle, upto(after(SUFFIX), MIDDLE))
    spm = F.concat(upto(after(PREFIX), MIDDLE), middle, upto(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with the arranged text and its n_chars in their place; all rows and columns stay."""
    rows = packed(docs, ("doc_id", "bigint"), ("text", "string")).withColumn("held", F.col("text").isNotNull()).fillna("", ["text"])
    done = cut(rows, seed, rate, spm_rate).withColumn("output", F.when(F.col("held"), arranged()))
    return unpacked(done.withColumn("text", F.col("output")), docs, text=F.col("output"), n_chars=F.length("output").cast("bigint"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document."""
    made = cut(texts(docs)).withColumn("output", arranged())
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The report for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM t),
c AS (
  SELECT *, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(units[1:least(a, b)], '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(units[least(a, b) + 1:greatest(a, b)], '') END AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
