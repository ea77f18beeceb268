"""Documents for the tests: odd cases besides rows of the driver's tables."""

from pathlib import Path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, row_key string"


def odd_documents(spark, texts):
    """A table of documents with nulls in every other column and extra columns with clashing names."""
    rows = [(i if i % 7 else None, t, None if i % 3 else "en", None if i % 2 else "s", None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts, 1)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA)


def small_documents(spark):
    assert Path(SMALL).exists()
    return spark.read.parquet(f"{SMALL}/documents.parquet")
