"""Pieces against the library that the vocabulary is for, the relational form, and exact round trips."""

import pytest
import sentencepiece

from isomesh.llm import pieces
from tests.llm.helpers import odd_documents, small_documents

TEXTS = [None, "", " ", "  ", "a  b", "  lead", "trail  ", "x\ty\n\nz", "ﬁ é Ａ", "日本𝒳 text", "The quick brown fox's 12,345 jumps!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "Donaudampfschifffahrtsgesellschaft " * 20, "a" * 23, "a" * 24, "a" * 25, "\0 nul", "a b" * 5]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary(pieces.MODEL))


def test_ids_equal_the_library(spark, library):
    docs = odd_documents(spark, TEXTS).select("doc_id", "text", "score").unionByName(small_documents(spark).select("doc_id", "text"), allowMissingColumns=True)
    rows = docs.collect()
    got = sorted((str(r.doc_id), r.n_chars, r.ids) for r in pieces.encode(docs).collect())
    assert got == sorted((str(r.doc_id), len(r.text or ""), library.encode(r.text or "")) for r in rows)


def test_round_trip(spark):
    coded = pieces.encode(odd_documents(spark, TEXTS).where("doc_id is not null"))
    assert coded.where("not round_trip").count() == 0
    texts = sorted((r.doc_id, r.text) for r in pieces.decode(coded).collect())
    assert texts == sorted((r.doc_id, r.text or "") for r in odd_documents(spark, TEXTS).where("doc_id is not null").collect())
    assert pieces.encode(odd_documents(spark, TEXTS).where("false")).count() == 0


def test_relational_form_agrees(spark):
    units = sorted({u for r in small_documents(spark).limit(5).collect() for u in pieces.UNIT.findall(pieces.SPACE + r.text.replace(" ", pieces.SPACE)) if len(u) <= 24 and "\n" not in u})[:300]
    table = pieces.loaded(pieces.vocabulary(pieces.MODEL))
    units = [u for u in units if all(c in table.ids for c in u)]
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(u,) for u in units], "word string")).collect()}
    assert got == {u: table.fold_one(u) for u in units} and len(got) > 200
