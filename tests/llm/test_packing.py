"""Packing: an exact round trip of all ids, within the limits, with little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from isomesh.llm import packing, tokens
from tests.llm.helpers import odd_documents, small_documents

TEXTS = [None, "", "a", "The cat's  hat \n b", " lead", "trail ", "<|endoftext|> x", "end <|endoftext|> go", "é𝒳 日本 \t x", "x" * 9000, "one two " * 3000, "don't we'll 123 4,5"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    return lambda text: plain.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(library, spark):
    own = tokens.BytePieces(tokens.vocabulary("byte_bpe_50k.json"))
    for text in [t or "" for t in TEXTS] + [r.text for r in small_documents(spark).limit(60).collect()]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library(text)
    assert library("end <|endoftext|> go")[2] == 50256


def test_every_id_in_one_piece(spark, library):
    docs = odd_documents(spark, TEXTS).select("doc_id", "text").union(small_documents(spark).select("doc_id", "text")).where("doc_id is not null").cache()
    rows = packing.pack_documents(docs.repartition(3)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    expected = defaultdict(list)
    for d in docs.collect():
        expected[d.doc_id].append([*library(d.text or ""), 0])
    for doc_id, whole in expected.items():
        assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, whole))
        if len(whole) == 1:
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r.start):
                assert (r.start, r.ids, r.doc_tokens) == (at, whole[0][at : at + r.length], len(whole[0]))
                assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
                at += r.length
    padding = 0
    for pieces in by_sequence.values():
        assert len(pieces) <= packing.SEGMENTS
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * sum(r.length for r in rows)


def test_limits_hold_at_once():
    limits = packing.Limits(tokens=64, segments=3, loss=20)
    packer = packing.Packer(limits, waiting=16)
    rng = np.random.default_rng(1)
    demand, placed = {}, []
    for i in range(300):
        loss = rng.random(n := int(rng.integers(1, 150))) < 0.3
        demand[i] = loss
        placed += packer.add(i, n, np.concatenate([[0], np.cumsum(loss)]))
        while packer.full():
            placed += packer.fill(64)
    placed += packer.drain()
    assert sum(p.length for p in placed) == sum(map(len, demand.values()))
    covered = {(p.example, p.start + k) for p in placed for k in range(p.length)}
    assert len(covered) == sum(map(len, demand.values()))
    by = defaultdict(list)
    for p in placed:
        by[p.sequence].append(p)
    for pieces in by.values():
        assert sum(p.length for p in pieces) <= 64 and len(pieces) <= 3
        assert sum(int(demand[p.example][p.start : p.start + p.length].sum()) for p in pieces) <= 20


def test_turns_and_empty_table(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b c " * 400), (1, 1, "assistant", "d e f " * 400), (2, 0, None, None)], "conv_id bigint, turn bigint, role string, text string")
    rows = packing.pack_turns(turns, packing.Limits(1024, 8, 100)).collect()
    loss = defaultdict(int)
    for r in rows:
        loss[r.sequence_id] += r.length * (r.turn == 1)
    assert max(loss.values()) <= 100
    assert packing.report(turns.where("false").withColumn("doc_id", turns.conv_id)).count() == 0


def test_loss_limit_binds_in_conversations(spark):
    from isomesh.llm import queries

    rows = [(i, k, role, f"{role} says word number {i} " * 60) for i in range(12) for k, role in enumerate(("user", "assistant", "assistant", "assistant"))]
    said = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    used, lost = {}, {}
    for r in packing.report_turns(said).collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        lost[r.sequence_id] = lost.get(r.sequence_id, 0) + r.length * (r.turn > 0)
    assert max(used.values()) <= packing.LENGTH and max(lost.values()) == packing.TURN_LIMITS.loss < packing.LENGTH
    assert "vector_packing_turns" in queries.QUERIES


def test_limits_must_be_positive():
    for limits in (packing.Limits(loss=0), packing.Limits(tokens=0), packing.Limits(segments=0)):
        with pytest.raises(ValueError, match="1 or more"):
            packing.Packer(limits)
