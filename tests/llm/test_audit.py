"""The filter audit against plain counting, with real and colliding fingerprints."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from isomesh.llm import audit
from tests.llm.helpers import SCHEMA, odd_documents, small_documents

LONG = " ".join(f"w{i}" for i in range(120))
ODD = [None, "", " \t\n", "A" * 50, "few words", LONG, LONG, LONG + " ", LONG + " $", "same " * 200, "same " * 200, LONG.upper(), "é\u00a0" * 200, "", "x" * 100000, "a b " * 40000, LONG + " |", LONG]
LABELS = "doc_id bigint, quality int, toxic int, text string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, x in (("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", re.search("[#$%&*|]", text))) if x}


def plainly(docs, labels):
    least = {}
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    one = lambda i: {r.doc_id for r in labels if r[i] == 1 and r.doc_id is not None}
    good, toxic = one("quality"), one("toxic")
    rows = [(r.lang or "", fails(r.text or "") | ({"E"} if r.doc_id is not None and r.doc_id > least[r.text or ""] else set()), r.doc_id) for r in docs]
    out = {}
    for part in {x[0] for x in rows}:
        own, shapley = [x for x in rows if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                hit, stay = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                all_hit = [x for x in own if f in x[1]]
                out[part, order, step] = [len(stay), len(hit), len(all_hit) - len(hit), sum(x[1] == {f} for x in own), sum(x[2] in good for x in hit), sum(x[2] in toxic for x in hit)]
                shapley[f] += len(hit)
                left = stay
        for order, step in {k[1:] for k in out if k[0] == part}:
            out[part, order, step].append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("print_", [None, "cast(5 as bigint)", "cast(length(text) as bigint)"])
def test_report(spark, print_):
    fingerprint = print_ and F.expr(print_)
    docs = odd_documents(spark, ODD).select("doc_id", "text", "lang").union(small_documents(spark).select("doc_id", "text", "lang")).repartition(5)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, None, 1, "x"), (None, 1, 1, "x"), (6, 1, 1, None), (8, 0, None, None)], LABELS)
    labels = labels.union(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").selectExpr("doc_id", "quality", "toxic", "'' text"))
    got = audit.report(docs, labels, fingerprint).collect()
    assert len(got) == len({tuple(g) for g in got})
    assert {tuple(g) for g in got} == plainly(docs.collect(), labels.collect())


def test_chains_are_sent_on_when_they_hold_much(spark, monkeypatch):
    rows = [(hash(t), i, t, "p") for i, t in enumerate(["aaaa", "bb", "aaaa", "cccc", "aaaa", "bb"])]
    monkeypatch.setattr(audit, "HELD", 5)
    routed = sorted(audit.route(rows), key=lambda x: x[0])
    assert sum(e[0] is not None for _, e in routed) > 3
    assert sorted((i, bool(m & audit.COPY)) for i, _, m, _ in audit.settle(routed)) == [(0, False), (1, False), (2, True), (3, False), (4, True), (5, True)]


def test_smaller_ids_that_come_later():
    rows = [(1, 9, "t", "p"), (1, 9, "t", "q"), (1, 4, "t", "p"), (1, 4, "t", "p"), (1, 7, "u", "p")]
    out = sorted(audit.settle(sorted(audit.route(rows), key=lambda x: x[0])))
    assert [(i, p, bool(m & audit.COPY), n) for i, p, m, n in out] == [(4, "p", False, 2), (7, "p", False, 1), (9, "p", True, 1), (9, "q", True, 1)]


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert audit.report(none, labels).count() == 0
    rows = audit.report(odd_documents(spark, [None]), labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}


def test_lost_rows_are_an_error(spark, monkeypatch):
    docs, labels = odd_documents(spark, ODD), spark.createDataFrame([], LABELS)
    whole = audit.masked(docs).collect()
    lost = spark.createDataFrame(whole[1:], "doc_id bigint, part string, mask int, n bigint")
    monkeypatch.setattr(audit, "masked", lambda *_: lost)
    with pytest.raises(Exception, match="lost or doubled"):
        audit.report(docs, labels).collect()
