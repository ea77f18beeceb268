"""Fill-in-the-middle against plain Python."""

import hashlib
import re

from isomesh.llm import middle
from tests.llm.helpers import SCHEMA, odd_documents, small_documents

ODD = [None, "", " ", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "é𝒳\r\n\u2028x\n日本", "holds <M> itself\nb", "<p>\nlower <s>\n", "$1 \\2\n%s\n", "x" * 200000, "a\n" * 50000, "b" * 100000 + "\n" + "c" * 100000, "<P>", "< P>\n<S", "a\nb\nc"]


def plainly(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_report_and_restored_texts(spark):
    docs = odd_documents(spark, ODD).select("doc_id", "text").union(small_documents(spark).select("doc_id", "text"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(r.doc_id, *(x := plainly(r.doc_id, r.text))[:4], sha(x[4]), sha(r.text or "")) for r in docs.collect()]
    got = [tuple(r) for r in middle.report(docs).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}


def test_transform_keeps_rows_and_columns(spark):
    docs = odd_documents(spark, ODD)
    for rate, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        done = middle.transform(docs, rate=rate, spm_rate=spm)
        assert done.schema.simpleString() == docs.schema.simpleString()
        expected = sorted(str((r.doc_id, None if r.text is None else plainly(r.doc_id, r.text, rate, spm)[4], r.source, r.score)) for r in docs.collect())
        assert sorted(str((r.doc_id, r.text, r.source, r.score)) for r in done.collect()) == expected


def test_empty_table_and_clashing_names(spark):
    assert middle.report(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(3, "a\nb\n", "x", "y", "z")], "doc_id bigint, text string, units string, form string, DOC_ID string")
    assert middle.transform(docs).first()[2:] == ("x", "y", "z")
    assert middle.report(docs).first().n == 2


def test_no_python_and_no_shuffle(spark):
    plan = middle.report(small_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
