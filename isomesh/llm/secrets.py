"""Secrets: certain ones by their form, weak ones only where complementary parts of a credential co-occur.

A scan of each text finds the base spans (assign, access, hex) and the parts of multipart credentials: access
identifiers, secrets and endpoints. An interval join within the document links weak parts to complementary
parts at most REACH code points away; only linked weak parts are reported.

Defined results: null text counts as empty; an empty text has no spans and the SHA-256 of the empty string.
Repeated rows each give a row. Positions are code points, the end is exclusive. Extra columns are ignored by the
report and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isomesh.llm.work import packed, texts, unpacked, written

#: The base kinds in their listed order, with the method's weak kinds after them.
KINDS = ("assign", "access", "hex", "login", "password", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LOGIN = re.compile(r"""(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
PASSWORD = re.compile(r"""(?:pwd|pass|credential|auth)["']?\x20*[:=]\x20*["']?[^\s"',;]{4,}""", re.I | re.A)
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|\b[a-z0-9][a-z0-9.-]{0,80}\.[a-z]{2,12}:[0-9]{2,5}\b""")
#: What a part is in a credential.
ROLES = {"access": "id", "login": "id", "assign": "secret", "hex": "secret", "password": "secret", "endpoint": "endpoint"}
#: Code points between parts of one credential at most.
REACH = 160
#: Bytes of found spans that are broadcast at most.
BROADCAST = 32 << 20

Span = tuple[int, int, int]  # start, place of its kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def mixed(s: str) -> bool:
    """True for a token that looks random: both cases, at least three digits."""
    return sum(c.isdigit() for c in s) >= 3 and s.lower() != s and s.upper() != s


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Parts that alone prove nothing: names of accounts, short or unnamed secrets, endpoints."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 3, m.end()) for m in LOGIN.finditer(text)]
        out += [(m.start(), 4, m.end()) for m in PASSWORD.finditer(text)]
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in LONG.finditer(text) if mixed(m[0])]
    starts = [a for a, _, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))
    free = lambda x: not (i := bisect_left(starts, x[2])) or ends[i - 1] <= x[0]
    return sorted({x for x in out if free(x)})


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = "struct<start:int,kind:int,end:int>"
SCANNED = f"doc_id bigint, row_key bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<{SPAN}>, weak array<{SPAN}>"


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64()] * 5 + [pa.string(), span, span]
    names = ["doc_id", "row_key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"]
    as_struct = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for text in batch.column("text"):
            base = base_spans(t := text.as_py())
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            weak = weak_spans(t, base)
            # Without two different roles nothing can be linked.
            if len({ROLES[KINDS[k]] for _, k, _ in base + weak}) < 2:
                weak = []
            row = [*counts, hashlib.sha256(listed(base).encode()).hexdigest(), as_struct(base), as_struct(weak)]
            for values, x in zip(out[2:], row, strict=True):
                values.append(x)
        arrays = [batch.column("doc_id"), batch.column("row_key"), *(pa.array(v, k) for v, k in zip(out[2:], kinds[2:], strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names)


def link(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """row_key, doc_id, linked: the weak spans that have a complementary part within reach in their document.

    Both sides are dealt by (row, bucket of positions). Parts of one bucket are bounded by its width, so a
    bucket's pairs are bounded too, however long the document.
    """
    width = 2 * reach
    role = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k]))), F.col("p.kind"))
    some = scanned.where(F.size("weak") > 0).dropDuplicates(["doc_id", "row_key"])
    flag = lambda spans, weak: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(weak).alias("is_weak")))
    parts = some.select("doc_id", "row_key", F.explode(F.concat(flag("base", False), flag("weak", True))).alias("p")).select("doc_id", "row_key", "p.*", role.alias("role"))
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width))).alias("bucket")
    # Two parts are near if one, widened by reach, meets the other; then they share a bucket.
    left = parts.where("is_weak").select("*", buckets(F.col("start") - reach, F.col("end") + reach))
    right = parts.select("doc_id", "row_key", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("role").alias("r_role"), buckets(F.col("start"), F.col("end")))
    near = (F.col("r_start") <= F.col("end") + reach) & (F.col("start") <= F.col("r_end") + reach)
    complementary = F.when(F.col("role") == "secret", F.col("r_role") != "secret").otherwise(F.col("r_role") == "secret")
    met = left.alias("l").join(right.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.row_key") == F.col("r.row_key")) & (F.col("l.bucket") == F.col("r.bucket")) & near & complementary, "left_semi")
    return met.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of id and text), counts and digest of the base spans, and found: array of all
    spans (start, place of the kind in KINDS, end) by start, then kind."""
    rows = texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    scanned = written(rows.mapInArrow(scan_batches, SCANNED), "secrets")
    linked = link(scanned).select(F.col("doc_id").alias("l_id"), F.col("row_key").alias("l_key"), "linked")
    out = scanned.join(linked, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("row_key") == F.col("l_key")), "left")
    found = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("linked"), F.array().cast(f"array<{SPAN}>"))))
    return out.select("doc_id", "row_key", "n_assign", "n_access", "n_hex", "base_sha256", found.alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans as text."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def mask(text: str, spans: list[dict]) -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] >= at:
            out += [text[at : s["start"]], "[secret]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the reported spans replaced by ``[secret]`` and n_chars set anew; all rows and columns stay."""
    found = find_secrets(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("id"), "row_key", "found").dropDuplicates(["id", "row_key"])
    found = written(found, "found")
    size = found.agg(F.count("*"), F.sum(F.size("found"))).first()
    keyed = packed(docs, ("doc_id", "bigint"), ("text", "string"), ("n_chars", "bigint")).withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    # Few documents have secrets; where they are many, both sides are dealt out by id and text.
    few = F.broadcast(found) if 64 * size[0] + 48 * (size[1] or 0) <= BROADCAST else found
    joined = keyed.join(few, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("row_key")), "left")

    @F.udf("string", useArrow=True)
    def masked(text: str | None, spans: list | None) -> str | None:
        return mask(text, spans) if text is not None and spans else text

    hit = F.col("found").isNotNull()
    # Other texts don't go to Python.
    done = joined.withColumn("new", masked(F.when(hit, F.col("text")), F.col("found")))
    done = done.withColumns({"text": F.when(hit, F.col("new")).otherwise(F.col("text")), "n_chars": F.when(hit, F.length("new").cast("bigint")).otherwise(F.col("n_chars"))})
    return unpacked(done, docs, text=F.col("text"), n_chars=F.col("n_chars"))
