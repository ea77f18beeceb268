"""Geometry in well-known binary form (ISO and extended, either byte order) as Column expressions, without Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isomesh.functions.geom import parse_wkt

#: Numbers of kinds, and the flags of a third and fourth coordinate and of a projection's number.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000

#: Where the walk over the bytes is: the next byte (from 1), geometries and runs of points to come, the kinds outside and
#: here, byte order and coordinates a point, then the runs found (first byte, points), which runs begin a part, and
#: whether the bytes make no sense.
STATE = "struct<at:bigint,geoms:bigint,runs:bigint,whole:bigint,kind:bigint,little:boolean,dims:bigint,found:array<struct<at:bigint,n:bigint,little:boolean,dims:bigint>>,starts:array<int>,bad:boolean>"
FIELDS = ("at", "geoms", "runs", "whole", "kind", "little", "dims", "found", "starts", "bad")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def digits(data: Column, at: Column, n: int, little: Column) -> Column:
    """``n`` bytes as hexadecimal digits, the highest first."""
    return let(F.hex(data.substr(at, F.lit(n))), lambda h: F.when(little, F.regexp_replace(F.reverse(h), "(.)(.)", "$2$1")).otherwise(h))


def number(hex: Column) -> Column:
    return F.conv(hex, 16, 10).cast("bigint")


def uint32(data: Column, at: Column, little: Column) -> Column:
    return number(digits(data, at, 4, little))


def float64(data: Column, at: Column, little: Column) -> Column:
    """A double from its eight bytes, exactly; null for infinities and what is no number."""

    def value(v: Column) -> Column:
        exponent = F.shiftright(v["hi"], 20).bitwiseAND(F.lit(2047))
        mantissa = v["hi"].bitwiseAND(F.lit(0xFFFFF)) * F.lit(2**32) + v["lo"]
        sign = F.when(v["hi"] >= 2**31, -1.0).otherwise(1.0)
        small = mantissa.cast("double") * F.pow(F.lit(2.0), F.lit(-1074.0))
        normal = (mantissa + F.lit(2**52)).cast("double") * F.pow(F.lit(2.0), (exponent - 1075).cast("double"))
        return F.when(exponent < 2047, sign * F.when(exponent == 0, small).otherwise(normal))

    halves = lambda h: let(F.struct(number(h.substr(1, 8)).alias("hi"), number(h.substr(9, 8)).alias("lo")), value)
    return let(digits(data, at, 8, little), halves)


def state(acc: Column | None = None, **changed: Column) -> Column:
    """The state with some fields changed."""
    return F.struct(*(changed.get(f, acc[f] if acc is not None else None).alias(f) for f in FIELDS)).cast(STATE)


def header(data: Column, at: Column) -> Column:
    """struct<little, kind, dims, next> of the geometry that begins at a byte; kind is null where none can."""
    order = data.substr(at, F.lit(1))
    little = F.when(order == F.lit(b"\x01"), True).when(order == F.lit(b"\x00"), False)
    flag = lambda h, bit: h["code"].bitwiseAND(F.lit(bit)) != 0

    def read(h: Column) -> Column:
        base = h["code"].bitwiseAND(F.lit(0x0FFFFFFF))
        more = F.floor(base / 1000)
        dims = 2 + (flag(h, HAS_Z) | more.isin(1, 3)).cast("bigint") + (flag(h, HAS_M) | more.isin(2, 3)).cast("bigint")
        return F.struct(h["little"].alias("little"), F.when(more <= 3, base % 1000).alias("kind"), dims.alias("dims"), (at + 5 + F.when(flag(h, HAS_SRID), 4).otherwise(0)).alias("next"))

    return let(F.struct(little.alias("little"), uint32(data, at + 1, little).alias("code")), read)


def parse_wkb(data: Column) -> Column:
    """The same as ``geom.parse_wkt`` makes of text: struct<kind, parts, rings>. Parts and rings are null where the bytes
    end too early, go on after the geometry, or hold a kind that is not in KINDS, a run without points or a coordinate that is no number; of
    more than two coordinates, the first two stay. One walk finds where runs of points lie, then points are read."""
    size = F.octet_length(data).cast("bigint")
    failed = lambda acc: state(acc, bad=F.lit(True))

    def opened(acc: Column) -> Column:
        """The next geometry, or the whole one, which may have others in it."""

        def of(h: Column) -> Column:
            simple = acc["whole"] == 0
            many = simple & (h["kind"] >= 4)
            expected = simple | (h["kind"] == acc["whole"] - 3)
            counted = F.when(h["kind"] == 3, uint32(data, h["next"], h["little"])).when(many, uint32(data, h["next"], h["little"]))
            after = h["next"] + F.when(counted.isNotNull(), 4).otherwise(0)
            inner = state(acc, at=after, geoms=acc["geoms"] - 1, runs=F.coalesce(counted, F.lit(1)), whole=F.when(simple, h["kind"]).otherwise(acc["whole"]), kind=h["kind"], little=h["little"], dims=h["dims"], starts=F.array_append(acc["starts"], F.size(acc["found"])))
            outer = state(acc, at=after, geoms=counted, whole=h["kind"])
            missing = h["kind"].isin(3, 4, 5, 6) & (many | (h["kind"] == 3)) & counted.isNull()
            return F.when(h["kind"].isNull() | ~h["kind"].between(1, 6) | ~expected | missing, failed(acc)).when(many, outer).otherwise(inner)

        return let(header(data, acc["at"]), of)

    def passed(acc: Column) -> Column:
        """Over the next run of points."""
        point = acc["kind"] == 1

        def of(n: Column) -> Column:
            first = acc["at"] + F.when(point, 0).otherwise(4)
            after = first + n * 8 * acc["dims"]
            run = F.struct(first.alias("at"), n.alias("n"), acc["little"].alias("little"), acc["dims"].alias("dims"))
            return F.when(n.isNull() | (after > size + 1), failed(acc)).otherwise(state(acc, at=after, runs=acc["runs"] - 1, found=F.array_append(acc["found"], run)))

        return let(F.when(point, F.lit(1).cast("bigint")).otherwise(uint32(data, acc["at"], acc["little"])), of)

    def step(acc: Column, _: Column) -> Column:
        return F.when(acc["bad"], acc).when(acc["runs"] > 0, passed(acc)).when(acc["geoms"] > 0, opened(acc)).otherwise(acc)

    none = F.array().cast("array<struct<at:bigint,n:bigint,little:boolean,dims:bigint>>")
    start = state(at=F.lit(1), geoms=F.lit(1), runs=F.lit(0), whole=F.lit(0), kind=F.lit(0), little=F.lit(False), dims=F.lit(2), found=none, starts=F.array().cast("array<int>"), bad=F.lit(False))
    # Every step but the last passes four bytes or more.
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(size / 4), F.lit(1)).cast("int")), start, step)

    def points(run: Column) -> Column:
        at = lambda i, k: run["at"] + 8 * (i * run["dims"] + k)
        return F.transform(F.array_repeat(F.lit(0), run["n"].cast("int")), lambda _, i: F.struct(float64(data, at(i, 0), run["little"]).alias("x"), float64(data, at(i, 1), run["little"]).alias("y")))

    def shaped(w: Column) -> Column:
        whole = ~w["bad"] & (w["geoms"] == 0) & (w["runs"] == 0) & (w["at"] == size + 1)
        kind = F.element_at(F.create_map(*(F.lit(x) for k in KINDS.items() for x in k)), w["whole"].cast("int"))
        rings = F.when(whole, F.transform(w["found"], points))

        def divided(r: Column) -> Column:
            parts = F.transform(w["starts"], lambda s, i: F.slice(r, s + 1, F.coalesce(F.get(w["starts"], i + 1), F.size(r)) - s))
            good = r.isNotNull() & (F.size(r) > 0) & F.forall(r, lambda run: F.size(run) > 0) & ~F.exists(F.flatten(r), lambda p: p["x"].isNull() | p["y"].isNull())
            return F.struct(kind.alias("kind"), F.when(good, parts).alias("parts"), F.when(good, r).alias("rings"))

        return let(rings, divided)

    return F.when(data.isNotNull(), let(walked, shaped))


def parse_geometry(value: Column, kind: T.DataType) -> Column:
    """Of binary form, or of text: binary form in hexadecimal digits (as databases print it) or well-known text."""
    if isinstance(kind, T.BinaryType):
        return parse_wkb(value)
    text = value.cast("string")
    hexadecimal = F.regexp_replace(F.trim(text), r"^\\x", "")
    return F.when(hexadecimal.rlike(r"^[0-9A-Fa-f]{10,}$"), parse_wkb(F.unhex(hexadecimal))).otherwise(parse_wkt(text))
