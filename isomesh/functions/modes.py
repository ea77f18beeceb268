"""Modes of transport as bits, their rates, and travel times on edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Mode(NamedTuple):
    """Speed in m/s; kcal an hour; g CO2 and ct a kilometre."""

    bit: int
    name: str
    vmax: float
    kcal: float
    co2: float
    price: float


# The modes' bits, speeds and rates.
FOOT = Mode(2, "foot", 3.6 / 3.6, 280.0, 0.0, 0.0)
BIKE = Mode(4, "bike", 13 / 3.6, 510.0, 0.0, 0.0)
CAR = Mode(8, "car", 200 / 3.6, 170.0, 150.0, 31.0)
BUS = Mode(16, "bus", 80 / 3.6, 85.0, 75.0, 0.0)
MODES = {m.name: m for m in (FOOT, BIKE, CAR, BUS)}
#: Old names of modes.
SYNONYMS = {"bicycle": "bike", "passenger": "car"}
#: Paid once, at the first ride in public transport.
FARE = 95.0


def custom(vmax: float, kcal: float = -1.0, co2: float = -1.0, price: float = -1.0) -> Mode:
    """A mode of one's own; vmax in m/s, and rates that are not given count as -1."""
    return Mode(1, "custom", vmax, kcal, co2, price)


def mode_bits(names: str) -> int:
    """The bits of a list of names, divided by commas or semicolons."""
    bits = 0
    for raw in filter(None, names.replace(";", ",").split(",")):
        name = SYNONYMS.get(raw.strip().lower(), raw.strip().lower())
        if name != "custom" and name not in MODES:
            raise ValueError(f"unknown mode {raw!r}")
        bits |= 1 if name == "custom" else MODES[name].bit
    return bits


def allows(modes: Column, bits: int) -> Column:
    return modes.bitwiseAND(F.lit(bits)) != 0


def allows_all(modes: Column, bits: int) -> Column:
    return modes.bitwiseAND(F.lit(bits)) == bits


def model_speed(vmax: Column) -> Column:
    """Driving speed (km/h) to expect where ``vmax`` (km/h) is allowed."""
    return F.when(vmax < 30, vmax / 1.5).when(vmax <= 60, vmax / 2).when(vmax <= 80, vmax / 1.5).when(vmax <= 120, vmax / 1.2).otherwise(140.0)


def travel_time(length: Column, vmax: Column, mode: Mode, measured: Column | None = None) -> Column:
    """Seconds for an edge: by a measured speed if there is one (5 km/h where it is not positive), else by the
    slower of edge and mode. Grades have no effect on it."""
    plain = length / F.least(vmax, F.lit(mode.vmax))
    if measured is None:
        return plain
    seen = F.when(measured <= 0, 5 / 3.6).otherwise(measured)
    return F.when(measured.isNotNull(), length / F.least(F.lit(mode.vmax), seen, vmax)).otherwise(plain)


def seconds(hms: Column) -> Column:
    """Seconds of an H:M:S text; hours may exceed 23."""
    p = F.split(F.trim(hms), ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def day(text: Column) -> Column:
    """A date text as the number yyyyMMdd."""
    return F.replace(text, F.lit("-"), F.lit("")).cast("int")


def kilocalories(tt: Column, mode: Mode) -> Column:
    return mode.kcal * tt / 3600


def emissions(metres: Column, mode: Mode) -> Column:
    return mode.co2 / 1000 * metres


def price(metres: Column, mode: Mode) -> Column:
    return mode.price / 1000 * metres
