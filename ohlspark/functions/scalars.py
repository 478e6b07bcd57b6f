"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ohlspark.schema import EQ_TOLERANCE, GRID_PIXELS, MONTHS, TICK


def number(text: Column) -> Column:
    """The leading number of a text, 0 if there is none: how untyped fields count in arithmetic."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def round_half_away(v: Column) -> Column:
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5))


def tick_quantise(v: Column, tick: float = TICK) -> Column:
    """To a multiple of a tick by truncation of v / tick + 1/2; so negative values are not always sent to the nearest."""
    return (v / tick + 0.5).cast("long") * F.lit(tick)


def format_fixed(v: Column, digits: int) -> Column:
    """As C's %.nf rounds; no grouping."""
    return F.call_function("format_number", v, F.lit("0." + "0" * digits))


def grid_label(v: Column, step: Column) -> Column:
    return F.when(step >= 0.01, format_fixed(v, 2)).otherwise(format_fixed(v, 4))


def nice_step(low: Column, high: Column, height: float) -> Column:
    """A step of 1, 2, 5 or 10 times a power of ten, for about a line every GRID_PIXELS."""
    raw = (high - low) / max(2, height / GRID_PIXELS)
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    norm = raw / size
    return F.when(norm < 1.5, 1).when(norm < 3, 2).when(norm < 7, 5).otherwise(10) * size


def date_prefix(time: Column) -> Column:
    """yyyy-MM-dd at the start of a time text, else ''."""
    return F.regexp_extract(time, r"^(\d{4}-\d{2}-\d{2})", 1)


def clock_label(time: Column, day_change: Column) -> Column:
    """The day of the month on a change of day, else the first dd:dd of the text, else the text."""
    clock = F.regexp_extract(time, r"T?(\d{2}:\d{2})", 1)
    day = F.regexp_extract(time, r"^\d{4}-\d{2}-(\d{2})", 1)
    return F.when(day_change & (day != ""), day.try_cast("int").cast("string")).when(clock != "", clock).otherwise(time)


def crosshair_label(time: Column) -> Column:
    """DD Mon YYYY HH:MM; a time that can't be read stays as it is. Month 00 counts as the last."""
    part = lambda k: F.regexp_extract(time, r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}:\d{2})", k)
    month = part(2).try_cast("int")
    name = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.when(month == 0, 12).otherwise(month))
    return F.when(part(1) != "", F.concat_ws(" ", part(3), name, part(1), part(4))).otherwise(time)


def bucket_key(time: Column, minutes: int) -> Column:
    """The time text with its minutes floored to the timeframe and its suffix kept; null if it can't be read."""
    part = lambda k: F.regexp_extract(time, r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}):(\d{2})(.*)$", k)
    minute = part(2).try_cast("int")
    return F.when(part(1) != "", F.concat(part(1), F.lit(":"), F.lpad((minute - minute % minutes).cast("string"), 2, "0"), part(3)))


def direction(open_: Column, close: Column) -> Column:
    """A flat bar counts as up."""
    return F.when(close >= open_, "up").otherwise("down")


def eq_tolerance(atr: Column) -> Column:
    """How far apart two highs or lows may lie and still count as equal."""
    return atr * EQ_TOLERANCE
