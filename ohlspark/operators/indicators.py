"""Indicators: functions from indexed bars to a series of values, and their registry."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import partial
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohlspark.operators.series import indexed
from ohlspark.schema import ATR_PERIOD

Indicator = Callable[[DataFrame], DataFrame]
BLOCK = 256

#: What stands for the close before the first bar: 0, or none; "reset" takes high - close as its range, "corrected" high - low.
FIRST = ("fresh", "reset", "corrected")


class Registry:
    """name -> indicator; a name registered again is replaced, an unknown name is told of in the log and gives None.

    Series are functions of their bars. What reset_all changes is what an indicator starts from: a new one may start otherwise than one that was
    put back (`after_reset`); registered anew it is new again."""

    def __init__(self, **indicators: Indicator):
        self._reset, self._now = {}, {}
        for name, indicator in indicators.items():
            self.register(name, indicator)

    def __contains__(self, name: str) -> bool:
        return name in self._now

    def register(self, name: str, indicator: Indicator, after_reset: Indicator | None = None) -> None:
        self._now[name], self._reset[name] = indicator, after_reset or indicator

    def reset_all(self) -> None:
        self._now = dict(self._reset)

    def values(self, name: str, bars: DataFrame) -> DataFrame | None:
        if name not in self:
            logging.getLogger(__name__).warning("no indicator is registered as %r", name)
            return None
        return self._now[name](bars)


def true_range(first: str = "fresh") -> Column:
    """Of high, low and prev_close; `first` says how the bar without one counts."""
    if first not in FIRST:
        raise ValueError(f"first: one of {', '.join(FIRST)}")
    high, low, pc = F.col("high"), F.col("low"), F.col("prev_close")
    usual = lambda c: F.greatest(high - low, F.abs(high - c), F.abs(low - c))
    start = {"fresh": usual(F.lit(0.0)), "reset": high - F.col("close"), "corrected": high - low}[first]
    return F.when(pc.isNull(), start).otherwise(usual(pc))


def with_repeated_last(bars: DataFrame) -> DataFrame:
    """The last bar counts once more, as after a load: one more position."""
    last = bars.groupBy("series").agg(F.max_by(F.struct(*(c for c in bars.columns if c != "series")), "idx").alias("x")).select("series", "x.*")
    return bars.unionByName(last.withColumn("prev_close", F.col("close")).withColumn("idx", F.col("idx") + 1))


def wilder_atr(bars: DataFrame, period: int = ATR_PERIOD, first: str = "fresh") -> DataFrame:
    """Bars (indexed first where they have no prev_close) with a column atr: the mean of the first `period` true ranges, at all of their positions
    (null while there are fewer), and then (atr * (period - 1) + true range) / period.

    The recursion is a sum with weights that fall by q = (period - 1) / period a bar. Blocks of
    BLOCK bars are summed apart, and a bar adds to its own block what the last blocks before it leave: as many
    as it takes for q to fall below a double's precision. The mean goes to the blocks of the first bars alone, and what a
    block leaves to the blocks after it, so no task folds, joins or orders a whole series.
    """
    bars = bars if "prev_close" in bars.columns else indexed(bars)
    q, at = (period - 1) / period, F.col("idx")
    ranged = bars.withColumn("tr", true_range(first)).withColumn("block", F.floor(at / BLOCK))
    seeds = ranged.where(at < period).groupBy("series").agg(F.when(F.count("*") >= period, F.sum("tr") / period).alias("seed"))
    seeds = seeds.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((period - 1) // BLOCK).cast("long"))))
    rows = ranged.join(seeds, ["series", "block"], "left").withColumn("k", at % BLOCK)
    share = F.when(at >= period, F.col("tr") / period).when(at == period - 1, F.col("seed")).otherwise(0.0)
    rows = rows.withColumn("share", share)
    if period == 1:
        return rows.select(*bars.columns, "tr", F.when(at == 0, F.col("seed")).otherwise(F.col("tr")).alias("atr"))
    back = max(1, ceil(40 / (-log(q) * BLOCK)))
    sums = rows.groupBy("series", "block").agg(F.sum(F.col("share") * F.pow(F.lit(q), BLOCK - 1 - F.col("k"))).alias("left"))
    left = lambda m: F.when(m > 0, F.col("left") * F.pow(F.lit(q), BLOCK * (m - 1))).otherwise(0.0)
    later = F.transform(F.sequence(F.lit(0), F.lit(back)), lambda m: F.struct((F.col("block") + m).alias("block"), left(m).alias("carried")))
    before = sums.select("series", F.inline(later)).groupBy("series", "block").agg(F.sum("carried").alias("carried"))
    inside = Window.partitionBy("series", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    scaled = rows.withColumn("inside", F.sum(F.col("share") * F.pow(F.lit(1 / q), "k")).over(inside))
    value = F.pow(F.lit(q), "k") * (F.col("inside") + q * F.col("carried"))
    return scaled.join(before, ["series", "block"]).select(*bars.columns, "tr", F.when(at < period, F.col("seed")).otherwise(value).alias("atr"))


REGISTRY = Registry()
REGISTRY.register("ATR", wilder_atr, partial(wilder_atr, first="reset"))
