"""Bars of longer timeframes from bars of one minute."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohlspark.functions.scalars import bucket_key
from ohlspark.operators.series import CELL, indexed
from ohlspark.schema import TIMEFRAMES, timeframe_minutes

_ohlcv = lambda order: [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume")]


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """For bars in order of time with one kind of time text: tumbling windows, one shuffle.
    Bars of five minutes may be the source of bars of fifteen."""
    slot = F.window("time", f"{timeframe_minutes(tf)} minutes")["start"]
    return bars.select("series", slot.alias("slot"), "time", "open", "high", "low", "close", "volume").groupBy("series", "slot").agg(*_ohlcv("time")).withColumnRenamed("slot", "time")


def numbered_runs(rows: DataFrame, key: str, order: list[str], cell: Column) -> DataFrame:
    """rows(series, key, ...) with run: runs of equal keys in the order of `order`, from 0 in each series. cell never falls along
    that order; a series is dealt out over its cells, and of each only its ends and number of runs meet the others."""
    rows = rows.withColumn("cell", cell)
    w = Window.partitionBy("series", "cell").orderBy(*order)
    at = F.struct(*order)
    inner = rows.withColumn("inner", F.coalesce((F.lag(key).over(w) != F.col(key)).cast("long"), F.lit(0).cast("long")))
    cells = inner.groupBy("series", "cell").agg(F.min_by(key, at).alias("first_key"), F.max_by(key, at).alias("last_key"), F.sum("inner").alias("n"))
    c = Window.partitionBy("series").orderBy("cell")
    starts = (~F.lag("last_key").over(c).eqNullSafe(F.col("first_key"))).cast("long")
    cells = cells.withColumn("starts", starts)
    before = F.coalesce(F.sum(F.col("n") + F.col("starts")).over(c.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = cells.select("series", "cell", (before + F.col("starts") - 1).alias("base"))
    inside = F.sum("inner").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return inner.withColumn("inside", inside).join(base, ["series", "cell"]).withColumn("run", (F.col("base") + F.col("inside")).cast("long")).drop("inner", "inside", "base", "cell")


def resample_runs(bars: DataFrame, tf: str, order: list[str] | None = None, cell: Column | None = None) -> DataFrame:
    """bars(series, seq, time text, ...) in order of arrival -> runs of equal bucket keys, numbered by run.

    A key that returns later gives a second bar; rows whose time can't be read are passed over without
    ending a run; seconds and zone stay part of the key. Order and cells are those of seq where none are given.
    """
    order, minutes = order or ["seq"], timeframe_minutes(tf)
    # explode keeps the regular expressions from being run again for every use of the key
    rows = bars.select("*", F.explode(F.array(bucket_key(F.col("time"), minutes))).alias("key")).where("key IS NOT NULL")
    runs = numbered_runs(rows, "key", order, F.floor(F.col("seq") / CELL) if cell is None else cell)
    return runs.groupBy("series", "run", "key").agg(*_ohlcv(F.struct(*order))).withColumnRenamed("key", "time")


def merge_deltas(rows: DataFrame, order: list[str] | None = None, cell: Column | None = None, compat: str = "reference") -> DataFrame:
    """rows(series, seq, time, ...) of live updates -> bars: consecutive rows of a time are one bar, that
    keeps the first open, takes the extremes, the last close and the last volume. A row of another time
    starts a new last bar, earlier or not. With compat `reference` a row without a low takes the bar's low away (prices not below
    zero); with `corrected` it is passed over. Rows without a time are no updates."""
    order = order or ["seq"]
    at = F.struct(*order)
    runs = numbered_runs(rows.where("time IS NOT NULL"), "time", order, F.floor(F.col("seq") / CELL) if cell is None else cell)
    low = F.min("low") if compat == "corrected" else F.when(F.count("low") == F.count("*"), F.min("low"))
    return runs.groupBy("series", "run", "time").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), low.alias("low"), F.max_by("close", at).alias("close"), F.max_by("volume", at).alias("volume")
    )


def build_timeframes(bars: DataFrame, warn: bool = False) -> DataFrame:
    """One-minute bars -> the bars of every timeframe, with tf and idx (from 0 in each series and timeframe).

    Bars whose time is a text and that have seq (from a CSV file) stay in their order of arrival, out of order, blank or not, and longer ones are
    runs of their keys; others go by windows of time. No bars give none; with `warn` the log tells of it, for one more look at the bars.
    """
    if warn and bars.isEmpty():
        logging.getLogger(__name__).warning("no bars of one minute to build timeframes from")
    texts = dict(bars.dtypes)["time"] == "string"
    out = None
    for tf in TIMEFRAMES:
        if texts and tf != "1m":
            one = resample_runs(bars, tf).withColumn("idx", F.col("run"))
        else:
            one = indexed(bars if tf == "1m" else resample(bars, tf))
        one = one.withColumn("tf", F.lit(tf)).select("series", "tf", "idx", "time", "open", "high", "low", "close", "volume")
        out = one if out is None else out.unionByName(one)
    return out


def active(bars: DataFrame, tf: str, base: DataFrame | None = None) -> DataFrame:
    """The bars of a timeframe in a table of build_timeframes. Where it has none of one minute, the base series (indexed bars) stands for them; another
    timeframe without bars, where the base has some, is told of in the log."""
    out = bars.where(F.col("tf") == tf)
    if tf == "1m":
        if base is None or not out.isEmpty():
            return out
        return base.withColumn("tf", F.lit(tf)).select(bars.columns)
    if out.isEmpty() and not (bars.where("tf = '1m'") if base is None else base).isEmpty():
        logging.getLogger(__name__).warning("timeframe %s has no bars; build_timeframes makes them", tf)
    return out


def followed_timeframes(requests: DataFrame, start: str = "1m") -> DataFrame:
    """requests(session, step, tf) -> with active, the timeframe after each, and refused: an unknown or missing one is refused, and the one before stays.
    Sessions begin with `start`. A session's requests are ordered in one task."""
    known = F.col("tf").isin(list(TIMEFRAMES))
    upto = Window.partitionBy("session").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(known, F.col("tf")), ignorenulls=True).over(upto)
    return requests.withColumn("active", F.coalesce(last, F.lit(start))).withColumn("refused", ~F.coalesce(known, F.lit(False)))
