"""Positions in a series, and what is looked up by them.

Positions are dealt out by cells of a day, or of arrivals: rows are numbered within their cell and a cell starts
after the rows of the cells before it, so no task sorts a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a cell of seq.
CELL = 100_000


def arrival(bars: DataFrame) -> tuple[list[str], Column]:
    """What bars are ordered by and the cells they are dealt out by: seq, the order of arrival, where they have it, else time, by days."""
    return (["seq"], F.floor(F.col("seq") / CELL)) if "seq" in bars.columns else (["time"], F.to_date("time"))


def indexed(bars: DataFrame) -> DataFrame:
    """Sets idx, from 0 in each series in the order of `arrival`, and prev_close (null at 0); values of those names are replaced."""
    bars = bars.drop("idx", "prev_close")
    order, cell = arrival(bars)
    placed = bars.withColumn("cell", cell)
    at = F.struct(*order) if len(order) > 1 else F.col(*order)  # of a plain number the aggregate sorts nothing
    cells = placed.groupBy("series", "cell").agg(F.count("*").alias("n"), F.max_by("close", at).alias("last_close"))
    w = Window.partitionBy("series").orderBy("cell")
    before = cells.select("series", "cell", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.lag("last_close").over(w).alias("carried"))
    inside = Window.partitionBy("series", "cell").orderBy(*order)
    placed = placed.withColumn("nth", F.row_number().over(inside) - 1).withColumn("lagged", F.lag("close").over(inside))
    return placed.join(before, ["series", "cell"]).select(
        *bars.columns, (F.col("first") + F.col("nth")).cast("long").alias("idx"),
        F.when(F.col("nth") == 0, F.col("carried")).otherwise(F.col("lagged")).alias("prev_close"),
    )


def size(bars: DataFrame) -> DataFrame:
    """One row a series: n, last_idx (n - 1) and the last bar by position."""
    return bars.groupBy("series").agg(F.count("*").alias("n"), (F.count("*") - 1).alias("last_idx"), F.max_by(F.struct("time", "open", "high", "low", "close", "volume"), "idx").alias("last"))


def bar_at(bars: DataFrame, i: float) -> DataFrame:
    """The bar at a position, a fraction cut off; none outside the series."""
    return bars.where(F.col("idx") == int(i)) if i >= 0 else bars.limit(0)


def bar_slice(bars: DataFrame, start: float | None, end: float | None) -> DataFrame:
    """Both ends belong to it; start below 0 or null is 0, end past the last or null is the last."""
    start = 0 if start is None or start < 0 else int(start)
    out = bars.where(F.col("idx") >= start)
    return out if end is None else out.where(F.col("idx") <= int(end))


def half_open_slice(values: DataFrame, start: float, end: float) -> DataFrame:
    """The end does not belong to it."""
    return values.where((F.col("idx") >= max(0, int(start))) & (F.col("idx") < int(end)))


def timestamps(window: DataFrame) -> DataFrame:
    return window.select("idx", "time").where(F.col("time").isNotNull())


def time_anchors(bars: DataFrame) -> DataFrame:
    """bars(idx, time text) -> index, label HH:MM, minute; only times with a T before the clock have one."""
    part = lambda k: F.regexp_extract("time", r"T(\d{2}):(\d{2})", k)
    found = bars.where(F.col("time").rlike(r"T\d{2}:\d{2}"))
    return found.select(F.col("idx").alias("index"), F.concat(part(1), F.lit(":"), part(2)).alias("label"), part(2).cast("int").alias("minute"))


def window_bounds(n: int, visible: float, offset: float) -> tuple[float, float]:
    """First and last position of a view on n bars; the last may lie past the end."""
    if not n:
        return 0, 0
    end = n - 1 - offset
    start = max(0, end - visible + 1)
    end = max(0, end)
    return min(start, end), end
