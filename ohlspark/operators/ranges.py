"""Axis ranges of a window of bars; each is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohlspark.sources.bars import usable_price


def price_range(window: DataFrame, manual: tuple[float, float] | None = None) -> DataFrame:
    """Least low to greatest high of bars whose low is a plain number; (0, 100) without any; 1 on either
    side if flat; then 5 % on either side. A manual range stands as it is."""
    if manual:
        return window.agg(*map(F.lit, manual)).toDF("y_min", "y_max")
    ends = window.where(usable_price(F.col("low").cast("string"))).agg(F.min("low").alias("a"), F.max("high").alias("b"))
    flat = F.col("a") == F.col("b")
    ends = ends.select(F.when(flat, F.col("a") - 1).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 1).otherwise(F.col("b")).alias("b"))
    pad = (F.col("b") - F.col("a")) * 0.05
    return ends.select(F.coalesce(F.col("a") - pad, F.lit(0.0)).alias("y_min"), F.coalesce(F.col("b") + pad, F.lit(100.0)).alias("y_max"))


def atr_range(window: DataFrame, has_values: bool = True, manual: tuple[float, float] | None = None) -> DataFrame:
    """window(idx, atr). Starts from the value at the first position, (0, 1) if that is null; never below 0;
    1 more if flat; then 5 % on either side. (0, 10) where the series has no values at all. A manual range stands as it is."""
    if manual:
        return window.agg(*map(F.lit, manual)).toDF("y_min", "y_max")
    if not has_values:
        return window.agg(F.lit(0.0).alias("y_min"), F.lit(10.0).alias("y_max"))
    ends = window.agg(F.min("atr").alias("a"), F.max("atr").alias("b"), F.min_by("atr", "idx").alias("first"), F.count("*").alias("n"))
    none = F.col("first").isNull()
    a = F.greatest(F.when(none, F.least("a", F.lit(0.0))).otherwise(F.col("a")), F.lit(0.0))
    b = F.when(none, F.greatest("b", F.lit(1.0))).otherwise(F.col("b"))
    ends = ends.select(F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(1.0)).alias("b"))
    top = F.when(F.col("a") == F.col("b"), F.col("b") + 1).otherwise(F.col("b"))
    pad = (top - F.col("a")) * 0.05
    return ends.select(F.greatest(F.col("a") - pad, F.lit(0.0)).alias("y_min"), (top + pad).alias("y_max"))
