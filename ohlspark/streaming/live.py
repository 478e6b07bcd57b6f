"""Live bars with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ohlspark.operators.folds import Atr, in_stream
from ohlspark.schema import ATR_PERIOD, TIMEFRAMES


def live_bars(ticks: DataFrame, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Streaming ticks(series, ts: TIMESTAMP, tick_id, price) -> bars of closed windows, in append mode."""
    at = F.struct("ts", "tick_id")
    return ticks.withWatermark("ts", late).groupBy("series", F.window("ts", f"{minutes} minutes").alias("slot")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume")
    ).select("series", F.col("slot.start").alias("time"), "open", "high", "low", "close", "volume")


def live_timeframes(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming ticks(series, ts: TIMESTAMP, tick_id, price) -> the closed bars of every timeframe (series, tf, time, ...), in append mode.

    One stream of chained windows: bars of five minutes come from bars of one, those of fifteen from those of five. A window passes the
    watermark on with the time of its bar (window_time), so one that is closed closes those above it in the same batch.
    """
    at = F.struct("ts", "tick_id")
    bars = ticks.withWatermark("ts", late).groupBy("series", F.window("ts", "1 minute").alias("slot")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    out = None
    for tf, minutes in TIMEFRAMES.items():
        if minutes > 1:
            timed = bars.select("series", F.window_time("slot").alias("time"), "open", "high", "low", "close", "volume")
            bars = timed.groupBy("series", F.window("time", f"{minutes} minutes").alias("slot")).agg(
                F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")
            )
        one = bars.select("series", F.lit(tf).alias("tf"), F.col("slot.start").alias("time"), "open", "high", "low", "close", "volume")
        out = one if out is None else out.unionByName(one)
    return out


#: A bar that live rows are merged into: its number, its time in microseconds, how many rows it holds, and whether it is earlier than the bar before it.
_BAR = "run long, at long, open double, high double, low double, close double, volume double, merged long, late boolean"
_NUMBERS = ["open", "high", "low", "close", "volume"]


class LiveBars(StatefulProcessor):
    """Keeps each series' last bar as a value. A row of its time is merged into it; a row of another time, late or not, starts a new last bar."""

    def __init__(self, order: list[str], compat: str):
        self.order, self.least = order, np.fmin if compat == "corrected" else np.minimum  # minimum keeps a missing low missing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        at = batch["at"].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.concatenate([starts[1:], [len(at)]]) - 1
        values = {c: batch[c].to_numpy(float) for c in _NUMBERS}
        bars = {"open": values["open"][starts], "close": values["close"][ends], "volume": values["volume"][ends]}
        bars["high"], bars["low"] = np.fmax.reduceat(values["high"], starts), self.least.reduceat(values["low"], starts)
        at, merged, run = at[starts], ends - starts + 1, np.arange(len(starts))
        late = np.concatenate([[False], at[1:] < at[:-1]])
        last = self.last.get() if self.last.exists() else None
        if last is not None:
            number, time, open_, high, low, _, _, held, was_late = last
            if time == at[0]:
                nan = lambda v: np.nan if v is None else v
                bars["open"][0] = nan(open_)
                bars["high"][0], bars["low"][0] = np.fmax(nan(high), bars["high"][0]), self.least(nan(low), bars["low"][0])
                merged[0] += held
                late[0], run = was_late, run + number
            else:
                late[0], run = at[0] < time, run + number + 1
        out = pd.DataFrame({"run": run, "at": at, **{c: bars[c] for c in _NUMBERS}, "merged": merged, "late": late})
        end = out.iloc[-1]
        self.last.update((int(end["run"]), int(end["at"]), *(None if np.isnan(end[c]) else float(end[c]) for c in _NUMBERS), int(end["merged"]), bool(end["late"])))
        out.insert(0, "series", key[0])
        yield out

    def close(self) -> None:
        pass


def live_upserts(rows: DataFrame, order: list[str] | None = None, compat: str = "reference") -> DataFrame:
    """Streaming live rows(series, time: TIMESTAMP, open, high, low, close, volume and the columns of order, numbers) -> for each batch the bars that
    it touched: series, run, time, ..., merged (rows so far), late. latest_bars takes the last state of each bar.

    Bars are those of merge_deltas, however the rows are cut into batches, as long as later batches hold later rows in that order. The last
    bar of a series is kept as transformWithState's state in RocksDB, so the stream goes on from its checkpoint. Rows without a time are
    no updates. A batch's rows of a series are ordered in one task.
    """
    order = order or ["seq"]
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given = rows.where("time IS NOT NULL").select("series", F.unix_micros(F.col("time").cast("timestamp")).alias("at"), *_NUMBERS, *order)
    out = given.groupBy("series").transformWithStateInPandas(LiveBars(order, compat), f"series string, {_BAR}", "Append", "None")
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "time")


def latest_bars(touched: DataFrame) -> DataFrame:
    """What live_upserts wrote -> each bar as it stood last."""
    rest = [c for c in touched.columns if c not in ("series", "run")]
    return touched.groupBy("series", "run").agg(F.max_by(F.struct(*rest), "merged").alias("x")).select("series", "run", "x.*")


def live_atr(bars: DataFrame, period: int = ATR_PERIOD) -> DataFrame:
    """Streaming bars(series, time, high, low, close), in order of time within and across batches ->
    series, time, atr; null before the first `period` bars (a stream can't fill them in later)."""
    return in_stream(Atr(period), bars, "time")
