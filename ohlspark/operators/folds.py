"""Indicators that go on from bar to bar, as folds: one object runs in blocks of a table, in a stream and as a table function of SQL.

A fold keeps a state of a few numbers. In blocks, no task works through a whole series: each block starts from a guess of what the bars before it
left, made over the last bars of the block before; then guesses are held against what those blocks did leave, and only blocks whose start
was wrong are folded again, until none is. Where states can be merged there is nothing to guess.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ohlspark.schema import ATR_PERIOD
from ohlspark.sources.bars import settled

#: Bars of a block, and of the block before that a start is guessed from.
BLOCK, WARM = 4096, 512

State = list[float]


class Fold:
    """What an indicator defines: the columns that it gives for each bar, the columns of bars that it takes, and its steps.

    update(state, *bar) gives the bar's values and the state after it; initial() is the state before the first bar, an empty list where the first
    bar decides. Where `merge` is set, merge(a, b) is the state after bars that leave a from initial() followed by bars that leave b.
    """

    columns = "value double"
    inputs = ("high", "low", "close")
    merge: Callable[[State, State], State] | None = None

    def initial(self) -> State:
        return []

    def update(self, state: State, *bar: float) -> tuple[tuple, State]:
        raise NotImplementedError

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]

    def through(self, state: State, rows: pd.DataFrame) -> tuple[dict[str, list], State]:
        """The values of rows in their order, and the state after them."""
        out = []
        for bar in zip(*(rows[c].to_numpy(float).tolist() for c in self.inputs), strict=True):
            values, state = self.update(state, *bar)
            out.append(values)
        made = list(zip(*out, strict=True)) if out else [()] * len(self.names())
        return dict(zip(self.names(), map(list, made), strict=True)), [float(v) for v in state]


def in_blocks(fold: Fold, bars: DataFrame, block: int = BLOCK, warm: int = WARM) -> DataFrame:
    """bars(series, idx without gaps, the fold's inputs) -> series, idx and the fold's columns. warm is at most block."""
    at = F.col("idx")
    rows = bars.select("series", F.floor(at / block).alias("block"), "idx", *fold.inputs)
    return _merged(fold, rows) if fold.merge else _guessed(fold, rows, block, warm)


def _merged(fold: Fold, rows: DataFrame) -> DataFrame:
    """Every block's own state, all states before a block merged into its start, and then the values."""
    rows = settled(rows)

    def own(group: pd.DataFrame) -> pd.DataFrame:
        _, left = fold.through(fold.initial(), group.sort_values("idx"))
        return pd.DataFrame({"series": [group["series"].iat[0]], "block": [group["block"].iat[0]], "state": [left]})

    def before(states: pd.DataFrame) -> pd.DataFrame:
        out, state = [], fold.initial()
        for one in (states := states.sort_values("block"))["state"]:
            out.append(state)
            state = fold.merge(state, list(one))
        return pd.DataFrame({"series": states["series"], "block": states["block"], "state": out})

    def values(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        made, _ = fold.through(list(group["state"].iat[0]), group)
        return pd.DataFrame({"series": group["series"], "idx": group["idx"], **made})

    kind = "series string, block long, state array<double>"
    starts = rows.groupBy("series", "block").applyInPandas(own, kind).groupBy("series").applyInPandas(before, kind)  # a row a block
    return rows.join(starts, ["series", "block"]).groupBy("series", "block").applyInPandas(values, f"series string, idx long, {fold.columns}")


def _guessed(fold: Fold, rows: DataFrame, block: int, warm: int) -> DataFrame:
    kind = f"series string, block long, idx long, {fold.columns}, start array<double>, left array<double>"

    def folded(group: pd.DataFrame, start: State) -> pd.DataFrame:
        made, left = fold.through(start, group)
        edge = lambda k, v: [v if i == k else None for i in range(len(group))]
        return pd.DataFrame({"series": group["series"], "block": group["block"], "idx": group["idx"], **made, "start": edge(0, start), "left": edge(len(group) - 1, left)})

    def guessed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        own = group["own"].to_numpy(bool)
        _, start = fold.through(fold.initial(), group[~own])
        return folded(group[own], start) if own.any() else pd.DataFrame(columns=[c.split()[0] for c in kind.split(", ")])

    def again(group: pd.DataFrame) -> pd.DataFrame:
        return folded(group.sort_values("idx"), list(group["state"].iat[0]))

    def ends(made: DataFrame, version: int) -> DataFrame:
        return made.groupBy("series", "block").agg(F.max("start").alias("start"), F.max("left").alias("left")).withColumn("version", F.lit(version))

    both = F.array_distinct(F.array(F.col("block"), F.floor((F.col("idx") + warm) / block)))
    given = rows.select("series", "idx", *fold.inputs, F.col("block").alias("of"), F.explode(both).alias("block")).withColumn("own", F.col("of") == F.col("block"))
    pieces = [settled(given.groupBy("series", "block").applyInPandas(guessed, kind))]
    heads, kept = ends(pieces[0], 0), None
    before = F.lag("left").over(Window.partitionBy("series").orderBy("block"))
    while True:
        wrong = heads.select("series", "block", "start", before.alias("state")).where(F.col("state").isNotNull() & ~F.col("start").eqNullSafe(F.col("state"))).select("series", "block", "state")
        wrong = wrong if len(pieces) == 1 else settled(wrong)
        if wrong.isEmpty():
            break
        kept = settled(rows) if kept is None else kept
        pieces.append(settled(kept.join(wrong, ["series", "block"]).groupBy("series", "block").applyInPandas(again, kind)))
        new = ends(pieces[-1], len(pieces) - 1)
        heads = settled(heads.join(new, ["series", "block"], "left_anti").unionByName(new))
    if len(pieces) == 1:
        return pieces[0].select("series", "idx", *fold.names())
    out = None
    for k, piece in enumerate(pieces):
        one = piece.join(heads.where(F.col("version") == k).select("series", "block"), ["series", "block"]).select("series", "idx", *fold.names())
        out = one if out is None else out.unionByName(one)
    return out


class _Running(StatefulProcessor):
    """A fold's state as a value of transformWithState."""

    def __init__(self, fold: Fold, order: str):
        self.fold, self.order = fold, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "numbers array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order)
        made, state = self.fold.through(list(self.state.get()[0]) if self.state.exists() else self.fold.initial(), batch)
        self.state.update((state,))
        yield pd.DataFrame({"series": key[0], self.order: batch[self.order].to_numpy(), **made})

    def close(self) -> None:
        pass


def in_stream(fold: Fold, bars: DataFrame, order: str = "idx") -> DataFrame:
    """Streaming bars(series, order, the fold's inputs), in order within and across batches -> series, order and the fold's columns, in append mode."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(bars.dtypes)[order]
    given = bars.select("series", order, *fold.inputs).groupBy("series")
    return given.transformWithStateInPandas(_Running(fold, order), f"series string, {order} {kind}, {fold.columns}", "Append", "None")


def as_table_function(spark: SparkSession, name: str, fold: Fold) -> None:
    """Registers name(TABLE(SELECT series, idx, ... FROM bars) PARTITION BY series ORDER BY idx) for SQL. A series is worked through in one task, as
    table functions are; in_blocks has no such limit."""

    class Function:
        def __init__(self):
            self.state = fold.initial()

        def eval(self, row):
            values, self.state = fold.update(self.state, *(np.nan if row[c] is None else float(row[c]) for c in fold.inputs))
            yield row["series"], row["idx"], *values

    spark.udtf.register(name, F.udtf(Function, returnType=f"series string, idx long, {fold.columns}"))


class Atr(Fold):
    """Wilder's ATR as it can be known at each bar: null before the first `period` bars. State: previous close, sum and number of the first ranges, last value."""

    columns = "atr double"

    def __init__(self, period: int = ATR_PERIOD):
        self.period = period

    def initial(self) -> State:
        return [0.0, 0.0, 0.0, np.nan]

    def update(self, state: State, high: float, low: float, close: float) -> tuple[tuple, State]:
        before, total, n, last = state
        tr = max(high - low, abs(high - before), abs(low - before))
        n += 1
        if n <= self.period:
            total += tr
            last = total / self.period if n == self.period else np.nan
        else:
            last = (last * (self.period - 1) + tr) / self.period
        return (None if np.isnan(last) else last,), [close, total, n, last]


class SuperTrend(Fold):
    columns, inputs = "trend long, line double", ("high", "low", "close", "atr")

    def __init__(self, factor: float = 3.0):
        self.factor = factor

    def update(self, state: State, high: float, low: float, close: float, atr: float) -> tuple[tuple, State]:
        up, down, side, last = state or (np.inf, -np.inf, 1, np.nan)
        u, d = (high + low) / 2 + self.factor * atr, (high + low) / 2 - self.factor * atr
        up = u if u < up or last > up else up
        down = d if d > down or last < down else down
        side = 1 if side < 0 and close > up else -1 if side > 0 and close < down else side
        return (int(side), down if side > 0 else up), [up, down, side, close]


class RangeFilter(Fold):
    columns, inputs = "line double", ("close", "atr")

    def __init__(self, factor: float = 1.5):
        self.factor = factor

    def update(self, state: State, close: float, atr: float) -> tuple[tuple, State]:
        value, r = state[0] if state else close, self.factor * atr
        value = max(value, close - r) if close > value else min(value, close + r)
        return (value,), [value]


class HalfTrend(Fold):
    """Over two bars: the trend turns down when the mean of the highs falls below the greatest low of the trend and the bar closes
    below the low before it; up likewise. The line rises with the lows of an up-trend, falls with the highs of a
    down-trend, and goes on from where it is at a turn; the channel is deviation / 2 ATR on either side."""

    columns, inputs = "trend long, line double, upper double, lower double", ("high", "low", "close", "atr")

    def __init__(self, deviation: float = 2.0):
        self.deviation = deviation

    def update(self, state: State, high: float, low: float, close: float, atr: float) -> tuple[tuple, State]:
        side, top, bottom, value, h0, l0 = state or (1, low, high, low, high, low)
        hi, lo, before = max(high, h0), min(low, l0), side
        if side > 0:
            top = max(top, lo)
            if (high + h0) / 2 < top and close < l0:
                side, bottom = -1, hi
        else:
            bottom = min(bottom, hi)
            if (low + l0) / 2 > bottom and close > h0:
                side, top = 1, lo
        if side == before:
            value = max(value, top) if side > 0 else min(value, bottom)
        half = self.deviation / 2 * atr
        return (int(side), value, value + half, value - half), [side, top, bottom, value, high, low]
