"""Folds in blocks, in a stream and as a table function."""

import math
import random

import pytest
from ohlspark.operators import folds
from ohlspark.operators.folds import Atr, Fold, HalfTrend, RangeFilter, SuperTrend, as_table_function, in_blocks, in_stream
from ohlspark.plans.catalogue import streamed


def series(n, slow=False, seed=1):
    rnd, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        price += (0.01 * math.sin(i)) if slow else rnd.uniform(-3, 3)
        out.append(("a" if i % 3 else "b", i // 3 if i % 3 == 0 else i - i // 3 - 1, price + rnd.random(), price - rnd.random(), price, 2.0 + rnd.random(), float(rnd.randint(1, 9))))
    return out


COLUMNS = "series string, idx long, high double, low double, close double, atr double, volume double"


def running():
    class Running(Fold):  # what a user makes: the mean price by volume since the start, whose sums can be merged
        columns, inputs = "mean double", ("close", "volume")

        def initial(self):
            return [0.0, 0.0]

        def update(self, state, close, volume):
            pv, v = state[0] + close * volume, state[1] + volume
            return (pv / v,), [pv, v]

        def merge(self, a, b):
            return [a[0] + b[0], a[1] + b[1]]

    return Running()


def plain(fold, rows):
    at = {c.split()[0]: k for k, c in enumerate(COLUMNS.split(", "))}
    states, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        values, states[r[0]] = fold.update(states.get(r[0], fold.initial()), *(r[at[c]] for c in fold.inputs))
        out[r[0], r[1]] = tuple(values)
    return out


def close_to(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert all(a is b or (a is not None and b is not None and abs(a - b) < 1e-9) for a, b in zip(got[k], v, strict=True)), (k, got[k], v)


def collected(df, order="idx"):
    rows = df.collect()
    out = {(r["series"], r[order]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("fold", [Atr(), SuperTrend(), RangeFilter(), HalfTrend(), running()], ids=lambda f: type(f).__name__)
@pytest.mark.parametrize(("block", "warm", "slow"), [(32, 4, False), (32, 0, True)])
def test_blocks_give_what_one_pass_gives(spark, fold, block, warm, slow):
    rows = series(160, slow)
    close_to(collected(in_blocks(fold, spark.createDataFrame(rows, COLUMNS).repartition(3), block, warm)), plain(fold, rows))


def test_only_blocks_with_a_wrong_start_are_folded_again(spark, monkeypatch):
    rows, written = series(300), []
    settle = folds.settled
    monkeypatch.setattr(folds, "settled", lambda df: (written.append(df.columns), settle(df))[1])
    bars = spark.createDataFrame(rows, COLUMNS)
    in_blocks(SuperTrend(), bars, 64, 64).count()
    assert len(written) == 1  # one fold, and no start was wrong
    close_to(collected(in_blocks(SuperTrend(), bars, 64, 1)), plain(SuperTrend(), rows))


def test_empty_series(spark):
    assert in_blocks(SuperTrend(), spark.createDataFrame([], COLUMNS)).count() == 0
    assert in_blocks(running(), spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("fold", [Atr(), SuperTrend(), running()], ids=lambda f: type(f).__name__)
def test_the_same_object_in_blocks_in_a_stream_and_in_sql(spark, fold):
    rows = series(150)
    bars = spark.createDataFrame(rows, COLUMNS)
    want = plain(fold, rows)
    close_to(collected(in_blocks(fold, bars, 32, 8)), want)
    close_to(collected(streamed(bars, lambda s: in_stream(fold, s), "idx", 2)), want)
    as_table_function(spark, "folded", fold)
    bars.createOrReplaceTempView("fold_bars")
    close_to(collected(spark.sql("SELECT * FROM folded(TABLE(SELECT * FROM fold_bars) PARTITION BY series ORDER BY idx)")), want)
