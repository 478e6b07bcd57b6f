"""Vectors worked out by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlspark.functions import scalars as S
from ohlspark.functions.scale import Scale, atr_scale, price_scale
from ohlspark.operators import extensions as X
from ohlspark.operators import view as V
from ohlspark.operators.folds import HalfTrend, RangeFilter, SuperTrend
from ohlspark.operators.indicators import Registry, wilder_atr, with_repeated_last
from ohlspark.operators.marks import axis_labels, day_changes, grid, label_step
from ohlspark.operators.ranges import atr_range, price_range
from ohlspark.operators.resample import merge_deltas, resample_runs
from ohlspark.operators.series import bar_at, bar_slice, half_open_slice, indexed, window_bounds
from ohlspark.schema import timeframe_minutes
from ohlspark.sources.bars import complete, read_csv, typed_bars, usable_price, write_bars


def frame(spark, highs, lows, closes):
    rows = [("all", f"2024-01-{1 + i // 2:02d} 00:{i:02d}:00", float(h), float(lo), float(c)) for i, (h, lo, c) in enumerate(zip(highs, lows, closes, strict=True))]
    df = spark.createDataFrame(rows, "series string, t string, high double, low double, close double")
    return indexed(df.select("series", F.col("t").cast("timestamp_ntz").alias("time"), F.col("close").alias("open"), "high", "low", "close", F.lit(1.0).alias("volume")))


def values(df, column="atr"):
    return [r[column] and round(r[column], 6) for r in df.orderBy("idx").collect()]


@pytest.fixture(scope="module")
def five(spark):
    return frame(spark, [10.0, 11, 12, 13, 12], [8.0, 9, 9, 10, 8], [9.0, 10, 11, 12, 9])


def test_atr(five):
    assert values(wilder_atr(five, 3), "tr") == [10, 2, 3, 3, 4]
    assert values(wilder_atr(five, 3)) == [5, 5, 5, 4.333333, 4.222222]
    assert values(wilder_atr(with_repeated_last(five), 3)) == [5, 5, 5, 4.333333, 4.222222, 4.148148]
    assert values(wilder_atr(five, 3, "reset")) == [2, 2, 2, 2.333333, 2.888889]
    assert values(wilder_atr(five.where("idx < 2"), 3)) == [None, None]
    assert values(wilder_atr(with_repeated_last(five.where("idx < 2")), 3)) == [4.666667] * 3
    assert values(wilder_atr(five, 3, "corrected"), "tr")[0] == 2


@pytest.mark.parametrize("period", [1, 2, 14, 100])
def test_atr_in_blocks_equals_a_fold(spark, period):
    df = spark.range(2000).select(F.lit("s").alias("series"), (F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000)).cast("timestamp_ntz").alias("time"), (F.pmod(F.xxhash64("id"), F.lit(97)) + 100.0).alias("close"))
    df = indexed(df.select("series", "time", F.col("close").alias("open"), (F.col("close") + 3).alias("high"), (F.col("close") - 2).alias("low"), "close", F.lit(1.0).alias("volume")))
    rows = wilder_atr(df, period).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(2000))
    a = sum(r.tr for r in rows[:period]) / period
    for r in rows:
        a = a if r.idx < period else (a * (period - 1) + r.tr) / period
        assert abs(r.atr - a) < 1e-9


@pytest.mark.parametrize("period", [14, 300])
def test_no_task_of_atr_reads_a_whole_series(spark, period):
    n, sc = 20_000, spark.sparkContext
    df = spark.range(0, n, 1, 4).select(F.when(F.col("id") >= 0, "s").alias("series"), "id", (F.pmod(F.xxhash64("id"), F.lit(97)) + 100.0).alias("close"))
    bars = indexed(df.select("series", F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("time"), (F.col("close") + 3).alias("high"), (F.col("close") - 2).alias("low"), "close"))
    # the series is no literal, which would leave joins without a key; no join is turned into a broadcast, no partitions are put together
    dealt = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in dealt.items():
            spark.conf.set(k, v)
        sc.setJobGroup(f"atr{period}", "")
        rows = wilder_atr(bars, period).orderBy("idx").collect()
    finally:
        for k in dealt:
            spark.conf.unset(k)
        sc.setJobGroup("", "")
    a = sum(r.tr for r in rows[:period]) / period
    for r in rows:
        a = a if r.idx < period else (a * (period - 1) + r.tr) / period
        assert abs(r.atr - a) < 1e-9
    jsc, tracker = sc._jsc.sc(), sc.statusTracker()
    jsc.listenerBus().waitUntilEmpty(30_000)
    stages = {k for job in tracker.getJobIdsForGroup(f"atr{period}") for k in tracker.getJobInfo(job).stageIds}
    tasks = [found.apply(i) for k in stages for found in [jsc.statusStore().taskList(k, 0, 1000)] for i in range(found.size())]
    read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks]
    assert len(rows) == n and sum(read) > n and max(read) < n * 3 // 4


def test_order_of_a_plain_number_needs_no_sort_for_cells(spark):
    bars = spark.range(10).select(F.lit("s").alias("series"), F.col("id").alias("seq"), F.col("id").cast("double").alias("close"))
    assert "SortAggregate" not in indexed(bars)._jdf.queryExecution().executedPlan().toString()
    assert [r.prev_close for r in indexed(bars).orderBy("idx").collect()] == [None, *map(float, range(9))]


def test_runs(spark):
    times = ["2024-01-01 08:37:00", "2024-01-01 08:38:00", "2024-01-01 08:41:00", "2024-01-01 08:39:00", "bad", "2024-01-01T08:39:30"]
    rows = [("all", 50_000 * (i + 1), t, *[float(v)] * 4, 1.0) for i, (t, v) in enumerate(zip(times, [1, 2, 3, 4, 9, 5], strict=True))]
    df = spark.createDataFrame(rows, "series string, seq long, time string, open double, high double, low double, close double, volume double")
    got = [(r.run, r.time, r.open, r.close) for r in resample_runs(df, "5m").orderBy("run").collect()]
    assert got == [(0, "2024-01-01 08:35:00", 1, 2), (1, "2024-01-01 08:40:00", 3, 3), (2, "2024-01-01 08:35:00", 4, 4), (3, "2024-01-01T08:35:30", 5, 5)]
    with pytest.raises(ValueError):
        timeframe_minutes("2m")


def test_live_rows(spark):
    rows = [("s", 0, "T1", 10.0, 12.0, 9.0, 11.0, 5.0), ("s", 1, "T1", 99.0, 13.0, 8.0, 12.0, 7.0), ("s", 2, "T0", 1.0, 1.0, 1.0, 1.0, 1.0), ("s", 3, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    kinds = "series string, seq long, time string, open double, high double, low double, close double, volume double"
    got = merge_deltas(spark.createDataFrame(rows, kinds)).orderBy("run").collect()
    assert [tuple(r)[2:] for r in got] == [("T1", 10, 13, 8, 12, 7), ("T0", 1, 1, 1, 1, 1)]


def test_a_live_row_without_low(spark):
    df = spark.createDataFrame([("s", 0, "T1", 10.0, 12.0, 9.0, 11.0, 5.0), ("s", 150_000, "T1", 9.0, None, None, 12.0, None), ("s", 150_001, "T1", 9.0, 1.0, 7.0, 12.0, 6.0)], "series string, seq long, time string, open double, high double, low double, close double, volume double")
    assert [tuple(merge_deltas(df, compat=c).first())[1:] for c in ("reference", "corrected")] == [(0, "T1", 10, 12, None, 12, 6), (0, "T1", 10, 12, 7, 12, 6)]


def test_manual_ranges(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "idx long, low double, high double, atr double")
    assert tuple(price_range(df, manual=(4.0, 5.0)).first()) == (4, 5) == tuple(atr_range(df, manual=(4.0, 5.0)).first())


def test_windows_and_slices(five):
    cases = [(0, 100, 0, 0, 0), (50, 100, 0, 0, 49), (1000, 100, 0, 900, 999), (1000, 100, -5, 905, 1004), (1000, 100, 998, 0, 1), (1000, 100, 1500, 0, 0)]
    for n, visible, offset, start, end in cases:
        assert window_bounds(n, visible, offset) == (start, end)
    assert abs(window_bounds(1000, 133.1, 0)[0] - 866.9) < 1e-9
    assert values(bar_slice(five, -3, 2), "idx") == [0, 1, 2] and values(bar_slice(five, None, None), "idx") == [0, 1, 2, 3, 4]
    assert values(half_open_slice(five, -3, 2), "idx") == [0, 1] and values(bar_slice(five, 4, 2), "idx") == []
    assert values(bar_at(five, 1.9), "idx") == [1] and bar_at(five, -1).count() == 0 and bar_at(five, 5).count() == 0


def test_ranges(spark):
    price = lambda rows: tuple(round(x, 9) for x in price_range(spark.createDataFrame(rows, "low double, high double")).first())
    assert price([(10.0, 15.0), (12.0, 20.0)]) == (9.5, 20.5)
    assert price([(10.0, 10.0)]) == (8.9, 11.1)
    assert price([(-1.0, 2.0)]) == (0, 100) == price([])
    atr = lambda rows, **k: tuple(round(x, 9) for x in atr_range(spark.createDataFrame(rows, "idx long, atr double"), **k).first())
    assert atr([], has_values=False) == (0, 10)
    assert atr([(0, None), (1, 0.4)]) == (0, 1.05)
    assert atr([(0, 2.0), (1, 4.0)]) == (1.9, 4.1)
    assert atr([(0, 2.0)]) == (1.95, 3.05)


def test_scale(spark):
    s = Scale(800, 400, 100, 900, 10, 20, 0, 0, 15, 15)
    assert s.x_left(905) == 40 and s.x_centre(905) == 44 and s.index(44) == 906 and s.y(15) == 200
    assert s.index_float(s.x_left(17.5)) == 17.5 and abs(s.value(s.y(13.2)) - 13.2) < 1e-9
    assert Scale(y_max=0).y_max == 1 and Scale(width=0).width == 800 and Scale(right=0).right == 0
    assert Scale(y_min=1, y_max=1).y(3) == 0
    assert price_scale(999, 0, 0, 1).offset == 900 and atr_scale(99, 100, 0, 1).offset == 0
    for height, low, high, step, n, first, last in [(400, 0.0, 100.0, 10, 11, 0, 100), (400, 9.5, 20.5, 1, 11, 10, 20), (160, 0.0, 0.5, 0.2, 3, 0, 0.4), (80, -2.5, 2.5, 2, 3, -2, 2)]:
        got = [r.value for r in grid(spark.createDataFrame([(low, high)], "y_min double, y_max double"), height).orderBy("n").collect()]
        assert (len(got), got[0], got[-1]) == (n, first, last) and abs(got[1] - got[0] - step) < 1e-9
    assert grid(spark.createDataFrame([(1.0, 1.0)], "y_min double, y_max double"), 400).count() == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(S.tick_quantise(F.lit(v))) for v in (101.37, 101.38, 0.1, -0.3, -0.9)] == [101.25, 101.5, 0, 0, -0.75]
    assert [one(S.number(F.lit(v))) for v in ("12abc", "", "-.5e1x", None, "x1")] == [12, 0, -5, 0, 0]
    assert [one(S.round_half_away(F.lit(v))) for v in (2.5, -2.5, 0.4)] == [3, -3, 0]
    assert [one(S.format_fixed(F.lit(v), 2)) for v in (2.675, 0.125, 12345.5)] == ["2.67", "0.12", "12345.50"]
    assert one(S.crosshair_label(F.lit("2024-03-05T07:08:09"))) == "05 Mar 2024 07:08" and one(S.crosshair_label(F.lit("soon"))) == "soon"
    assert one(S.crosshair_label(F.lit("2024-00-05 07:08"))) == "05 Dec 2024 07:08"
    assert one(S.clock_label(F.lit("2024-03-05 07:08:09"), F.lit(True))) == "5" and one(S.clock_label(F.lit("2024-03-05 07:08:09"), F.lit(False))) == "07:08"
    assert one(usable_price(F.lit("1.5"))) and not one(usable_price(F.lit("-1"))) and not one(usable_price(F.lit(None).cast("string")))
    assert [label_step(v) for v in (30, 31, 101, 501)] == [1, 5, 10, 50]


def test_day_labels(spark):
    times = ["2024-01-01 23:58", "2024-01-01 23:59", "bad", "2024-01-02 00:00", "2024-01-02 00:01"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(times)], "series string, idx long, t string")
    assert [r.is_day_change for r in day_changes(df, F.col("t")).orderBy("idx").collect()] == [False, False, True, True, False]
    assert [r.rel_index for r in axis_labels(df, 0, 30, "t").orderBy("rel_index").collect()] == [0, 2, 3]


def test_view():
    v = V.View()
    z = V.zoom(v, 1000, 1, 400, True)
    assert (z.visible, round(z.offset, 9)) == (90, 5)
    assert V.zoom(v, 1000, -1).visible == 110 and V.zoom(v, 1000, -1).offset == 0
    assert V.drag_time_axis(v, 20).visible == 90 and V.drag_time_axis(v, -20).visible == 110
    r = V.reset(z)
    assert (r.visible, r.offset, r.auto, r.y) == (150, 0, True, None)
    assert V.vertical_zoom(v, 1) == v
    m = V.set_auto(v, False, (0.0, 4.0), (10.0, 20.0))
    assert V.vertical_zoom(m, 1).y == (9.5, 20.5) and V.vertical_zoom(m, 1, True).atr_y == (-0.2, 4.2)
    assert V.vertical_pan(m, 40).y == (11, 21) and V.drag_value_axis(m, 20).y == (9.5, 20.5)
    assert V.pan(v, 1000, 16).offset == 2 and V.pan(v, 1000, 3) == v and V.pan(v, 1000, 1e9).offset == 998
    assert V.press(v, 1000, "Left").offset == 1 and V.press(v, 1000, "Right").offset == -1 and V.press(v, 1000, "r").visible == 150
    assert V.set_timeframe(v, "5m").tf == "5m" and V.set_timeframe(m, "7m") == V.reset(m)
    assert [V.clamped(0, 2, n) for n in (0, 1, 2, 3)] == [-2, -1, 0, 0] and V.clamped(-500, 100, 1000) == -98
    assert V.drag_time_axis(V.zoom(v, 1000, 1), 0).visible == 90 and V.zoom(v, 1000, 1, 5, True, width=10, left=20).visible == 90
    assert [V.active_panel(y) for y in (-1, 0, 399, 400, 559, 560)] == [None, "price", "price", "atr", "atr", None]
    assert len(V.replay(v, 1000, [("zoom", 1), ("pan", 80)])) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b,c,d,e,f\n2024-01-01 00:00,9,10,0.5,"1",9,extra\n2024-01-01T00:01:00,1,9,,,\n\nbad,-.5e1x,1e2\r\n2024-01-01 00:00,1,,3\n')
    (tmp_path / "empty.csv").write_text("a,b,c,d,e,f\n")
    read = read_csv(spark, str(tmp_path / "in.csv"))
    nil = (None,) * 3
    rows = [("2024-01-01 00:00", "9", "10", "0.5", '"1"', "9"), ("2024-01-01T00:01:00", "1", "9", *nil), (None, *nil, None, None), ("bad", "-.5e1x", "1e2\r", *nil), ("2024-01-01 00:00", "1", "", "3", None, None)]
    assert [tuple(r) for r in read.orderBy("seq").collect()] == [(k, *r) for k, r in enumerate(rows)]
    assert read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    typed = typed_bars(read).orderBy("idx").collect()
    assert [(r.ts and r.ts.minute, r.open, r.high, r.low) for r in typed] == [(0, 9, 10, 0.5), (1, 1, 9, 0), (None, 0, 0, 0), (None, -5, 100, 0), (0, 1, 0, 3)]
    one = resample_runs(typed_bars(read).where("idx < 2").withColumn("time", F.lit("2024-01-01 00:00")), "5m").first()
    assert (one.high, one.low, one.open) == (10, 0, 9)
    # many splits of a file keep the order of its lines
    (tmp_path / "long.csv").write_text("t,o,h,l,c,v\n" + "".join(f"{k},1,1,1,1,1\n" for k in range(5000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        long = read_csv(spark, str(tmp_path / "long.csv"))
        assert long.rdd.getNumPartitions() > 3 and long.where("time != seq").count() == 0 and long.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    keys = dict.fromkeys(["time", "open", "high", "low", "close", "volume"], "1")
    df = spark.createDataFrame([(0, keys | {"more": "x"}), (1, {"time": "1"}), (2, None), (3, keys | {"low": None})], "seq int, fields map<string,string>")
    good, bad = complete(df)
    assert sorted(r.seq for r in good.collect()) == [0, 3] and sorted(r.seq for r in bad.collect()) == [1, 2]
    bars = frame(spark, [1.0], [1.0], [1.0]).withColumn("tf", F.lit("1m"))
    write_bars(bars, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("day = '2024-01-01'").count() == 1


def test_registry(caplog):
    r = Registry()
    r.register("x", lambda bars: 1)
    r.register("x", lambda bars: 2)
    assert r.values("x", None) == 2
    assert r.values("y", None) is None and "'y'" in caplog.text
    r.register("z", lambda bars: "new", lambda bars: "put back")
    assert r.values("z", None) == "new"
    r.reset_all()
    assert r.values("z", None) == "put back" and r.values("x", None) == 2


def test_folds_by_blocks_equal_a_fold_of_the_whole(spark):
    df = wilder_atr(frame_of_walk(spark)).cache()
    whole = df.orderBy("idx").toPandas()
    for operator, fold in ((X.supertrend, SuperTrend()), (X.range_filter, RangeFilter()), (X.halftrend, HalfTrend())):
        want, _ = fold.through(fold.initial(), whole)
        got = operator(df, block=64, warm=20).orderBy("idx").collect()
        for name, values_ in want.items():
            assert np.allclose([r[name] for r in got], values_)


def test_levels_are_swept_however_late(spark):
    df = frame_of_walk(spark, 900)
    bars = df.orderBy("idx").collect()
    got = X.liquidity_states(df, fan=4).collect()
    assert {r.side for r in got} == {"BUY", "SELL"} and {r.kind for r in got} >= {"GRAB", "SWEEP", "RUN"}
    for r in got:
        beyond = (lambda b, p=r.price: b.high > p) if r.side == "BUY" else (lambda b, p=r.price: b.low < p)
        assert r.swept_idx == next((b.idx for b in bars if b.idx > r.level_idx + 3 and beyond(b)), None)
    assert max(r.swept_idx - r.level_idx for r in got if r.swept_idx) > 100


def frame_of_walk(spark, n=500):
    rng = random.Random(8)
    rows, close = [], 500.0
    for k in range(n):
        close += rng.gauss(0, 3)
        rows.append(("s", k, close + abs(rng.gauss(0, 2)), close - abs(rng.gauss(0, 2)), close))
    df = spark.createDataFrame(rows, "series string, k long, high double, low double, close double")
    return indexed(df.select("series", F.timestamp_seconds(F.col("k") * 60 + 1_700_000_000).cast("timestamp_ntz").alias("time"), F.col("close").alias("open"), "high", "low", "close", F.lit(1.0).alias("volume")))


def test_windows_in_blocks_equal_those_in_one_block(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s, f"2024-01-{1 + i // 60:02d} 00:{i % 60:02d}:00", *(float(rng.randrange(50, 90)) for _ in range(3))) for s in "ab" for i in range(400 if s == "a" else 3)]
    df = spark.createDataFrame(rows, "series string, t string, x double, y double, close double")
    high, low = F.greatest("x", "y", "close"), F.least("x", "y", "close")
    bars = indexed(df.select("series", F.col("t").cast("timestamp_ntz").alias("time"), F.col("close").alias("open"), high.alias("high"), low.alias("low"), "close", F.lit(2.0).alias("volume"))).cache()

    def made():
        breaks = X.structure_breaks(bars)
        vwap = X.anchored_vwap(bars, breaks).withColumn("vwap", F.round("vwap", 9))
        return [sorted(map(repr, d.collect())) for d in (X.swing_points(bars), X.fair_value_gaps(bars), breaks, vwap)]

    whole = made()
    assert len(whole[0]) > 10 and len(whole[2]) > 5 and len(whole[3]) == 403
    monkeypatch.setattr(X, "BLOCK", 16)
    assert made() == whole
    assert X.structure_breaks(bars.limit(0)).count() == 0 and X.anchored_vwap(bars, X.structure_breaks(bars.limit(0))).where("vwap IS NOT NULL").count() == 0
