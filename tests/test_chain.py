"""From CSV files to bars, timeframes and ATR; what a load tells; refused timeframes."""

import logging

import pytest
from pyspark.sql import functions as F

from ohlspark.operators.indicators import wilder_atr, with_repeated_last
from ohlspark.operators.marks import frame, viewed
from ohlspark.operators.resample import active, build_timeframes, followed_timeframes, merge_deltas, resample_runs
from ohlspark.operators.series import bar_slice, indexed, size, time_anchors
from ohlspark.schema import kept_timeframe
from ohlspark.sources.bars import ingest, load, no_bars, read_bars, read_csv, typed_bars, write_bars

LINES = """time,open,high,low,close,volume
2024-01-02 09:31:00,10,12,9,11,5
2024-01-02 09:32:00,11,13,10,12,6
2024-01-02 09:36:00,12,14,11,13,7

2024-01-02 09:33:00,13,15,12,14,8
2024-01-02 09:37:00,14x,16,13
soon,1,2,3,4,5
2024-01-02 09:46:00,15,17,14,16,9,extra
"""


@pytest.fixture
def path(tmp_path):
    (tmp_path / "datos.csv").write_text(LINES)
    return str(tmp_path / "datos.csv")


def test_the_whole_chain(spark, path):
    loaded = load(spark, path)
    bars = loaded.bars
    assert (loaded.loaded, loaded.set_aside, loaded.without_time) == (8, 0, 2)
    assert [r.close for r in bars.orderBy("seq").collect()] == [11, 12, 13, 0, 14, 0, 4, 16]
    at = indexed(bars).orderBy("idx").collect()
    assert [r.idx for r in at] == list(range(8)) and [r.prev_close for r in at] == [None, 11, 12, 13, 0, 14, 0, 4]
    tf = build_timeframes(bars)
    rows = lambda name: [(r.idx, r.time, r.open, r.high, r.low, r.close, r.volume) for r in active(tf, name).orderBy("idx").collect()]
    assert len(rows("1m")) == 8 and rows("1m")[3] == (3, None, 0, 0, 0, 0, 0)
    assert rows("5m") == [  # 09:33 comes late and is a run of its own
        (0, "2024-01-02 09:30:00", 10, 13, 9, 12, 11), (1, "2024-01-02 09:35:00", 12, 14, 11, 13, 7), (2, "2024-01-02 09:30:00", 13, 15, 12, 14, 8),
        (3, "2024-01-02 09:35:00", 14, 16, 13, 0, 0), (4, "2024-01-02 09:45:00", 15, 17, 14, 16, 9),
    ]
    assert [r[:2] for r in rows("15m")] == [(0, "2024-01-02 09:30:00"), (1, "2024-01-02 09:45:00")]
    assert resample_runs(bars, "5m").count() == 5
    tr = [12, 3, 3, 13, 15, 3, 3, 13]
    want = [sum(tr[:3]) / 3] * 3
    for x in tr[3:]:
        want.append((want[-1] * 2 + x) / 3)
    got = [r.atr for r in wilder_atr(bars, 3).orderBy("idx").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True)), (got, want)
    assert wilder_atr(with_repeated_last(indexed(bars)), 3).count() == 9
    assert size(bars).first().n == 8 and bar_slice(bars, 2, 3.5).count() == 2 and time_anchors(bars).count() == 0
    assert merge_deltas(bars).count() == 7
    drawn = frame(wilder_atr(bars, 3).withColumn("time_text", F.coalesce("time", F.lit(""))))
    assert {"body", "wick", "line", "last", "time_label"} <= {r.kind for r in drawn.collect()}


def test_typed_bars_of_read_csv_without_a_load(spark, path):
    bars = typed_bars(read_csv(spark, path))
    assert build_timeframes(bars).groupBy("tf").count().count() == 3 and wilder_atr(bars).count() == 8


def test_rows_that_lack_a_key_are_set_aside_in_the_same_pass(spark, caplog):
    rows = [(0, {k: "1" for k in ("time", "open", "high", "low", "close", "volume")}), (1, {"time": "2024-01-02 09:31"}), (2, None), (3, {k: None for k in ("time", "open", "high", "low", "close", "volume", "more")})]
    with caplog.at_level(logging.INFO):
        got = ingest(spark.createDataFrame(rows, "seq long, fields map<string,string>"))
    assert (got.loaded, got.set_aside, got.without_time) == (2, 2, 2)
    assert [r.seq for r in got.bars.orderBy("seq").collect()] == [0, 3] and [r.seq for r in got.aside.orderBy("seq").collect()] == [1, 2]
    assert got.report().collect() == [(2, 2, 2)]
    assert "loaded 2 bars" in caplog.text and "2 rows lack a key" in caplog.text
    empty = ingest(spark.createDataFrame([], "seq long, fields map<string,string>"))
    assert (empty.loaded, empty.set_aside, empty.without_time, empty.bars.count()) == (0, 0, 0, 0)


def test_unknown_timeframes_are_told_of_and_refused(spark, caplog):
    assert kept_timeframe("5m", "15m") == "15m" and kept_timeframe("5m", "7m") == "5m" and "7m" in caplog.text
    rows = [("a", 0, "7m"), ("a", 1, "5m"), ("a", 2, None), ("b", 0, "15m"), ("b", 1, "1h")]
    got = followed_timeframes(spark.createDataFrame(rows, "session string, step int, tf string")).orderBy("session", "step").collect()
    assert [(r.active, r.refused) for r in got] == [("1m", True), ("5m", False), ("5m", True), ("15m", False), ("15m", True)]


def test_series_without_bars(spark, caplog):
    bars = no_bars(spark)
    assert build_timeframes(bars, warn=True).count() == 0 and "no bars" in caplog.text
    assert size(bars).count() == 0 and wilder_atr(bars).count() == 0 and viewed(indexed(bars), 100).count() == 0
    assert frame(wilder_atr(bars).withColumn("time_text", F.col("time").cast("string"))).count() == 0


def test_the_base_stands_for_an_empty_first_timeframe(spark, caplog):
    base = indexed(spark.sql("SELECT 'a' AS series, TIMESTAMP_NTZ'2024-01-02 10:00:00' AS time, 1.0D AS open, 2.0D AS high, 0.5D AS low, 1.5D AS close, 3.0D AS volume"))
    none = no_bars(spark)
    assert [(r.tf, r.idx, r.close) for r in active(none, "1m", base).collect()] == [("1m", 0, 1.5)]
    assert active(none, "5m", base).count() == 0 and "5m has no bars" in caplog.text
    assert active(build_timeframes(base), "15m", base).count() == 1


def test_stored_bars_prune_files(spark, tmp_path):
    bars = spark.sql("SELECT 'a' AS series, '1m' AS tf, 0L AS idx, TIMESTAMP_NTZ'2024-01-02 10:00:00' AS time, 1.0D AS close UNION ALL SELECT 'a', '5m', 0L, TIMESTAMP_NTZ'2024-01-03 10:00:00', 2.0D")
    write_bars(bars, str(tmp_path / "bars"))
    assert [r.close for r in read_bars(spark, str(tmp_path / "bars"), "5m").collect()] == [2.0]
    one = read_bars(spark, str(tmp_path / "bars"), start="2024-01-01", end="2024-01-02")
    assert [r.close for r in one.collect()] == [1.0]
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()
