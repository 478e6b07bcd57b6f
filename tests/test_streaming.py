from pyspark.sql import functions as F

from ohlspark.operators.indicators import wilder_atr
from ohlspark.operators.series import indexed
from ohlspark.sources.bars import event_bars
from ohlspark.operators.resample import merge_deltas
from ohlspark.plans.catalogue import streamed
from ohlspark.streaming.live import latest_bars, live_atr, live_bars, live_upserts

SF = "/root/testdata/sf0.001"


def test_live_bars_equal_batch_bars_for_closed_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.lit("all").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), F.col("value").alias("price"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = live_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 5)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.time: tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.time: tuple(r)[2:] for r in event_bars(spark, SF, 5).select("series", "time", "open", "high", "low", "close", "volume").collect()}
    got = {t.replace(tzinfo=None): v for t, v in got.items()}
    assert len(want) - len(got) <= 3 and all(want[t] == v for t, v in got.items())


def test_live_atr_equals_batch_atr_after_the_seed(spark, tmp_path):
    bars = indexed(event_bars(spark, SF)).withColumn("time", F.col("time").cast("timestamp"))
    some = bars.select("series", "time", "high", "low", "close")
    some.orderBy("time").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live_atr(spark.readStream.schema(some.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.atr for r in spark.read.parquet(str(tmp_path / "out")).orderBy("time").collect()]
    want = [r.atr for r in wilder_atr(indexed(event_bars(spark, SF))).orderBy("idx").collect()]
    assert got[:13] == [None] * 13 and all(abs(a - b) < 1e-9 for a, b in zip(got[13:], want[13:], strict=True))


def test_upserts_however_they_are_cut_into_batches(spark):
    times = [0, 0, 1, 1, 0, 0, 2, 2, 2, 1, 3, 3, 3, 4]
    rows = [("ab"[k % 5 == 0], k, None if k == 9 and t is None else t, float(k), float(k % 4), None if k in (3, 10) else float(-k), float(k + 1), float(k)) for k, t in enumerate([*times, None, 4])]
    df = spark.createDataFrame(rows, "series string, seq long, minute long, open double, high double, low double, close double, volume double").withColumn("time", F.timestamp_seconds(F.col("minute") * 60)).drop("minute")
    columns = ["series", "run", "time", "open", "high", "low", "close", "volume"]
    for compat in ("reference", "corrected"):
        want = sorted((tuple(r) for r in merge_deltas(df, compat=compat).select(columns).collect()), key=str)
        for parts in (1, 3):
            touched = streamed(df, lambda s, c=compat: live_upserts(s, compat=c), "seq", parts)
            got = latest_bars(touched)
            assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == want
            assert got.where("late").count() == 2
    assert latest_bars(touched.limit(0)).count() == 0
