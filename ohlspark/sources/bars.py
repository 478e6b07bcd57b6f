"""Bars from CSV files and from ticks."""

from __future__ import annotations

import logging
import tempfile
from dataclasses import dataclass
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ohlspark.functions.scalars import number
from ohlspark.schema import BAR, FIELDS


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Positional: the first line of a file is passed over, columns after the sixth are dropped, missing ones are null, nothing is
    quoted; a blank line is a row of nulls. seq numbers the lines from 0 in the order of files and lines: Spark's
    splits of the files are counted, and a line's number is its place in its split after those before it."""
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.option("lineSep", "\n").text(path).select(file, block, F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))  # a row for each split
    header = F.when(F.col("block") == 0, 1).otherwise(0)
    upto = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "block", "first", header.alias("header"), F.coalesce(F.sum(F.col("n") - header).over(upto), F.lit(0)).alias("base"))
    place = F.col("id") - F.col("first") - F.col("header")
    rows = lines.join(base, ["file", "block"]).where(place >= 0)
    kept = F.regexp_replace("value", ",+$", "")
    fields = F.split(kept, ",", -1)
    return rows.select((F.col("base") + place).cast("long").alias("seq"), *(F.when(kept != "", F.get(fields, k)).alias(c) for k, c in enumerate(FIELDS)))


def typed_bars(rows: DataFrame, series: str = "all", keep: list[str] | None = None) -> DataFrame:
    """Rows of texts(seq, time, ...) -> series, tf `1m`, idx (the order of arrival), seq, time (its text), ts (null where it can't be
    read) and numbers: a field counts as its leading number, 0 without one; and the columns of keep."""
    ts = F.regexp_extract("time", r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?)", 1).try_cast("timestamp_ntz")
    return rows.select(F.lit(series).alias("series"), F.lit("1m").alias("tf"), F.col("seq").alias("idx"), "seq", "time", ts.alias("ts"), *(number(F.col(c)).alias(c) for c in FIELDS[1:]), *(keep or []))


def passing_folder(spark: SparkSession) -> str:
    """A new name in the folder that the cluster shares (spark.checkpoint.dir), or in a temporary one where that is unset. What is written there
    is deleted when the application ends."""
    out = f"{spark.conf.get('spark.checkpoint.dir', None) or Path(tempfile.mkdtemp(prefix='spark-')).as_uri()}/{uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table in the shared folder."""
    out = passing_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def write_bars(bars: DataFrame, path: str, format: str = "parquet") -> None:
    """Partitioned by series, timeframe and day, so windows of time prune files."""
    bars.withColumn("day", F.to_date("time")).write.partitionBy("series", "tf", "day").format(format).save(path)


def complete(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a map `fields` -> those that have all six keys (null values are accepted), and the rest."""
    whole = has_all_keys()
    return rows.where(whole).select("seq", *(F.col("fields")[k].alias(k) for k in FIELDS)), rows.where(~whole)


def has_all_keys() -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, FIELDS)), F.map_keys("fields"))) == 0, F.lit(False))


@dataclass(frozen=True)
class Ingested:
    """Bars as a table of their own, what was set aside, and what was counted in the pass that wrote both."""

    bars: DataFrame
    aside: DataFrame
    loaded: int
    set_aside: int
    without_time: int

    def report(self) -> DataFrame:
        return self.bars.sparkSession.createDataFrame([(self.loaded, self.set_aside, self.without_time)], "loaded long, set_aside long, without_time long")


def ingest(rows: DataFrame, series: str = "all") -> Ingested:
    """Rows (seq, map `fields` of texts) -> typed bars, and the rows that lack a key. One pass over the rows counts them, with
    DataFrame.observe, and writes both sides. What was set aside or has no readable time is told of in the log."""
    whole = has_all_keys()
    texts = rows.select("seq", "fields", whole.alias("whole"), *(F.col("fields")[k].alias(k) for k in FIELDS))
    made = typed_bars(texts, series, keep=["whole", "fields"])
    seen = Observation()
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    out = settled(made.observe(seen, n(F.col("whole")).alias("loaded"), n(~F.col("whole")).alias("set_aside"), n(F.col("whole") & F.col("ts").isNull()).alias("without_time")))
    counts = seen.get
    log = logging.getLogger(__name__)
    log.info("loaded %d bars", counts["loaded"])
    if counts["set_aside"] or counts["without_time"]:
        log.warning("%d rows lack a key and were set aside; %d bars have no time that can be read", counts["set_aside"], counts["without_time"])
    return Ingested(out.where("whole").drop("whole", "fields"), out.where("NOT whole").select("seq", "fields"), counts["loaded"], counts["set_aside"], counts["without_time"])


def load(spark: SparkSession, path: str, series: str = "all") -> Ingested:
    """The bars of CSV files, in the order of files and lines, blank lines and fields that are no numbers included: see read_csv and
    typed_bars. They are written once to the shared folder; timeframes and indicators start from there."""
    rows = read_csv(spark, path)
    return ingest(rows.select("seq", F.create_map(*(x for c in FIELDS for x in (F.lit(c), F.col(c)))).alias("fields")), series)


def no_bars(spark: SparkSession) -> DataFrame:
    """A series without bars."""
    return spark.createDataFrame([], BAR)


def read_bars(spark: SparkSession, path: str, tf: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """What write_bars wrote; a timeframe and days (start and end included) leave files unread."""
    out = spark.read.parquet(path)
    for kept in (F.col("tf") == tf if tf else None, F.col("day") >= F.lit(start).cast("date") if start else None, F.col("day") <= F.lit(end).cast("date") if end else None):
        out = out if kept is None else out.where(kept)
    return out.drop("day")


def usable_price(low: Column) -> Column:
    """The guard of the price range: only the text of low is tested, for digits and points alone."""
    return F.coalesce(low.rlike(r"^[0-9.]+$"), F.lit(False))


def bars_from_ticks(ticks: DataFrame, time: str, price: Column, order: list[str], minutes: int | None = 1, volume: Column | None = None, series: Column | None = None) -> DataFrame:
    """Ticks -> series, time, open, high, low, close, volume by tumbling windows of whole minutes, or by `time` itself.

    One shuffle, with partial aggregates before it. open and close are the first and last by `order`,
    which must be total; volume defaults to the number of ticks.
    """
    at = F.struct(*order)
    slot = F.window(time, f"{minutes} minutes")["start"] if minutes else F.col(time)
    rows = ticks.select((series if series is not None else F.lit("all")).alias("series"), slot.alias("time"), at.alias("at"), price.alias("price"), (volume if volume is not None else F.lit(1.0)).alias("volume"))
    return rows.groupBy("series", "time").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("volume").alias("volume")
    )


def event_bars(spark: SparkSession, sf_dir: str, minutes: int = 1, by_type: bool = False) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars_from_ticks(events, "ts", F.col("value"), ["ts", "event_id"], minutes, series=F.col("event_type") if by_type else None)


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the unit price by ship date."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return bars_from_ticks(items, "l_shipdate", F.col("l_extendedprice") / F.col("l_quantity"), order, None, F.col("l_quantity"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bars_from_ticks(orders, "o_orderdate", F.col("o_totalprice"), ["o_orderkey"], None)
