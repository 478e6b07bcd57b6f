"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a temporary one only where that
    is unset (tests, a laptop)."""
    return spark.conf.get("spark.checkpoint.dir", None) or Path(tempfile.mkdtemp(prefix="spark-")).as_uri()


def passing(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the application ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table written to the shared folder; smaller there than a checkpoint.
    The table is deleted when the application ends."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(df.schema).parquet(passing(spark, out))


def broadcast_if(df: DataFrame, size: int, limit: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if its known size in bytes is within the limit, else df for a shuffled join."""
    return F.broadcast(df) if size <= limit else df


def fresh(name: str, df: DataFrame) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, order: list[Column], name: str, times: Column | None = None, rows_a_range: int = 200_000) -> DataFrame:
    """df with `name`: how many rows come before a row in that order, which must be total; a row counts `times` over. Rows are dealt out by
    ranges of the order, each range is numbered apart and starts after those before it, so no task orders the table."""
    df = settled(df)  # its ranges are sampled first
    part, n = fresh("part", df), fresh("n", df)
    ranges = max(1, -(-df.count() // rows_a_range))
    times = F.lit(1) if times is None else times
    dealt = settled(df.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()).withColumn(n, times.cast("long")))
    earlier = (Window.unboundedPreceding, -1)
    sums = dealt.groupBy(part).agg(F.sum(n).alias(n))  # a row for each range
    starts = sums.select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(*earlier)), F.lit(0)).alias(fresh("first", df)))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(part).orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    placed = dealt.withColumn(name, inside).join(F.broadcast(starts), part)
    return placed.select(*df.columns, (F.col(name) + F.col(fresh("first", df))).cast("long").alias(name))
