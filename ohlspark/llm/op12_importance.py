"""Importance resampling towards a target distribution, over hashed features.

Features of a text are its runs of 1 to `longest` words, hashed into buckets. What the buckets hold over all source documents and over the
target texts gives each bucket a gain, the logarithm of the ratio of both shares with one added to every count. A document weighs the
sum of the gains of its features; with Gumbel noise on the weight, the greatest scores are a draw without replacement
(Gumbel top-k) in proportion to the weights.

Identical texts are collapsed first, by grouping on the whole text: features and weight are made once for each
text, its counts count as often as it occurs, and the weight is joined back to the documents before each of them gets its own noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlspark.llm.common import numbered, settled, table

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10

#: Bytes of words as they are, A-Z lower-cased, every other ASCII byte as a space.
_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 0x20 for b in range(256))
_FEATURES = "n_words long, n_features long, buckets array<int>"


def hashed(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of a text's words, and the bucket of each of its features, repeats included."""
    words = (text or "").encode().translate(_WORDS).split()
    out = [np.fromiter(map(crc32, words), np.int64, len(words))]
    for k in range(2, longest + 1):
        out.append(np.fromiter((crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)), np.int64))
    return len(words), np.concatenate(out) % buckets


def features(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """texts(text, ...) -> the columns of keep, n_words, n_features, buckets (one entry for each feature)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashed(t.as_py(), longest, buckets) for t in batch.column("text")]
            sizes = np.array([len(b) for _, b in made], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *(b for _, b in made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([n for n, _ in made], pa.int64()), pa.array(sizes), lists], [*keep, "n_words", "n_features", "buckets"])

    kinds = dict(texts.dtypes)
    return texts.select(*keep, "text").mapInArrow(scan, ", ".join([*(f"{c} {kinds[c]}" for c in keep), _FEATURES]))


def bucket_counts(made: DataFrame, times: Column) -> DataFrame:
    """features -> bucket, n: how often each bucket is hit, a row's hits `times` over; at most as many rows as there are buckets. Rows are
    added up in their task, so what is shuffled doesn't grow with the texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            column = batch.column("buckets")
            hits, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            if len(hits):
                at, where = np.unique(hits, return_inverse=True)
                total = np.zeros(len(at), np.int64)
                np.add.at(total, where, np.repeat(batch.column("times").to_numpy(), sizes))
                for b, n in zip(at.tolist(), total.tolist(), strict=True):
                    sums[b] = sums.get(b, 0) + n
        yield pa.RecordBatch.from_pydict({"bucket": list(sums), "n": list(sums.values())}, pa.schema([("bucket", pa.int32()), ("n", pa.int64())]))

    return made.select("buckets", times.cast("long").alias("times")).mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket_counts of both sides -> bucket, gain: floor(1000 * ln) of the ratio of the target's share of the bucket to the
    source's, every bucket counted once more on both sides. One row for each bucket."""
    sums = source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # two rows of one
    rows = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t, S, T = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (S + buckets) / ((s + 1) * (T + buckets))
    return rows.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(made: DataFrame, gains: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """features with a column weight, the sum of their gains, in place of buckets. The gains, one number a bucket, go to every task."""
    table_of = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():  # as many rows as there are buckets
        table_of[bucket] = gain
    sent = made.sparkSession.sparkContext.broadcast(table_of)
    rest = [c for c in made.columns if c != "buckets"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("buckets")
            upto = np.concatenate([[0], np.cumsum(sent.value[column.flatten().to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.diff(upto[ends]), pa.int64())], [*rest, "weight"])

    kinds = dict(made.dtypes)
    return made.mapInArrow(add, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "weight long"]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from the hash of its id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank.

    Of the N documents with `least_words` words or more, floor(percent * N / 100) are drawn: the greatest scores, ties to the smaller
    doc_id (null first). rank counts the drawn ones from 1, null for the others. A null or empty text
    has no features and weighs 0; a null doc_id's noise is that of an empty id. Repeated rows are documents of their own, with ranks of their
    own; other columns are left out; empty tables give no rows, and an empty target counts 0 everywhere.

    Texts meet by whole text with their number counted before the shuffle, so a text told again by a third of all documents is one row; the
    weights come back to the documents by the text's SHA-256, broadcast where that is small, and otherwise by a shuffle in which the few texts
    that are told very often go apart. Equal rows are counted before they are ordered, and the order is dealt out by ranges.
    """
    whole = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", whole.alias("text"), F.sha2(whole, 256).alias("key"))
    texts = keyed.groupBy("key", "text").agg(F.count("*").alias("copies"))
    made = settled(features(texts, longest, buckets, ("key", "copies")))
    gains = bucket_gains(bucket_counts(made, F.col("copies")), bucket_counts(features(target, longest, buckets), F.lit(1)), buckets)
    weights = settled(weighed(made, gains, buckets))
    rows = _joined(keyed.select("doc_id", "key"), weights)
    scored = rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    alike = settled(scored.groupBy(scored.columns).agg(F.count("*").alias("copies")))
    may, others = alike.where(F.col("n_words") >= least_words), alike.where(F.col("n_words") < least_words)
    n = may.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    drawn = percent * n // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("weight"), F.col("n_features"), F.col("n_words")]
    placed = numbered(may, order, "place", F.col("copies")).unionByName(others.withColumn("place", F.lit(None).cast("long")))
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rank = F.col("place") + F.col("copy") + 1
    return each.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def _joined(rows: DataFrame, weights: DataFrame, limit: int = 16 << 20, parts: int = 1000) -> DataFrame:
    """rows by key to the one row of weights of their key."""
    weights = weights.select("key", "n_words", "n_features", "weight", "copies")
    if weights.count() * 160 <= limit:
        return rows.join(F.broadcast(weights.drop("copies")), "key")
    total = weights.agg(F.sum("copies")).first()[0]
    often = F.col("copies") > total // parts  # fewer than `parts` keys
    few, rest = F.broadcast(weights.where(often).drop("copies")), weights.where(~often).drop("copies")
    return rows.join(few, "key").unionByName(rows.join(F.broadcast(few.select("key")), "key", "left_anti").join(rest.hint("shuffle_hash"), "key"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORD = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT doc_id, {_WORD} AS w, row_number() OVER () AS rid FROM documents),
dw AS (SELECT rid, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORD}) AS word FROM benchmark),
v AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, o: list_reduce(list_prepend(xor(c, o), range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % {BUCKETS} AS bucket FROM v),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (word) GROUP BY 1),
u AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS all_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + {BUCKETS}) / ((s::DOUBLE + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), u),
w AS (SELECT rid, sum(gain) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
o AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (rid)),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS k, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * n // 100 THEN k END AS rank FROM r
"""
