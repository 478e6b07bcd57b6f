"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child makes one draw from the
hash of (doc_id, child's path), -ln(u) / weight, and the smallest draw wins (Efraimidis and
Spirakis' exponential draws, as in weighted rendezvous hashing). A child's draw does not depend
on its siblings, so a changed weight moves documents only into or out of the subtree it belongs
to. A shard that is added as a region of its own takes documents only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohlspark.llm.common import table

#: Nested weights: region -> rack -> shard number -> weight. A subtree weighs what its shards weigh.
Tree = dict[str, dict[str, dict[int, float]]]
#: 16 equal shards: 4 regions of 2 racks of 2 shards.
TREE: Tree = {f"region{r}": {f"rack{k}": {r * 4 + k * 2 + s: 1.0 for s in range(2)} for k in range(2)} for r in range(4)}


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    n = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"region-of-{n}": {"rack0": {n: weight}}}


def _draw(doc_id: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(path)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _descend(doc_id: Column, children: list[tuple[str, float, Column]]) -> Column:
    """children: (path, weight, what it gives). The child with the least draw; ties go to the first, without weight none goes."""
    children = [c for c in children if c[1] > 0] or children[:1]
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(doc_id, path, weight) for path, weight, _ in children]
    gives = [give for *_, give in children]
    least, out = F.least(*draws), gives[-1]
    for d, g in list(zip(draws, gives, strict=True))[-2::-1]:
        out = F.when(d == least, g).otherwise(out)
    return out


def shard_of(doc_id: Column, tree: Tree) -> Column:
    """The shard number of an id; null ids all hash alike, to one shard."""
    doc_id = F.coalesce(doc_id.cast("string"), F.lit("null"))
    weigh = lambda shards: sum(shards.values())
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in shards.items()]
            inner.append((f"{region}/{rack}", weigh(shards), _descend(doc_id, leaves)))
        regions.append((region, sum(weigh(s) for s in racks.values()), _descend(doc_id, inner)))
    return _descend(doc_id, regions).cast("int")


def shard_documents(docs: DataFrame, tree: Tree = TREE, cells: int = 1024) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1; a null text counts as empty. Slots are gapless from 0 in each
    shard: rows fall into `cells` cells a shard by hash, wholly equal rows are counted before
    they are shuffled, and a cell's first slot is the sum of the cells before it, so no task
    holds a shard or a hot key. Equal rows get different slots; an empty table gives no rows.
    Columns other than doc_id and text are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("shard", shard_of(F.col("doc_id"), tree))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)))
    )
    counts = rows.groupBy("shard", "cell").agg(F.sum("copies").alias("n"))  # at most shards x cells rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("skip", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "cell"])
    slots = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("skip")).alias("base"), slots.alias("copy")
    ).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("copy")).cast("long").alias("slot"), shard_of(F.col("doc_id"), grown(tree)).alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
