"""Connected components by DataFrame joins; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohlspark.llm.common import broadcast_if, settled

ROWS_A_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, comp: every node of an edge with the least node of its component.

    Each round a node takes the least label among its neighbours' and then its label's label
    (pointer jumping), until nothing changes. Tables of known small size are broadcast and held in few partitions. Self-loops and repeated edges do no harm; no
    edges give no rows.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    few = max(1, -(-n // ROWS_A_TASK))
    small = lambda df: broadcast_if(df, 64 * n)
    both = both.coalesce(few)
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")).coalesce(few))
    while True:
        near = both.join(small(labels), both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(small(near), labels.node == near.a).select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("top"))
        jumped = settled(least.join(small(up), "low").select("node", F.least("low", "top").alias("comp"), (F.least("low", "top") < F.col("comp")).alias("moved")).coalesce(few))
        labels = jumped.select("node", "comp")
        if not jumped.where("moved").limit(1).count():
            return labels
