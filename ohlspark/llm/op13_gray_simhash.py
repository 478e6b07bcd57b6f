"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

A fingerprint has a bit set where more than half of a text's word shingles, repeats included, have it set in their hash. Fingerprints that
differ in few bits are linked, and what is linked through others is one component.

Distinct fingerprints are ordered by their rank in the reflected Gray code, in which neighbours share many bits wherever
the order is cut. FAN neighbours form a node, FAN nodes a node above, up to one root; so every node at a level holds equally many, however
the fingerprints are spread. A node keeps which bits all of its fingerprints share, and their values. The index is joined with itself from
the root down: a pair of nodes goes on to its children only if it differs in at most `distance` of the bits that
both share; what is pruned can't hold a link. The bits that a child shares hold those of its parent, so what is counted at a pair is what has
accumulated on the way down. Levels above blocks are joined as tables, a level a step; in a task, a pair of blocks is
searched the same way over its own levels. Of each pair of blocks only a forest of its links comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ohlspark.llm.common import broadcast_if, numbered, settled, table
from ohlspark.llm.graph import components

WORDS, SEED, DISTANCE = 3, 42, 2
#: Children of a node, and fingerprints of a block, which is searched in one task; a block is FAN * FAN or more.
FAN, BLOCK = 16, 4096


def fingerprint(text: str | None, size: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's shingles of `size` words, A-Z lower-cased; fewer words are one shingle, none give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words)) - 1
    n = len(words) - k
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k:].tolist(), strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bits of a part at a time
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp: the fingerprint's 64 bits as a long. A text without words, or null, has 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def gray_rank(fp: Column) -> list[Column]:
    """Where a code word stands in the reflected Gray code: two columns to order by, upper and lower half, as longs have a sign."""
    rank = fp
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    return [F.shiftrightunsigned(rank, 32), rank.bitwiseAND(F.lit(0xFFFFFFFF))]


def _shared(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of an array: which bits are alike within each row, and their values."""
    both, some = np.bitwise_and.reduce(fps, 1), np.bitwise_or.reduce(fps, 1)
    return both | ~some, both


def _levels(fps: np.ndarray, fan: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared bits, values) of the nodes of a block from fingerprints up to one root; the last node of a level may hold fewer."""
    out = [(np.full(len(fps), ~np.uint64(0)), fps)]
    while len(out[-1][0]) > 1:
        mask, value = out[-1]
        cuts = np.arange(0, len(mask), fan)
        both, some = np.bitwise_and.reduceat(value, cuts), np.bitwise_or.reduceat(value, cuts)
        out.append((np.bitwise_and.reduceat(mask, cuts) & (both | ~some), both))
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int, fan: int = FAN, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the fingerprints of two blocks that differ in at most `distance` bits, found from both roots down; of one
    block with itself each pair once. Pairs of nodes that wait are worked on in parts, the deepest first, so that few wait."""
    same = a is b
    la = _levels(a, fan)
    lb = la if same else _levels(b, fan)
    top = max(len(la), len(lb)) - 1
    grid = np.arange(fan)
    wait = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    part = max(1, at_once // fan**2)
    while wait:
        level, i, j = wait.pop()
        if len(i) > part and level:
            wait.append((level, i[part:], j[part:]))
            i, j = i[:part], j[:part]
        (ma, va), (mb, vb) = la[min(level, len(la) - 1)], lb[min(level, len(lb) - 1)]
        near = np.bitwise_count((va[i] ^ vb[j]) & ma[i] & mb[j]) <= distance
        i, j = i[near], j[near]
        if not len(i):
            continue
        if not level:
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        # a tree that is lower than the other one keeps its root until they stand at the same level
        down_a, down_b = level < len(la), level < len(lb)
        ca = (i[:, None] * fan + grid) if down_a else i[:, None]
        cb = (j[:, None] * fan + grid) if down_b else j[:, None]
        ca, cb = (x.ravel() for x in np.broadcast_arrays(ca[:, :, None], cb[:, None, :]))
        na = len(la[level - 1][0]) if down_a else len(la[-1][0])
        nb = len(lb[level - 1][0]) if down_b else len(lb[-1][0])
        kept = (ca < na) & (cb < nb)
        if same:
            kept &= ca <= cb
        wait.append((level - 1, ca[kept], cb[kept]))


class Forest:
    """Which links join what was not joined before."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_pairs(blocks: DataFrame, distance: int = DISTANCE, fan: int = FAN) -> DataFrame:
    """blocks(block, mask, value) -> a, b (a <= b): the blocks that may hold a link. Nodes above blocks, each of `fan` below it, are made up to
    one root, and pairs are followed from the root down; a pair that differs in more than `distance` bits that both share ends there."""
    levels = [blocks.select(F.col("block").alias("node"), "mask", "value")]
    n = blocks.count()
    while n > 1:
        shared = F.bit_and("mask").bitwiseAND(F.bit_and("value").bitwiseOR(F.bitwise_not(F.bit_or("value"))))
        above = levels[-1].groupBy(F.floor(F.col("node") / fan).alias("node")).agg(shared.alias("mask"), F.bit_and("value").alias("value"))
        levels.append(settled(above))
        n = -(-n // fan)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for below in reversed(levels[:-1]):
        size = below.count() * 64
        child = below.withColumn("up", F.floor(F.col("node") / fan))
        left = child.select(F.col("up").alias("a"), F.col("node").alias("x"), F.col("mask").alias("xm"), F.col("value").alias("xv"))
        right = child.select(F.col("up").alias("b"), F.col("node").alias("y"), F.col("mask").alias("ym"), F.col("value").alias("yv"))
        both = pairs.join(broadcast_if(left, size), "a").join(broadcast_if(right, size), "b").where("x <= y")
        apart = F.bit_count(F.col("xv").bitwiseXOR(F.col("yv")).bitwiseAND(F.col("xm")).bitwiseAND(F.col("ym")))
        pairs = settled(both.where(apart <= distance).select(F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs


def links(fps: DataFrame, distance: int = DISTANCE, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> a, b: links between fingerprints that differ in at most `distance` bits, enough of them to join all that
    are linked (a forest for each pair of blocks); none without fingerprints."""
    placed = numbered(fps.select("fp"), gray_rank(F.col("fp")), "place")
    shared = F.bit_and("fp").bitwiseOR(F.bitwise_not(F.bit_or("fp")))
    held = settled(
        placed.groupBy(F.floor(F.col("place") / block).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "fp"))).alias("rows"), shared.alias("mask"), F.bit_and("fp").alias("value"))
        .select("block", F.transform("rows", lambda r: r["fp"]).alias("fps"), "mask", "value")
    )  # at most `block` fingerprints in a row
    n = held.count()
    meet = block_pairs(held, distance, fan)
    size = n * block * 8

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(batch.column("a"), batch.column("b"), batch.column("x"), batch.column("y"), strict=True):
                left = x.values.to_numpy().view(np.uint64)
                right = left if a == b else y.values.to_numpy().view(np.uint64)
                forest, kept, k = Forest(), [], 0 if a == b else len(left)
                for i, j in close_pairs(left, right, distance, fan):
                    kept += [(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q + k)]
                if kept:
                    i, j = np.array(kept).T
                    yield pa.RecordBatch.from_arrays([pa.array(left[i].view(np.int64)), pa.array(right[j].view(np.int64))], ["a", "b"])

    left = held.select(F.col("block").alias("a"), F.col("fps").alias("x"))
    right = held.select(F.col("block").alias("b"), F.col("fps").alias("y"))
    dealt = meet.repartition(max(1, -(-meet.count() // 64)), "a", "b")
    return dealt.join(broadcast_if(left, size), "a").join(broadcast_if(right, size), "b").select("a", "b", "x", "y").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = WORDS, distance: int = DISTANCE, seed: int = SEED, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that is reachable by links, its own included).

    Texts without words, null ones too, have fingerprint zero and are linked like any other. A null doc_id gets its
    component's id, which is null only where no document of the component has one. Repeated rows each give a row; ties don't arise; other columns are
    left out; an empty table gives no rows.
    """
    made = settled(fingerprints(docs, size, seed))
    least = settled(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    edges = links(least, distance, fan, block)
    comps = components(edges)
    of = least.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    ids = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = settled(of.join(ids, "comp").select("fp", "component_id", "copies"))
    return _joined(made, named).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(rows: DataFrame, named: DataFrame, limit: int = 16 << 20, parts: int = 1000) -> DataFrame:
    """rows by fp to the one row of named of their fp; beyond a size that can be broadcast the fingerprints of very many documents go apart."""
    if named.count() * 32 <= limit:
        return rows.join(F.broadcast(named.drop("copies")), "fp")
    total = named.agg(F.sum("copies")).first()[0]
    often = F.col("copies") > total // parts  # fewer than `parts` fingerprints
    few, rest = F.broadcast(named.where(often).drop("copies")), named.where(~often).drop("copies")
    return rows.join(few, "fp").unionByName(rows.join(F.broadcast(few.select("fp")), "fp", "left_anti").join(rest.hint("shuffle_hash"), "fp"))


def op13_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
