"""Near-duplicates by BagMinHash over multisets of word shingles.

A shingle's count is its weight. Its unit intervals (0, 1], (1, 2], (2, 4], (4, 8], ... each
carry a Poisson process, seeded by the shingle; an event's mark says in which unit step of its
interval it falls, as a descent through halves would, and it counts if the shingle's weight
reaches that step. Each event belongs to one of the signature's components, which keeps the
earliest. So two bags agree in a component with a probability equal to their weighted Jaccard
similarity. Events are drawn in the order of time up to a horizon beyond which no component is
likely to be still empty; a bag with an empty component is drawn again with a longer one.

Signatures are cut into bands, and texts that share a band's key are in one bucket. First the texts of
a bucket are compared with its most central member, the one whose buckets are largest; that
already joins most groups. Buckets that still hold several groups are then finished: their texts are dealt out
in blocks, every two blocks of a bucket meet in a task, and all pairs of texts of different groups are
compared there, each pair in the first bucket that it shares. Small buckets share a task. Pairs whose
signatures differ too much are left out, every other pair is verified on the exact bags, and only
links come out, a forest for each task: no pair is lost whatever the size of a bucket. Work grows with the square of a
bucket that holds many groups, rows with the square over BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlspark.llm.common import broadcast_if, fresh, settled, table
from ohlspark.llm.graph import components
from ohlspark.llm.op01_decontaminate import WORD, lowered

WORDS_A_SHINGLE = 5
SIMILAR = (4, 5)  # at least 4/5
BANDS, ROWS = 24, 4
M = BANDS * ROWS
#: Documents whose bags are drawn together: at most so many, and so many characters; shingles drawn at once.
TOGETHER, CHARS, DRAWN = 256, 1 << 20, 1 << 19
#: Pairs whose signatures agree in fewer of the 96 components are not verified: of pairs at a similarity of 0.8
#: that misses 3.0 in 1,000,000, no more than the bands themselves (3.2).
LEAST_AGREE = 58
#: Texts of a bucket, and their shingles, that meet another block's in one task.
BLOCK, BLOCK_SHINGLES = 1000, 500_000
#: Words whose hashes a worker keeps, none longer than so many characters.
CACHE, CACHED = 1 << 16, 40

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}  # of this worker


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag_of(text: str, size: int = WORDS_A_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, sorted, and their counts. Fewer words than `size` are one shingle."""
    words = WORD.findall(lowered(text))
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(_known) > CACHE:
        _known.clear()
    own = {}
    for w in set(words).difference(_known):
        (_known if len(w) <= CACHED else own)[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter((_known[w] if w in _known else own[w] for w in words) if own else map(_known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(ids) - size + 1
    h = ids[:n].copy()
    for k in range(1, size):
        h *= np.uint64(0x9FB21C651E98DF25)  # odd: a polynomial of well-mixed word hashes
        h += ids[k : k + n]
    h = mix(h)
    return np.unique(h, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the multisets' intersection and union."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


def _draw(keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, horizon: np.ndarray, m: int) -> np.ndarray:
    """For each bag and component the time of the earliest event before the bag's horizon, else infinity."""
    first = np.full(len(horizon) * m, np.inf)
    for k in range(0, len(keys), DRAWN):
        some = slice(k, k + DRAWN)
        _draw_some(first, keys[some], weights[some], doc[some], horizon, m)
    return first.reshape(-1, m)


def _draw_some(first: np.ndarray, keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, horizon: np.ndarray, m: int) -> None:
    top = np.ceil(np.log2(weights)).astype(np.int64)  # the last interval that a weight reaches into
    level = np.concatenate([np.zeros(len(keys), np.int64), *(np.full(int((top >= j).sum()), j) for j in range(1, int(top.max(initial=0)) + 1))])
    at = np.concatenate([np.arange(len(keys)), *(np.flatnonzero(top >= j) for j in range(1, int(top.max(initial=0)) + 1))])
    state = mix(keys[at] + level.astype(np.uint64) * _GOLD)
    steps = np.maximum(1, 1 << np.maximum(level - 1, 0))  # unit steps in the interval
    base = np.where(level == 0, 0, steps)
    w, d, time = weights[at], doc[at], np.zeros(len(at))
    until = horizon[d]
    while len(state):
        state = mix(state + _GOLD)
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / (m * steps)
        go = time < until
        state, steps, base, w, d, time, until = (x[go] for x in (state, steps, base, w, d, time, until))
        more = mix(state ^ np.uint64(0xD1B54A32D192ED03))
        component = (more % np.uint64(m)).astype(np.int64)
        step = base + 1 + (((more >> np.uint64(32)).astype(float) / (1 << 32)) * steps).astype(np.int64)
        counts = step <= w
        np.minimum.at(first, d[counts] * m + component[counts], time[counts])


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """A row of m event times for each bag; an empty bag's are infinite. No row depends on another bag."""
    out = np.full((len(bags), m), np.inf)
    todo = np.array([k for k, b in enumerate(bags) if len(b[0])], np.int64)
    stretch = 1.0
    while len(todo):
        some = [bags[k] for k in todo]
        horizon = stretch * (np.log(m) + 6) / np.array([b[1].sum() for b in some], float)
        doc = np.repeat(np.arange(len(some)), [len(b[0]) for b in some])
        out[todo] = _draw(np.concatenate([b[0] for b in some]), np.concatenate([b[1] for b in some]), doc, horizon, m)
        todo = todo[np.isinf(out[todo]).any(1)]
        stretch *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(bags, m) times -> (bags, bands) hashes of equal runs of components."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        out = mix(out * np.uint64(5) + bits[:, :, k] + _GOLD)
    return out.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def drawn(ids: list, nodes: list, texts: list[str]) -> pa.RecordBatch:
        bags = [bag_of(t) for t in texts]
        sums = signatures(bags)
        size = pa.array([int(x[1].sum()) for x in bags], pa.int64())
        low = (mix(sums.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
        bands = pa.array([row if len(x[0]) else None for x, row in zip(bags, band_keys(sums).tolist(), strict=True)], pa.list_(pa.int64()))
        columns = [pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), size, bands, pa.array([x.tobytes() for x in low], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n_shingles", "bands", "low"])

    for b in batches:
        ids, nodes, texts, chars = [], [], [], 0
        for doc_id, node, text in zip(b["doc_id"], b["node"], b["text"], strict=True):
            ids.append(doc_id.as_py())
            nodes.append(node.as_py())
            texts.append(text.as_py())
            chars += len(texts[-1])
            if len(texts) == TOGETHER or chars >= CHARS:
                yield drawn(ids, nodes, texts)
                ids, nodes, texts, chars = [], [], [], 0
        if texts:
            yield drawn(ids, nodes, texts)
    _known.clear()


class Bags:
    """The bags of some texts, for comparing one with many; memory in proportion to the shingles."""

    def __init__(self, texts: Iterable[str]):
        bags = [bag_of(t) for t in texts]
        self.size = np.array([len(b[0]) for b in bags], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        hashes = np.concatenate([b[0] for b in bags] or [np.empty(0, np.uint64)])
        self.ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
        self.counts = np.concatenate([b[1] for b in bags] or [np.empty(0, np.int64)])
        self.total = np.array([b[1].sum() for b in bags], np.int64)
        self.weight = np.zeros(int(self.ids.max(initial=-1)) + 1, np.int64)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of others, none without shingles, those whose similarity with i is high enough."""
        mine = slice(self.start[i], self.start[i + 1])
        sizes = self.size[others]
        at = np.concatenate([[0], np.cumsum(sizes)])
        theirs = np.arange(at[-1]) + np.repeat(self.start[others] - at[:-1], sizes)
        self.weight[self.ids[mine]] = self.counts[mine]
        both = np.add.reduceat(np.minimum(self.weight[self.ids[theirs]], self.counts[theirs]), at[:-1])
        self.weight[self.ids[mine]] = 0
        return others[SIMILAR[1] * both >= SIMILAR[0] * (self.total[i] + self.total[others] - both)]


class Forest:
    """Labels 0 to n - 1 that links make one."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> bool:
        a, b = self.label[i], self.label[j]
        self.label[self.label == b] = a
        return bool(a != b)


def _verified(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """One task: pairs(a, b) -> those whose bags are similar."""
    if not len(pairs):
        return pairs[["a", "b"]]
    bags, at = Bags(texts["text"]), {n: k for k, n in enumerate(texts["node"])}
    out = []
    for a, some in pairs.groupby("a")["b"]:
        others = np.array([at[b] for b in some])
        out += [(a, texts["node"].iat[j]) for j in bags.similar(at[a], others)]
    return pd.DataFrame(out, columns=["a", "b"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = [np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, M) for c in ("low_a", "low_b")]
        yield b.select(["a", "b"]).filter(pa.array((low[0] == low[1]).sum(1) >= LEAST_AGREE, pa.bool_()))


def candidates(low: np.ndarray, bands: np.ndarray, comp: np.ndarray, key: int, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Rows i and, for each, the rows j after it (from `first` on) of another group whose signatures agree enough with i's, where key
    is the first band's that the two share."""
    n, at_once = len(low), max(1, (1 << 20) // max(len(low), 1))
    columns = np.ascontiguousarray(low.T)
    for i0 in range(0, first or n, at_once):
        i1 = min(i0 + at_once, first or n)
        j0 = max(first, i0 + 1)
        if j0 >= n:
            return
        agree = np.zeros((i1 - i0, n - j0), np.uint8)
        for c in columns:
            agree += c[i0:i1, None] == c[None, j0:]
        near = (agree >= LEAST_AGREE) & (comp[i0:i1, None] != comp[None, j0:])
        for i in np.flatnonzero(near.any(1)) + i0:
            j = np.flatnonzero(near[i - i0]) + j0
            j = j[j > i]
            shared = bands[j] == bands[i]
            j = j[bands[i][shared.argmax(1)] == key]
            if len(j):
                yield i, j


def _buckets(group: pd.DataFrame, comp: np.ndarray) -> Iterator[tuple[slice, Iterator[tuple[int, np.ndarray]]]]:
    """One task, its rows in the order of key and side: for each of its buckets the rows and their candidates."""
    key, side = group["key"].to_numpy(), group["side"].to_numpy()
    low = np.frombuffer(b"".join(group["low"]), np.uint8).reshape(-1, M)
    bands = np.stack(group["bands"].to_numpy())
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        first = int((side[x:y] == 0).sum()) if side[y - 1] else 0
        yield slice(x, y), candidates(low[x:y], bands[x:y], comp[x:y], key[x], first)


def _wanted(group: pd.DataFrame) -> pd.DataFrame:
    """One task: the rows that are a candidate of another."""
    group = group.sort_values(["key", "side", "node"])
    hit = np.zeros(len(group), bool)
    for rows, found in _buckets(group, pd.factorize(group["comp"])[0]):
        for i, j in found:
            hit[rows.start + i] = hit[rows.start + j] = True
    return group.loc[hit, ["task", "p", "q", "key", "side", "node"]]


def _across(group: pd.DataFrame) -> pd.DataFrame:
    """One task: the links between groups that similar texts give, as a forest."""
    group = group.sort_values(["key", "side", "node"])
    distinct = group.drop_duplicates("node")
    bags, at = Bags(distinct["text"]), {n: k for k, n in enumerate(distinct["node"])}
    place = group["node"].map(at).to_numpy()
    code, comps = pd.factorize(group["comp"])
    forest, out = Forest(len(comps)), []
    for rows, found in _buckets(group, code):
        text, own = place[rows], code[rows]
        for i, j in found:
            j = j[forest.label[own[j]] != forest.label[own[i]]]
            if len(j):
                hit = set(bags.similar(text[i], text[j]).tolist())
                for k in j:
                    if text[k] in hit and forest.join(own[i], own[k]):
                        out.append((comps[own[i]], comps[own[k]]))
    return pd.DataFrame(out, columns=["a", "b"])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups(node, comp) with the components that edges(a, b) link made one."""
    new = components(edges)
    new = broadcast_if(new, 64 * new.count())
    return settled(groups.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))


def _stars(buckets: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """buckets(key, node), members(node, score, n_shingles, low, bands), n rows -> links(a, b) of a
    bucket's texts with its most central one."""
    scored = buckets.join(broadcast_if(members.select("node", "score"), 64 * n), "node")
    tops = scored.groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("a"))
    pairs = buckets.join(tops, "key").select("a", F.col("node").alias("b")).where("a != b").distinct()
    a, b = (broadcast_if(members.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}")), 192 * n) for c in "ab")
    return settled(pairs.join(a, "a").join(b, "b").select("a", "b", "low_a", "low_b").mapInArrow(_agreeing, "a binary, b binary"))


def links(pairs: DataFrame, texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """pairs(a, b), texts(node, text), shingles(node, n_shingles) -> the pairs whose bags are similar. The
    partners of an `a` are dealt out to tasks by their number and size; a text goes to a task once."""
    sizes = pairs.join(shingles.select(F.col("node").alias("b"), "n_shingles"), "b").groupBy("a").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    filled = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES))
    sizes = settled(sizes.withColumn("parts", filled(F.col("n"), F.col("shingles"))))
    bins = sizes.agg(filled(F.sum("n"), F.sum("shingles"))).first()[0] or 1
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    task = F.pmod(F.xxhash64("a", F.when(F.col("parts") > 1, part)), F.lit(bins))
    dealt = settled(pairs.join(sizes.select("a", "parts"), "a").select(task.alias("task"), "a", "b"))
    ends = dealt.select("task", F.col("a").alias("node")).unionByName(dealt.select("task", F.col("b").alias("node"))).distinct()
    there = ends.join(texts, "node").select(F.col("task").alias("at"), "node", "text")
    return settled(dealt.groupBy("task").cogroup(there.groupBy("at")).applyInPandas(lambda x, y: _verified(x, y), "a binary, b binary"))


def _dealt(now: DataFrame, n: int) -> DataFrame:
    """now(key, node, comp, n_shingles) of open buckets -> task, p, q, side, key, node, comp: in a task the
    blocks p (side 0) and q (side 1) of a bucket meet; a bucket of one block is on side 0 alone."""
    filled = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES))
    by = settled(now.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).withColumn("parts", filled(F.col("n"), F.col("shingles"))))
    whole = by.groupBy("key").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), (F.countDistinct("comp") > 1).alias("open")).where("open")
    whole = settled(whole.withColumn("blocks", filled(F.col("n"), F.col("shingles"))))
    bins = whole.where("blocks = 1").agg(filled(F.sum("n"), F.sum("shingles"))).first()[0] or 1
    rows = now.join(whole.select("key", "blocks"), "key")
    nil = F.lit(None)
    alone = rows.where("blocks = 1").select(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("task"), nil.cast("string").alias("p"), nil.cast("string").alias("q"), F.lit(0).alias("side"), "key", "node", "comp")
    # a group that fills several blocks has blocks of its own, which needn't meet each other; others lie together in a block
    large = by.join(whole.where("blocks > 1").select("key"), "key")
    rest = large.where("parts = 1").groupBy("key").agg(filled(F.sum("n"), F.sum("shingles")).alias("others"))
    own = F.col("parts") > 1
    k = F.when(own, F.pmod(F.xxhash64("node"), "parts")).otherwise(F.pmod(F.xxhash64("comp"), "others"))
    block = F.concat(F.when(own, F.hex("comp")).otherwise(""), F.lit(":"), k)
    blocked = settled(rows.where("blocks > 1").join(large.select("key", "comp", "parts"), ["key", "comp"]).join(rest, "key", "left").select("key", "node", "comp", block.alias("block")))
    blocks = blocked.select("key", "block").distinct()
    group = lambda c: F.substring_index(c, ":", 1)
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & ((group("x.block") != group("y.block")) | (group("x.block") == ""))
    meets = settled(blocks.alias("x").join(blocks.alias("y"), meet).select("x.key", F.col("x.block").alias("p"), F.col("y.block").alias("q")))
    sides = [meets.select("*", F.col("p").alias("block"), F.lit(0).alias("side")), meets.where("p != q").select("*", F.col("q").alias("block"), F.lit(1).alias("side"))]
    several = blocked.join(sides[0].unionByName(sides[1]), ["key", "block"]).select(F.col("key").alias("task"), "p", "q", "side", "key", "node", "comp")
    return settled(alone.unionByName(several))


def _finished(groups: DataFrame, buckets: DataFrame, members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """groups(node, comp), n rows, after all pairs of different groups in the buckets have been compared."""
    now = buckets.join(broadcast_if(groups, 64 * n), "node")
    spread = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    now = settled(now.join(spread.select("key"), "key").join(broadcast_if(members.select("node", "n_shingles"), 48 * n), "node").select("key", "node", "comp", "n_shingles"))
    if not now.limit(1).count():
        return groups
    dealt = _dealt(now, n)
    signed = dealt.join(broadcast_if(members.select("node", "low", "bands"), 400 * n), "node")
    places = ["task", "p", "q", "key", "side", "node"]
    wanted = settled(signed.groupBy("task", "p", "q").applyInPandas(lambda g: _wanted(g), "task long, p string, q string, key long, side int, node binary"))
    full = wanted.join(broadcast_if(groups, 64 * n), "node").join(broadcast_if(members.select("node", "low", "bands"), 400 * n), "node").join(texts, "node").select(*places, "comp", "low", "bands", "text")
    edges = settled(full.groupBy("task", "p", "q").applyInPandas(lambda g: _across(g), "a binary, b binary"))
    return _joined(groups, edges) if edges.limit(1).count() else groups


def _grouped(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes(node, n_shingles, bands, low) -> node, comp for the nodes that share a band with another."""
    flat = nodes.select("node", F.explode("bands").alias("key"))
    shared = settled(flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = settled(flat.join(shared, "key"))
    scores = buckets.groupBy("node").agg(F.sum("n").alias("score"))
    buckets = buckets.select("key", "node")
    members = settled(nodes.join(scores, "node"))
    n = members.count()
    ends = broadcast_if(members.select("node"), 48 * n)  # within the limit the texts of other documents aren't shuffled
    texts = docs.where(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("node"), "text").join(ends, "node", "left_semi")
    texts = settled(texts.groupBy("node").agg(F.first("text").alias("text")))
    groups = members.select("node", F.col("node").alias("comp"))
    edges = links(_stars(buckets, members, n), texts, members.select("node", "n_shingles"))
    if edges.limit(1).count():
        groups = _joined(groups, edges)
    return _finished(groups, buckets, members, texts, n)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, node, n_shingles, comp: a row for each row of docs.

    Rows of one comp are one group: equal texts, and texts linked, directly or through others, by
    a weighted Jaccard similarity of 0.8 or more of their multisets of five-word shingles (words as
    in decontamination; fewer than five words are one shingle). node is the text's key. A null
    text has a null node and comp and is in no group; texts without words are grouped only if
    equal. Null ids and repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("node"))
    rows = settled(rows.mapInArrow(_banded, "doc_id long, node binary, n_shingles long, bands array<long>, low binary"))
    nodes = rows.where("node IS NOT NULL AND bands IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("n_shingles").alias("n_shingles"))
    groups = _grouped(settled(nodes), docs)
    return rows.select("doc_id", "node", "n_shingles").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, class_id (the least doc_id of the group) and class_size."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    groups = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(groups, "comp", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, the one of the least (doc_id, text key), with the
    columns it came with. Rows with a null text all stay; of repeated rows one stays."""
    found = near_duplicates(docs).where("comp IS NOT NULL")
    best = found.groupBy("comp", "doc_id", "node").agg(F.count("*").alias("n")).groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "node", "n")).alias("best")
    )
    own_id, own_node, times = (fresh(c, docs) for c in ("best_id", "best_node", "best_n"))
    best = settled(best.select(F.col("best.doc_id").alias(own_id), F.col("best.node").alias(own_node), F.col("best.n").alias(times)))
    d = docs.alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col(own_id)) & (text_key(F.col("d.text")) == F.col(own_node))
    once = d.join(best.where(F.col(times) == 1), same, "left_semi")
    again = d.join(best.where(F.col(times) > 1), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).unionByName(docs.where(F.col("text").isNull()))
