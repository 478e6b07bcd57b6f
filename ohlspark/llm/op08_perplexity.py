"""Quality classifier: an interpolated modified Kneser-Ney model of byte five-grams, trained on all
trusted documents; joins with the sharded counts give each document's perplexity, and quantiles of
its language set the threshold.

UTF-8 bytes are the symbols, so no text has unknown symbols, while the table of five-grams grows with the
trusted text. A gram lives in the shard of its two bytes before the last, as do all its suffixes of three
bytes or more and their contexts; shorter grams, at most 65,536, are in every shard. So one join
on the shard has all that a probability needs.

Documents are gathered in blocks. A block sends each shard the distinct five-grams of its texts, packed, gets
their probabilities back, and is scored with them; grams are asked for once a block, not once a document.
Blocks meet a shard in groups of bounded size, each with one copy of the shard. A model with more shards asks less of each, so its groups hold more
text: as the model grows with the text, the number of copies hardly does.
Log-probabilities are whole micro-bits, so sums are the same in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohlspark.llm.common import broadcast_if, fresh, settled, table

ORDER = 5
#: Rows of the model that a shard may hold.
SHARD_ROWS = 1 << 20
SHARDS = 8  # at least
#: Text of a block, of the chunks that it is worked on in, and, for each shard of the model, of the blocks that meet one copy of it; bytes.
BLOCK_BYTES, CHUNK_BYTES, GROUP_BYTES = 32 << 20, 1 << 20, 512 << 20
#: Of the trusted documents, one in so many is held out to set the thresholds.
HELD_OUT = 5
QUANTILE = 0.995
#: A language's quantile is drawn towards that of all languages as if by so many held-out documents.
PRIOR_DOCUMENTS = 100
#: A score is drawn towards the median of its language as if by so many bytes, as short texts vary more.
PRIOR_BYTES = 128
BINS = 1000  # of a bit


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all bytes of the texts, each text after ORDER - 1 line ends and before one, and where each text's begin."""
    pad = b"\n" * (ORDER - 1)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    b = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\n")), np.uint8).astype(np.int64)
    whole = b[: len(b) - ORDER + 1].copy()
    for k in range(1, ORDER):
        whole <<= 8
        whole |= b[k : len(b) - ORDER + 1 + k]
    inside = np.ones(len(whole), bool)
    ends = np.cumsum(sizes + ORDER - 1)
    for k in range(ORDER - 1):  # windows that reach into the next text
        at = ends[:-1] - 1 - k
        inside[at] = False
    return whole[inside], np.cumsum(sizes) - sizes


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Rows of about `limit` bytes of text; the text comes last in a row, as bytes."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch[c] for c in batch.schema.names), strict=True):
            *own, text = (x.as_py() for x in row)
            data = (text or "").encode()
            held.append((*own, data))
            size += len(data)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams with their numbers, by about 16 chunks of text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def whole() -> pa.RecordBatch:
        keys, code = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(code, np.concatenate([n for _, n in held])).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_pydict({"gram": keys, "n": n})

    for rows in _chunks(batches, CHUNK_BYTES):
        held.append(np.unique(grams_of([r[-1] for r in rows])[0], return_counts=True))
        if len(held) == 16:
            yield whole()
    if held:
        yield whole()


def _discounted(grams: DataFrame, context: Column) -> DataFrame:
    """grams(gram, n) -> gram, context, alpha (discounted share in its context), gamma (what the context leaves)."""
    ones = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in range(1, 5)]
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    take = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)) for k in (1, 2, 3)]
    d = grams.agg(*ones).select(*(F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), F.coalesce(t, F.lit(0.0)))).alias(f"d{k}") for k, t in enumerate(take, 1)))
    d1, d2, d3 = d.first()  # one row
    n = F.col("n")
    cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
    by = grams.withColumn("context", context)
    totals = by.groupBy("context").agg(F.sum("n").alias("total"), F.sum((n == 1).cast("long")).alias("k1"), F.sum((n == 2).cast("long")).alias("k2"), F.sum((n > 2).cast("long")).alias("k3"))
    left = (F.col("k1") * d1 + F.col("k2") * d2 + F.col("k3") * d3) / F.col("total")
    return by.join(totals, "context").select("gram", "context", ((n - cut) / F.col("total")).alias("alpha"), left.alias("gamma"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, int]:
    """counts(gram, n) of five-grams, settled -> the model and its number of shards: shard (-1 for every shard),
    kind, gram, value. Kind k > 0 is alpha of the grams of order k, -k gamma of their contexts; for order 1
    the alpha is the whole probability, and as gram -1 that of a byte never seen."""
    shards = max(SHARDS, -(-2 * counts.count() // SHARD_ROWS))
    at = lambda g: shard_of(g.bitwiseAND(0xFFFF), shards).cast("int")
    g, out = F.col("gram"), []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            counts = settled(counts.groupBy(g.bitwiseAND((1 << 8 * order) - 1).alias("gram")).agg(F.count("*").alias("n")))
        table_ = settled(_discounted(counts, F.shiftright(g, 8)))
        every = F.lit(-1)
        if order == 1:
            unseen = F.col("gamma") / 256
            out.append(table_.select(every.alias("shard"), F.lit(1).alias("kind"), "gram", (F.col("alpha") + unseen).alias("value")))
            out.append(table_.groupBy().agg(F.max(unseen).alias("value")).where("value IS NOT NULL").select(every.alias("shard"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("gram"), "value"))
            break
        shard = every if order == 2 else at(F.shiftright(g, 8))
        out.append(table_.select(shard.alias("shard"), F.lit(order).alias("kind"), "gram", F.col("alpha").alias("value")))
        contexts = table_.groupBy("context").agg(F.first("gamma").alias("value"))
        out.append(contexts.select((every if order == 2 else at(F.col("context"))).alias("shard"), F.lit(-order).alias("kind"), F.col("context").alias("gram"), "value"))
    model = out[0]
    for part in out[1:]:
        model = model.unionByName(part)
    return settled(model), shards


def shard_of(pair: Column | np.ndarray, shards: int) -> Column | np.ndarray:
    """Of the two bytes before a gram's last."""
    return pair * 40503 % 65536 % shards


class Shard:
    """The rows of a shard, for looking up the probabilities of its grams."""

    def __init__(self, rows: pd.DataFrame):
        kind, gram, value = (rows[c].to_numpy() for c in ("kind", "gram", "value"))
        self.tables = {}
        for k in np.unique(kind).tolist():
            names, values = gram[kind == k], value[kind == k]
            order = np.argsort(names)
            self.tables[k] = names[order], values[order]
        names, values = self.tables.get(1, (np.empty(0), np.empty(0)))
        self.rare = float(values[0]) if len(names) and names[0] == -1 else 1 / 256

    def _held(self, k: int, keys: np.ndarray, otherwise: float) -> np.ndarray:
        if k not in self.tables:
            return np.full(len(keys), otherwise)
        names, values = self.tables[k]
        i = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where(names[i] == keys, values[i], otherwise)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        p = self._held(1, grams & 0xFF, self.rare)
        for k in range(2, ORDER + 1):
            x = grams & ((1 << 8 * k) - 1)
            p = self._held(k, x, 0.0) + self._held(-k, x >> 8, 1.0) * p
        return p


_DOCS = pa.list_(pa.struct([("doc", pa.string()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64())]))
BLOCKS = "block long, shard int, bytes long, docs array<struct<doc: string, doc_id: long, lang: string, n_bytes: long>>, payload binary"


def _packed(x: np.ndarray) -> bytes:
    """First all lowest bytes, then the next, and so on: the high ones are mostly zero."""
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _numbers(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _unpacked(payload: bytes) -> np.ndarray:
    return np.cumsum(_numbers(payload, np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows(doc, doc_id, lang, text) -> for each block a row of shard -1 with its documents and packed texts, and one
    for each shard with the distinct grams that the texts have in it."""
    task, made = TaskContext.get().partitionId(), 0
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("bytes", pa.int64()), ("docs", _DOCS), ("payload", pa.binary())])
    pack = zstandard.ZstdCompressor(level=6)

    def block() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(grams))
        at = shard_of(keys >> 8 & 0xFFFF, shards)
        rows = [(task << 32 | made, -1, size, ids, b"".join(texts))]
        for s in range(shards):
            mine = keys[at == s]
            if len(mine):
                rows.append((task << 32 | made, s, size, None, _packed(np.diff(mine, prepend=0))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ids, texts, grams, size = [], [], [], 0
    for rows in _chunks(batches, CHUNK_BYTES):
        ids += [{"doc": doc, "doc_id": i, "lang": lang, "n_bytes": len(t) + 1} for doc, i, lang, t in rows]
        data = pack.compress(b"".join(r[-1] for r in rows))
        texts.append(len(rows).to_bytes(4, "little") + len(data).to_bytes(4, "little") + data)
        grams.append(np.unique(grams_of([r[-1] for r in rows])[0]))
        if len(grams) == 8:
            grams = [np.unique(np.concatenate(grams))]
        size += sum(len(r[-1]) for r in rows)
        if size >= BLOCK_BYTES:
            yield block()
            made, ids, texts, grams, size = made + 1, [], [], [], 0
    if ids:
        yield block()


def _answered(requests: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """One group of blocks and the shard that they meet: each block's grams with their micro-bits."""
    shard, out = Shard(model), []
    for block, payload in zip(requests["block"], requests["payload"], strict=True):
        bits = np.rint(-1e6 * np.log2(shard(_unpacked(payload)))).astype(np.uint32)
        out.append((block, payload, _packed(bits)))
    return pd.DataFrame(out, columns=["block", "grams", "bits"])


def _scored(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """One block: its documents with the micro-bits of their texts."""
    grams = np.concatenate([_unpacked(x) for x in answers["grams"]])
    bits = np.concatenate([_numbers(x, np.uint32) for x in answers["bits"]]).astype(np.int64)
    order = np.argsort(grams)
    grams, bits = grams[order], bits[order]
    docs, payload = blocks["docs"].iat[0], blocks["payload"].iat[0]
    done, k, unpack, total = 0, 0, zstandard.ZstdDecompressor(), np.zeros(len(docs), np.int64)
    while done < len(payload):
        n, size = (int.from_bytes(payload[done + x : done + x + 4], "little") for x in (0, 4))
        data = unpack.decompress(payload[done + 8 : done + 8 + size])
        cuts = np.cumsum([0, *(d["n_bytes"] - 1 for d in docs[k : k + n])]).tolist()
        own, starts = grams_of([data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])
        total[k : k + n] = np.add.reduceat(bits[np.searchsorted(grams, own)], starts)
        done, k = done + 8 + size, k + n
    return pd.DataFrame({"doc": [d["doc"] for d in docs], "doc_id": pd.array([d["doc_id"] for d in docs], "Int64"), "lang": [d["lang"] for d in docs], "n_bytes": [d["n_bytes"] for d in docs], "micro_bits": total})


def document_key(doc_id: Column, text: Column) -> Column:
    """What a row is known by: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def score(docs: DataFrame, model: DataFrame, shards: int) -> DataFrame:
    """docs(doc_id, text, lang), model of kneser_ney -> a row for each: doc (its key), doc_id, lang, n_bytes, micro_bits (minus log2 of its probability)."""
    rows = docs.select(document_key(F.col("doc_id"), F.col("text")).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    blocks = settled(rows.mapInArrow(lambda batches: _blocks(batches, shards), BLOCKS))
    size = blocks.where("shard = -1").agg(F.sum("bytes")).first()[0] or 0
    groups = max(1, -(-size // (GROUP_BYTES * shards)))
    asked = blocks.where("shard >= 0").select("shard", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("part"), "block", "payload")
    every = F.when(F.col("shard") < 0, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array("shard"))
    copies = model.withColumn("at", F.explode(every)).select("at", "kind", "gram", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("copy"))
    answers = asked.groupBy("shard", "part").cogroup(copies.groupBy("at", "copy")).applyInPandas(_answered, "block long, grams binary, bits binary")
    texts = blocks.where("shard = -1").select(F.col("block").alias("own"), "docs", "payload")
    return texts.groupBy("own").cogroup(answers.groupBy("block")).applyInPandas(_scored, "doc string, doc_id long, lang string, n_bytes long, micro_bits long")


def _quantile(values: DataFrame, by: list[str], q: float, name: str) -> DataFrame:
    """values(by, value) -> by, name: the upper edge of the bin in which a share q of the values lies at or below, and their
    number name_n; bounded memory, exact counts."""
    bins = values.groupBy(*by, F.ceil(F.col("value") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = bins.select(*by, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
    return upto.where(F.col("upto") >= q * F.col("total")).groupBy(*by).agg((F.min("bin") / BINS).alias(name), F.first("total").alias(f"{name}_n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> doc_id, held_out: ids that all their labels call good and not toxic."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).cast("int")).alias("good"))
    return good.where("good = 1").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held_out"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """docs(doc_id, text, lang), labels(doc_id, quality, toxic) -> doc, doc_id, lang, n_bytes, bits_per_byte,
    perplexity (per byte), score, threshold, kept: one row for each row of docs.

    The model counts all trusted documents but the held-out ones. score is bits_per_byte drawn
    towards the median of its language (of all documents, those that the model counted too), as if by PRIOR_BYTES bytes. A document is kept if its score is at most the threshold: its
    language's median plus the quantile of how far the scores of the held-out trusted documents of its language lie
    above it; that quantile is a mean of the language's, weighted by its held-out documents, and that of
    all languages, weighted by PRIOR_DOCUMENTS. A null text is empty, a null language is ''; a row without an
    id is known by its text, `doc` says by what. Repeated rows are scored each. Without any held-out trusted text every document is
    kept, with null threshold. Columns other than those named are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    trusted = settled(trusted_ids(labels))
    small = broadcast_if(trusted, 16 * trusted.count(), broadcast_bytes)
    train = docs.join(small.where("NOT held_out"), "doc_id", "left_semi").select("text")
    counts = train.mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    scored = settled(score(docs, *kneser_ney(settled(counts))).withColumn("value", F.col("micro_bits") / 1e6 / F.col("n_bytes")))
    middles = settled(_quantile(scored, ["lang"], 0.5, "middle").select("lang", "middle"))
    above = (F.col("value") - F.col("middle")) * F.col("n_bytes") / (F.col("n_bytes") + PRIOR_BYTES)
    judged = scored.join(broadcast_if(middles, 64 * middles.count(), broadcast_bytes), "lang").withColumn("above", above)
    trial = settled(judged.join(small.where("held_out"), "doc_id", "left_semi").select("lang", F.col("above").alias("value")))
    common = _quantile(trial, [], quantile, "common").first()["common"]  # one row
    if common is None:
        limit = F.lit(None).cast("double")
    else:
        own = settled(_quantile(trial, ["lang"], quantile, "own"))
        judged = judged.join(broadcast_if(own, 64 * own.count(), broadcast_bytes), "lang", "left")
        n = F.coalesce("own_n", F.lit(0))
        limit = (F.coalesce("own", F.lit(0.0)) * n + common * PRIOR_DOCUMENTS) / (n + PRIOR_DOCUMENTS)
    return judged.withColumn("limit", limit).select(
        "doc", "doc_id", "lang", "n_bytes", F.col("value").alias("bits_per_byte"), F.pow(F.lit(2.0), "value").alias("perplexity"), (F.col("middle") + F.col("above")).alias("score"),
        (F.col("middle") + F.col("limit")).alias("threshold"), F.coalesce(F.col("above") <= F.col("limit"), F.lit(True)).alias("kept"),
    )


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("doc")


def kept_documents(docs: DataFrame, labels: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with.

    Rows that share an id stand or fall together, and so do rows without an id that share a text.
    """
    doc = fresh("doc", docs)
    out = settled(classify(docs, labels).where("NOT kept").select(F.col("doc").alias(doc)).distinct())
    keyed = docs.withColumn(doc, document_key(F.col("doc_id"), F.col("text")))
    return keyed.join(broadcast_if(out, 64 * out.count(), broadcast_bytes), doc, "left_anti").select(docs.columns)
