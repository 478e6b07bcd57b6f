import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ohlspark.llm import op08_perplexity
from ohlspark.llm.op08_perplexity import HELD_OUT, ORDER, PRIOR_BYTES, PRIOR_DOCUMENTS, QUANTILE, classify, kept_documents, op8_perplexity

SF = "/root/testdata/sf0.01"


def grams(text, k=ORDER):
    b = b"\n" * (k - 1) + text.encode() + b"\n"
    return [b[i : i + k] for i in range(len(b) - k + 1)]


def plain_model(texts):
    """Bits of a gram, from dictionaries."""
    counts = Counter(g for t in texts for g in grams(t))
    levels = []
    for _ in range(ORDER):
        n = Counter(counts.values())
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [min(max(k - (k + 1) * y * n[k + 1] / max(n[k], 1), 0.1), k - 0.1) for k in (1, 2, 3)]
        total, left = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        levels.append((counts, d, total, left))
        counts = Counter(g[1:] for g in counts)

    def bits(g):
        p = 1 / 256
        for counts, d, total, left in reversed(levels):
            x = g[len(g) - len(next(iter(counts))) :]
            if x[:-1] in total:
                c = counts.get(x, 0)
                p = (c - (d[min(c, 3) - 1] if c else 0)) / total[x[:-1]] + left[x[:-1]] / total[x[:-1]] * p
        return -np.log2(p)

    return bits


def test_scores_and_thresholds_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(op08_perplexity, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(op08_perplexity, "BLOCK_BYTES", 100_000)  # many blocks
    monkeypatch.setattr(op08_perplexity, "GROUP_BYTES", 60_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    good = labels.where("quality = 1 AND toxic = 0").withColumn("held", held)
    bits = plain_model([r.text for r in docs.join(good.where("NOT held"), "doc_id", "left_semi").collect()])
    texts = {r.doc_id: r for r in docs.collect()}
    rows = op8_perplexity(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert abs(r.bits_per_byte - np.mean([bits(g) for g in grams(texts[r.doc_id].text)])) < 1e-5
    middle, above = {}, {}
    for lang in {r.lang for r in rows}:
        v = sorted(r.bits_per_byte for r in rows if r.lang == lang)
        middle[lang] = np.ceil(1000 * v[-(-len(v) // 2) - 1]) / 1000
    for r in rows:
        above[r.doc_id] = (r.bits_per_byte - middle[r.lang]) * r.n_bytes / (r.n_bytes + PRIOR_BYTES)
        assert abs(r.score - middle[r.lang] - above[r.doc_id]) < 1e-9
    ids = {r.doc_id for r in good.where("held").collect()}
    quantile = lambda v: np.ceil(1000 * sorted(v)[int(np.ceil(QUANTILE * len(v))) - 1]) / 1000
    common = quantile([above[i] for i in ids])
    for lang in middle:
        own = [above[i] for i in ids if texts[i].lang == lang]
        limit = (quantile(own) * len(own) + common * PRIOR_DOCUMENTS) / (len(own) + PRIOR_DOCUMENTS)
        for r in rows:
            if r.lang == lang:
                assert abs(r.threshold - middle[lang] - limit) < 1e-9
                assert r.kept == (r.score <= r.threshold + 1e-12)


def test_held_out_accuracy(spark):
    """On labels that training and thresholds never saw: junk, and good but toxic documents."""
    rows = {r.doc_id: r.kept for r in op8_perplexity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    junk = [not rows[x.doc_id] for x in labels if x.quality == 0]
    good = [rows[x.doc_id] for x in labels if x.quality == 1 and x.toxic == 0]
    print(np.mean(junk), np.mean(good), np.mean([rows[x.doc_id] for x in labels if x.quality == 1 and x.toxic == 1]))
    assert np.mean(junk) > 0.9 and np.mean(good) > 0.99


def test_the_model_grows_with_the_trusted_text(spark):
    rng = random.Random(1)
    text = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(4)]
    sizes = []
    for n in (1, 4):
        rows = spark.createDataFrame([(t,) for t in text[:n]], "text string").mapInArrow(op08_perplexity._counted, "gram long, n long")
        sizes.append(rows.select("gram").distinct().count())
    assert sizes[1] > 2 * sizes[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", 1, "p", 0.5), (2, "", None, 2, "q", 0.5), (2, "", None, 2, "q", 0.5), (None, "abc " * 50, "xx", 3, "r", 0.5), (4, "the cat sat " * 20000, "en", 4, "s", 0.5), (None, "%%#$ 0x" * 300, "en", 5, "t", 0.5)],
        "doc_id long, text string, lang string, shard int, doc string, score double",
    )
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (1, 1, 0), (9, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = classify(docs, labels).collect()
    assert len(rows) == 6 and all(r.perplexity > 0 for r in rows)
    kept = kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    none = labels.where("doc_id = 77")
    assert [r.kept for r in classify(docs, none).collect()] == [True] * 6
    assert classify(docs.where("doc_id = 77"), labels).count() == 0
    # repeated documents tie: all or none of them are kept
    same = docs.where("doc_id = 4").withColumn("doc_id", F.explode(F.sequence(F.lit(10).cast("long"), F.lit(29).cast("long"))))
    many = labels.unionByName(spark.range(10, 30).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert {r.kept for r in classify(same, many).collect()} == {True}
