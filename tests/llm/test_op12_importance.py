"""Importance resampling against brute force, and on odd rows. The registered query is held against SQL in test_sql_ops.py."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from ohlspark.llm import op12_importance
from ohlspark.llm.op12_importance import resample


def brute(docs, target, percent, least, longest, buckets):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(b for _, x in docs for b in grams(words(x))), Counter(b for x in target for b in grams(words(x)))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in docs:
        w = words(x)
        g = grams(w)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["Alpha", "beta", "ÉTÉ", "x9", "the", "of", "Über", "q"])
    texts = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(60)] + [None, "", "...", "one-two;three"]
    docs = [(k, rnd.choice(texts)) for k in range(400)] + [(k, texts[3]) for k in range(400, 600)] + [(None, texts[4]), (None, None), (7, texts[5]), (7, texts[5]), (7, texts[5])]
    return docs, [texts[1], texts[2] * 3, None, ""]


def ran(spark, docs, target, **p):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("copies", F.lit(2)).repartition(5)
    return sorted((tuple(r) for r in resample(table, spark.createDataFrame([(x,) for x in target], "text string"), **p).collect()), key=str)


def test_equals_brute_force(spark):
    docs, target = corpus()
    assert ran(spark, docs, target) == brute(docs, target, 10, 20, 1, 10_000)
    assert ran(spark, docs, target, percent=50, least_words=2, longest=3, buckets=37) == brute(docs, target, 50, 2, 3, 37)


def test_weights_shuffled_where_they_are_not_small(spark, monkeypatch):
    docs, target = corpus()
    join = op12_importance._joined
    monkeypatch.setattr(op12_importance, "_joined", lambda rows, weights: join(rows, weights, 0, 5))
    assert ran(spark, docs, target) == brute(docs, target, 10, 20, 1, 10_000)


def test_empty_tables(spark):
    docs, target = corpus()
    assert ran(spark, [], target) == []
    assert ran(spark, docs[:50], []) == brute(docs[:50], [], 10, 20, 1, 10_000)


def test_the_draw_is_nearer_to_the_target(spark):
    rnd = random.Random(2)
    near, far = ["red", "green", "blue"], [f"w{k}" for k in range(50)]
    docs = [(k, " ".join(rnd.choice(near if k % 5 == 0 else far) for _ in range(30))) for k in range(500)]
    target = [" ".join(rnd.choice(near) for _ in range(200))]
    drawn = [r[0] for r in ran(spark, docs, target) if r[4]]
    assert len(drawn) == 50 and all(k % 5 == 0 for k in drawn)
