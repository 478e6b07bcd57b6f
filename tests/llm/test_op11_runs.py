"""Periodic runs against brute force over every period, and on odd rows. The registered query is held against SQL in test_sql_ops.py."""

import random
import re
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from ohlspark.llm.op11_runs import factorised, op11_periodic_runs, periodic_runs, runs_of, runs_of_words, stretches

SF = "/root/testdata/sf0.001"


def brute(words, least):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out[i, j + q] = min(q, out.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_of_small_alphabets_equal_brute_force():
    rnd = random.Random(7)
    for _ in range(3000):
        x = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5])) for _ in range(rnd.randint(0, 50))]
        if rnd.random() < 0.4 and len(x) > 5:
            p = rnd.randint(1, len(x) // 2)
            for j in range(rnd.randrange(len(x)) + p, len(x)):
                x[j] = x[j - p]
        if rnd.random() < 0.3:
            x = x + x[: rnd.randint(0, len(x))] + x
        for least in (2, 12):
            want = brute(x, least)
            assert sorted((s, e - s, q) for s, e, q in runs_of(x, least)) == want
            assert sorted(runs_of_words([str(v).encode() for v in x], least)) == want


def test_factors_are_the_longest_that_occur_earlier():
    rnd = random.Random(3)
    for _ in range(300):
        x = [rnd.randrange(3) for _ in range(rnd.randint(0, 40))]
        occurs = lambda b, e: any(x[s : s + e - b] == x[b:e] for s in range(b))  # noqa: B023, E731
        assert [k for b, e, _ in factorised(x) for k in range(b, e)] == list(range(len(x)))
        for b, e, source in factorised(x):
            assert (source < 0 and e == b + 1 and x[b] not in x[:b]) or (source < b and x[source : source + e - b] == x[b:e])
            assert e == len(x) or source < 0 or not occurs(b, e + 1)


def test_stretches_cover_windows_that_occur_twice():
    import numpy as np

    x = np.array([1, 2, 3, 9, 8, 1, 2, 3, 7, 5, 5, 5, 5])
    assert stretches(x, 3) == [(0, 3), (5, 8), (9, 13)]
    assert stretches(x[:2], 3) == [] and stretches(x[:4], 3) == []


def test_query_equals_brute_force_on_every_document(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = sorted(brute(words, 12), key=lambda x: (x[0], x[2]))
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        want[r.doc_id] = (len(runs), *best, milli, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, SF).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 10


def test_odd_rows(spark):
    line = "do not sell my data "
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, line * 4, "x"), (5, line * 4, "x"), (5, line * 4, "x"), (6, "é" * 50_000, "x"), (7, "a b " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1))
    got = periodic_runs(docs).orderBy("doc_id", F.size("runs")).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed[:40]) for r in got] == [
        (None, 20, [(0, 20, 5)], "do not sell my data"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (5, 20, [(0, 20, 5)], "do not sell my data"), (5, 20, [(0, 20, 5)], "do not sell my data"),
        (6, 1, [], "é" * 40), (7, 40_000, [(0, 40_000, 1)], "a b"),
    ]
    assert periodic_runs(docs.limit(0)).count() == 0
