import random

import pytest
from pyspark.sql import functions as F

from ohlspark.llm.op01_decontaminate import WORD, decontaminated, find_leaks, lowered


def brute(text, items, size):
    words = WORD.findall(lowered(text or ""))
    hit, found = set(), set()
    for i, t in items:
        own = WORD.findall(lowered(t or ""))
        for k in range(max(1, len(own) - size + 1) if own else 0):
            w = own[k : k + size]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    found.add(i)
    return len(words), len(hit), sorted(found)


@pytest.fixture
def tables(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 9])))) for k in range(30)] + [(30, None), (31, ""), (32, "!!"), (33, "Solo"), (None, "w1 w2"), (5, "w1 w1 w1 w2")]
    texts = [(k, " ".join(rng.choices(words, k=rng.choice([1, 5, 60])))) for k in range(80)]
    texts += [(100, None), (101, ""), (101, ""), (102, "\u00c4 SOLO, solo; s\u00f6lo"), (None, "so lo"), (None, "so lo"), (103, "none here " * 30_000 + "solo")]
    docs = spark.createDataFrame([(i, t, 7, ["x"], [1], 3, {"a": "b"}) for i, t in texts], "doc_id long, text string, n_words int, word_ranges array<string>, item_ids array<int>, spans int, row map<string,string>")
    return docs, spark.createDataFrame(items, "item_id long, text string"), texts, [x for x in items if x[0] is not None]


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_leaks_equal_brute_force_in_one_block_and_in_several(spark, tables, block_bytes):
    docs, benchmark, texts, items = tables
    got = find_leaks(docs, benchmark, 3, block_bytes=block_bytes).collect()
    rows = sorted((str(r.doc_id), r.n_words, sum(x.end - x.start for x in r.word_ranges), r.item_ids) for r in got)
    assert rows == sorted((str(i), *brute(t, items, 3)) for i, t in texts)
    by_id = dict(texts)
    for r in got:
        for x, s in zip(r.word_ranges, r.spans, strict=True):
            assert len(WORD.findall(lowered(by_id[r.doc_id])[s.start : s.end])) == x.end - x.start
    kept = decontaminated(docs, benchmark, 3, block_bytes)
    assert kept.schema == docs.schema
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(i), t or "") for i, t in texts if not brute(t, items, 3)[1])
    assert all(r.row == {"a": "b"} and r.n_words == 7 for r in kept.collect())


def test_empty_tables(spark, tables):
    docs, benchmark, texts, _ = tables
    assert find_leaks(docs, benchmark.where("item_id < 0")).where(F.size("spans") > 0).count() == 0
    assert decontaminated(docs, benchmark.where("item_id < 0")).count() == len(texts)
    assert decontaminated(docs.where("doc_id < 0"), benchmark).count() == 0
