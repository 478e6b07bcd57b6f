"""SimHash components against brute force over all pairs of documents; the index against all pairs of fingerprints; odd rows."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ohlspark.llm import op13_gray_simhash
from ohlspark.llm.op13_gray_simhash import block_pairs, close_pairs, fingerprint, gray_rank, near_duplicates, op13_gray_simhash as query

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = list(fps)
    x = np.array([fps[i] for i in ids], np.uint64)
    comp = np.arange(len(ids))
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    while True:
        low = np.array([comp[row].min() for row in close])
        if (low == comp).all():
            return {i: min(j for j, c in zip(ids, comp) if c == k) for i, k in zip(ids, comp)}
        comp = low


def near(rng, n, bits):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) & np.uint64((1 << bits) - 1)
    return np.unique(np.concatenate([base, base[: n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2, dtype=np.uint64))]))


def test_fingerprints_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in [None, "", " \n", "One", "one two", "ÉTÉ Été été\x0b\x0cx", *texts]:
        assert fingerprint(t) == brute_fingerprint(t)


def test_close_pairs_equal_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(120):
        a, b = near(rng, int(rng.integers(1, 200)), int(rng.choice([5, 9, 63]))), near(rng, 40, 9)
        for x, y in ((a, a), (a, b), (b, a)):
            want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= 2)) if x is not y or i < j}
            got = [p for i, j in close_pairs(x, y, 2, int(rng.choice([2, 3, 16])), int(rng.choice([300, 1 << 20]))) for p in zip(i.tolist(), j.tolist())]
            assert len(got) == len(set(got)) and set(got) == want


def test_gray_rank_orders_neighbours_one_bit_apart(spark):
    codes = [r.id for r in spark.range(256).orderBy(*gray_rank(F.col("id"))).collect()]
    assert sorted(codes) == list(range(256)) and all((a ^ b).bit_count() == 1 for a, b in zip(codes, codes[1:]))


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_components_through_several_levels_of_the_index(spark, monkeypatch, limit):
    monkeypatch.setattr(op13_gray_simhash, "broadcast_if", lambda df, size: F.broadcast(df) if size <= limit else df)
    rng = np.random.default_rng(9)
    fps = np.concatenate([near(rng, 300, 63), near(rng, 300, 14)])
    made = dict(enumerate([*fps.tolist(), *fps[:50].tolist(), 0]))  # some fingerprints of two documents
    rows = spark.createDataFrame([(k, int(np.uint64(v).astype(np.int64))) for k, v in made.items()], "doc_id long, fp long").withColumn("text", F.lit(""))
    monkeypatch.setattr(op13_gray_simhash, "fingerprints", lambda docs, size, seed: docs.select("doc_id", "fp"))
    join = op13_gray_simhash._joined
    monkeypatch.setattr(op13_gray_simhash, "_joined", lambda rows, named: join(rows, named, limit, 4))
    got = {r.doc_id: r.component_id for r in near_duplicates(rows, fan=4, block=16).collect()}
    assert got == brute_components(made)


@pytest.mark.parametrize("spread", [True, False])
def test_pruned_pairs_of_blocks_hold_no_link(spark, spread):
    rng = np.random.default_rng(2)
    x = near(rng, 600, 20) if spread else np.unique(rng.integers(0, 1 << 20, 900, dtype=np.uint64))
    rank = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    x = x[np.argsort(rank)]
    blocks = [x[k : k + 8] for k in range(0, len(x), 8)]
    shared = [(np.bitwise_and.reduce(b), np.bitwise_or.reduce(b)) for b in blocks]
    rows = [(k, int((a | ~o).astype(np.int64)), int(a.astype(np.int64))) for k, (a, o) in enumerate(shared)]
    kept = {(r.a, r.b) for r in block_pairs(spark.createDataFrame(rows, "block long, mask long, value long"), 2, 4).collect()}
    held = {(i, j) for i, a in enumerate(blocks) for j, b in enumerate(blocks) if i <= j and (np.bitwise_count(a[:, None] ^ b[None, :]) <= 2).any()}
    assert held <= kept and (spread or len(kept) < len(blocks) ** 2 / 4)


def test_query_equals_brute_force(spark):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {k: (f"{fps[k]:016x}", c) for k, c in brute_components(fps).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in query(spark, SF).collect()} == want


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (None, "a b c d"), (9, "A b  c\nd"), (9, "A b  c\nd"), (None, "quite another text that stands alone here"), (2, "x " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("block", F.lit(1))
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (None, 9), (9, 9), (9, 9), (None, None), (2, 2)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    one = near_duplicates(docs.where("doc_id = 2")).collect()
    assert [(r.doc_id, r.component_id) for r in one] == [(2, 2)]
