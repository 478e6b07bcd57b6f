import math
import random
from collections import Counter

import numpy as np
import pytest

from ohlspark.llm import op03_bagminhash
from ohlspark.llm.op01_decontaminate import WORD, lowered
from ohlspark.llm.op03_bagminhash import bag_of, deduplicated, near_duplicates, op3_bagminhash, overlap, signatures

SF = "/root/testdata/sf0.01"


def brute_bag(text):
    w = WORD.findall(lowered(text))
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute_classes(rows):
    """(doc_id, text) -> doc_id: least id of its class."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [(i, t, brute_bag(t)) for i, t in rows if t is not None]
    by_shingle, pairs = {}, set()
    for k, (_, _, b) in enumerate(bags):
        for s in b:
            pairs.update((j, k) for j in by_shingle.get(s, ()))
            by_shingle.setdefault(s, []).append(k)
    first = {}
    for k, (_, t, _) in enumerate(bags):
        pairs.add((first.setdefault(t, k), k))
    for j, k in pairs:
        (i, t, a), (u, v, b) = bags[j], bags[k]
        both, either = sum((a & b).values()), sum((a | b).values())
        if t == v or (either and 5 * both >= 4 * either):
            x, y = sorted((find(i), find(u)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def test_agreement_of_signatures_is_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64))
    a, b = rng.integers(1, 30, 40), rng.integers(1, 30, 40)
    one, two = (keys[:35], a[:35]), (keys[5:], b[5:])
    both, either = overlap(one, two)
    s = signatures([one, two, (keys[:0], a[:0])], 6000)
    assert abs((s[0] == s[1]).mean() - both / either) < 0.025
    assert np.isinf(s[2]).all()
    assert (signatures([two], 6000)[0] == s[1]).all()


def test_classes_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in op3_bagminhash(spark, SF).collect()} == brute_classes(rows)


def test_chains_of_near_copies_and_odd_rows(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, None), (1, ""), (2, ""), (3, "one two"), (4, "One, two!"), (5, "one two three"), (6, None), (7, "!!!"), (8, "a b c d e " * 9000)]
    for k in range(60):
        base = list(base)
        base[rng.randrange(300)] = f"x{k}"
        rows.append((100 + k, " ".join(base)))
    df = spark.createDataFrame([(i, t, "z", 1, "n") for i, t in rows], "doc_id long, text string, node string, n int, comp string")
    got = {}
    for r in near_duplicates(df).collect():
        got.setdefault(r.comp and bytes(r.comp), []).append(r.doc_id)
    want = {}
    for i, c in brute_classes(rows).items():
        want.setdefault(c, []).append(i)
    nulls = got.pop(None)
    assert sorted(nulls) == [0, 6]
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for k, v in want.items() if k not in (0, 6))
    kept = deduplicated(df.unionByName(df)).collect()
    assert sorted(r.doc_id for r in kept) == sorted([0, 0, 6, 6, *(k for k in want if k not in (0, 6))])
    assert deduplicated(df.where("doc_id < 0")).columns == df.columns and deduplicated(df.where("doc_id < 0")).count() == 0
    some = deduplicated(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a, b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in some] == [(1, "a, b")]


def test_form_letters_whose_families_meet_only_in_large_buckets(spark, monkeypatch):
    """Letters of one form: four fields are a letter's own, one is its family's. Within a family of three the
    similarity is 176 / 216, across families 171 / 221, so every band's bucket is large and holds many groups."""
    monkeypatch.setattr(op03_bagminhash, "BLOCK", 40)  # several blocks a bucket
    form = [f"w{k}" for k in range(200)]
    rows = []
    for family in range(150):
        for letter in range(3):
            words = list(form)
            for field in (20, 60, 100, 140):
                words[field] = f"x{field}y{family}z{letter}"
            words[180] = f"f{family}"
            rows.append((3 * family + letter, " ".join(words)))
    want = {i: i - i % 3 for i, _ in rows}
    assert brute_classes(rows[:60]) == {i: want[i] for i in range(60)}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in found:
        groups.setdefault(bytes(r.comp), []).append(r.doc_id)
    assert {i: min(g) for g in groups.values() for i in g} == want


def families(number, members, fields, seed):
    """Letters of 400 words of one form; a family has 8 words of its own, a letter `fields` more."""
    rng = random.Random(seed)
    form, rows = [f"w{k}" for k in range(400)], []
    for family in range(number):
        base = list(form)
        for at in rng.sample(range(400), 8):
            base[at] = f"f{family}a{at}"
        for letter in range(members):
            words = list(base)
            for at in rng.sample(range(400), fields):
                words[at] = f"x{family}y{letter}z{at}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize(("number", "members", "fields"), [(600, 2, 4), (300, 3, 3)])
def test_families_of_one_form_equal_brute_force(spark, number, members, fields):
    """All texts share most buckets, and only links tell the families apart; no link may be lost."""
    rows = families(number, members, fields, 11)
    want = brute_classes_of_sets(rows)
    got = {}
    for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(bytes(r.comp), []).append(r.doc_id)
    assert {i: min(g) for g in got.values() for i in g} == want
    assert 1 < len(got) < len(rows)


def brute_classes_of_sets(rows):
    """As brute_classes, for texts none of whose shingles repeats: all pairs at once by a product of 0/1 rows."""
    bags = [brute_bag(t) for _, t in rows]
    assert all(max(b.values()) == 1 for b in bags)
    at = {s: k for k, s in enumerate({s for b in bags for s in b})}
    x = np.zeros((len(bags), len(at)), np.float32)
    for i, b in enumerate(bags):
        x[i, [at[s] for s in b]] = 1
    both, n = x @ x.T, x.sum(1)
    link = 5 * both >= 4 * (n[:, None] + n[None, :] - both)
    label = np.arange(len(bags))
    while True:
        new = np.where(link, label[None, :], len(bags)).min(1)
        if (new == label).all():
            return {rows[i][0]: rows[k][0] for i, k in enumerate(label.tolist())}
        label = new


def test_the_agreement_filter_misses_no_more_than_the_bands():
    m, s = op03_bagminhash.M, 0.8
    filtered = sum(math.comb(m, k) * s**k * (1 - s) ** (m - k) for k in range(op03_bagminhash.LEAST_AGREE))
    assert filtered <= (1 - s**op03_bagminhash.ROWS) ** op03_bagminhash.BANDS
