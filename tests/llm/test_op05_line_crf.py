import re
from collections import Counter

import numpy as np

from ohlspark.llm.op05_line_crf import WORD, Parsed, fitted, judge, op5_line_crf, spliced, train, viterbi

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_counts_equal_brute_force_and_kept_follows(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op5_line_crf(spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        s, m = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(s[i, y[i]] for i in range(n)) + sum(m[y[i], y[i + 1]] for i in range(n - 1))  # noqa: E731, B023
        assert abs(value(viterbi(s, m)) - max(value([k >> i & 1 for i in range(n)]) for k in range(1 << n))) < 1e-9


def test_held_out_accuracy(spark):
    """On documents that training never saw, whole and with lines of the other kind spliced in."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    weights, moves = field = fitted(docs, labels.where("doc_id % 2 = 0"))
    rows = {r.doc_id: r for r in judge(docs, field).collect()}
    judged = [(rows[x.doc_id], x.quality) for x in labels.where("doc_id % 2 = 1").collect()]
    good = [r.content_share >= 0.5 for r, q in judged if q == 1]
    junk = [not r.kept for r, q in judged if q == 0]
    assert np.mean(good) > 0.99 and np.mean(junk) > 0.8
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").orderBy("doc_id").select("text", "quality").collect()
    prose, other = ([x for r in held if r.quality == q for x in r.text.split("\n") if WORD.search(x)] for q in (1, 0))
    right = whole = mixed = 0
    for k in range(150):
        parts = [(prose[k * 20 : k * 20 + 10], 1), (other[k * 10 : k * 10 + 10], 0), (prose[k * 20 + 10 : k * 20 + 20], 1)]
        text, want = "\n".join(x for part, _ in parts for x in part), [y for part, y in parts for _ in part]
        got = viterbi(Parsed(text).features @ weights, moves)
        right, whole, mixed = right + sum(a == b for a, b in zip(got, want, strict=True)), whole + len(want), mixed + (0 < sum(got) < len(got))
    print(np.mean(good), np.mean(junk), right / whole, mixed, moves)
    assert right / whole >= 0.9 and mixed >= 110  # some junk is prose told again and again, and its lines alone are prose


def test_spliced_lines_keep_their_labels():
    text, marks = spliced("a a\n\nb b\nc c", "x x\ny y", 30)
    assert [m for m, line in zip(marks, text.split("\n"), strict=True) if line[0] in "xy"] == [0] * marks.count(0) and marks.count(1) == 3 and marks.count(0) > 0


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "\n \n"), (3, "a b c " * 40000), (4, "x\x1cy\x85z w " * 3), (5, "\n".join(f"Word{i} is number {i}, said the clerk." for i in range(30)))]
    df = spark.createDataFrame([(i, t, True, 1) for i, t in rows], "doc_id long, text string, kept boolean, n_words int")
    got = judge(df, train([])).collect()
    assert len(got) == len(rows)
    assert sorted((tuple(r)[1:7] for r in got if r.doc_id != 3)) == sorted(brute(t) for i, t in rows if i != 3)
    assert [r.n_repeat_words for r in got if r.doc_id == 3] == [120000]
    assert {r.doc_id for r in got if r.kept} == {5}
    assert judge(df.where("doc_id = 77"), train([])).count() == 0
    assert Parsed("a b c").n_repeat_words == 0
