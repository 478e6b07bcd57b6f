"""Periodic runs: stretches of a text whose words repeat with a period, found as Kolpakov and Kucherov do.

A text is factorised as Lempel and Ziv do: each factor is the longest stretch that also begins earlier, read off the suffix
automaton of the words, whose states know where their strings end first. A run either meets a factor's border, and then Main's
algorithm finds it from common prefixes and suffixes on both sides of the border, which reach no further back than the factor
before and both factors' lengths; or it lies within a factor, and then it is a copy of a run of the factor's earlier occurrence.

A run of a length of at least `least` and two periods has least / 2 words that its next period repeats, so it is covered by windows of
so many words that occur twice. Only the stretches that such windows cover are factorised; no run reaches past one.
Time and memory grow with the words of a text, about half a kilobyte a word of what is factorised.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlspark.llm.common import table

#: Words of the shortest run.
LEAST = 12

_C = np.uint64(0x9E3779B97F4A7C15)


def suffix_automaton(ids: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The moves of each state, and where the strings of a state end first."""
    moves: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for at, c in enumerate(ids):
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        first.append(at)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link.append(q)
            else:
                twin = new + 1
                link.append(twin)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves, first


def factorised(ids: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, source) of each factor: the longest stretch from begin on that also starts at source < begin, or one new word with source -1."""
    moves, first = suffix_automaton(ids)
    out, n, begin = [], len(ids), 0
    while begin < n:
        state, end = 0, begin
        while end < n:
            state_next = moves[state][ids[end]]
            if first[state_next] >= end:
                break
            state, end = state_next, end + 1
        if end == begin:
            out.append((begin, begin + 1, -1))
            begin += 1
        else:
            out.append((begin, end, first[state] - (end - begin) + 1))
            begin = end
    return out


def common_prefixes(x: list[int]) -> list[int]:
    """For each position the length of the longest common prefix of x and of what starts there (Z function)."""
    n = len(x)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(ids: list[int], lo: int, at: int, hi: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: (start, end, period) of the runs within lo..hi that hold or touch the border before `at`, with the
    period repeated on its right or on its left. Those that go on past lo or hi are left out."""
    t, u = ids[lo:at], ids[at:hi]
    back, nt, nu = t[::-1], len(t), len(u)
    ends = common_prefixes([*back, -1, *u[::-1], *back])
    starts = common_prefixes([*u, -1, *t, *u])
    found = [(at - ends[nt + 1 + nu - q], at + q + (starts[q] if q < nu else 0), q) for q in range(1, nu + 1)]
    found += [(at - q - (ends[q] if q < nt else 0), at + starts[nu + 1 + nt - q], q) for q in range(1, nt + 1)]
    n = len(ids)
    for s, e, q in found:
        if e - s >= least and e - s >= 2 * q and not (s > 0 and ids[s - 1] == ids[s - 1 + q]) and not (e < n and ids[e] == ids[e - q]):
            yield s, e, q


def runs_of(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of at least `least` words and two periods, with its smallest period, in order."""
    factors = factorised(ids)
    at: dict[int, dict[int, int]] = defaultdict(dict)  # start -> end -> period
    n, before = len(ids), 0
    for begin, end, source in [*factors, (n, n, -1)]:
        size = end - begin
        if 2 * (before + size) > least:
            for s, e, q in crossing(ids, max(0, begin - 2 * before - size), begin, end, least):
                at[s][e] = min(q, at[s].get(e, q))
        if source >= 0 and size > least and at:
            shift = begin - source
            for s in range(begin + 1, end):
                for e, q in at.get(s - shift, {}).items():
                    if e + shift < end:
                        at[s][e + shift] = q
        before = size
    return [(s, e, q) for s in sorted(at) for e, q in sorted(at[s].items(), key=lambda x: x[1])]


def stretches(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Where windows of `size` words that occur twice cover the text: [begin, end) without gaps. Windows are told apart by hashes; two that
    share one only widen a stretch."""
    n = len(ids) - size + 1
    if n < 2:
        return []
    x = (ids.astype(np.uint64) + np.uint64(1)) * _C
    x = (x ^ (x >> np.uint64(29))) * _C
    h = x[:n].copy()
    for k in range(1, size):
        h = h * _C + x[k : n + k]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    edges = np.zeros(len(ids) + 1, np.int64)
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(edges, again, 1)
    np.add.at(edges, again + size, -1)
    inside = np.concatenate([[0], np.cumsum(edges)[:-1] > 0, [0]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(inside))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def runs_of_words(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start and then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    out = []
    for begin, end in stretches(ids, -(-least // 2)):
        if end - begin >= least:
            out += [(begin + s, e - s, q) for s, e, q in runs_of(ids[begin:end].tolist(), least)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those of a run after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for s, size, q in runs:
        edges[s + q] += 1
        edges[s + size] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0)])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed (the text's
    words without those that repeat a period, joined by single spaces).

    Words are parted by spaces, tabs and line ends. A null or empty text has no words, no runs and an empty collapsed text;
    a null doc_id stays null; repeated rows each give their row; other columns, whatever their names, are left out; an empty table gives no rows. Each text is
    worked on by itself, in the task that reads it: nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, texts = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                found = runs_of_words(words, least)
                n_words.append(len(words))
                runs.append([{"start": s, "length": size, "period": q} for s, size, q in found])
                texts.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; every tenth document, by the CRC-32 of its id, with its words from a place on told again with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)

    def told(words: Column, n: Column) -> Column:
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the struct in an array keeps the words from being split again for every use
    planted = F.get(F.transform(F.array(F.struct(words.alias("w"), n.alias("n"))), lambda x: F.when(x["n"] > 0, told(x["w"], x["n"])).otherwise("")), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id::VARCHAR AS s FROM documents),
c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) AS h, len(w) AS n FROM d),
p AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < (h // 10) % n THEN i
    ELSE (h // 10) % n + (i - (h // 10) % n) % (1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM c),
g AS (SELECT rid, i, n, array_to_string(w[i + 1 : i + 6], ' ') AS gram FROM (SELECT rid, n, w, unnest(range(0, n - 5)) AS i FROM p WHERE n >= 12)),
e AS (SELECT x.rid, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island FROM g x JOIN g y ON x.rid = y.rid AND x.gram = y.gram AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
r0 AS (SELECT rid, q, min(i) AS s, max(i) - min(i) + 6 + q AS len FROM e GROUP BY rid, q, island),
r AS (SELECT rid, s, len, min(q) AS q FROM r0 WHERE len >= greatest(12, 2 * q) GROUP BY rid, s, len),
b AS (
  SELECT rid, count(*) AS n_runs, arg_max({'s': s, 'l': len, 'q': q}, (len, -s, -q)) AS x, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY rid),
f AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM r),
t AS (SELECT rid, unnest(w) AS word, unnest(range(0, n)) AS i FROM p),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT * FROM t ANTI JOIN f USING (rid, i)) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, x.s::BIGINT AS start, x.l::BIGINT AS length, x.q::BIGINT AS period, (1000 * x.l // x.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""
