"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark
items scans each document once; hits are mapped back to offsets in the original text.

The items are gathered in blocks of at most `block_bytes` of text, so each automaton has a size
bound; documents pass through one scan per block (one in all for any usual benchmark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohlspark.llm.common import settled, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_automata: dict[str, ahocorasick.Automaton] = {}  # of this worker: the last one that was used, by its name


def lowered(text: str) -> str:
    return text.encode().lower().decode()  # bytes know A-Z only


def windows_of(text: str, size: int = WINDOW) -> list[list[str]]:
    words = WORD.findall(lowered(text))
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def automaton_of(items: list[tuple[int, str]], size: int = WINDOW) -> ahocorasick.Automaton:
    """From (item_id, text); its values are (words in the window, ids of the items that have it)."""
    found: dict[str, tuple[int, set[int]]] = {}
    for item_id, text in items:
        for w in windows_of(text, size):
            found.setdefault(f" {' '.join(w)} ", (len(w), set()))[1].add(item_id)
    out = ahocorasick.Automaton()
    for key, value in found.items():
        out.add_word(key, value)
    if found:
        out.make_automaton()
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged ranges of words that are hit, ids of the items that were found."""
    words = WORD.findall(lowered(text))
    ranges, items = [], set()
    if words and len(automaton):
        norm = f" {' '.join(words)} "
        at = ended = 0
        for end, (n, ids) in automaton.iter(norm):
            ended += norm.count(" ", at, end + 1)
            at = end + 1
            ranges.append((ended - 1 - n, ended - 1))
            items |= ids
    return len(words), merged(ranges), items


def _joined(ranges: list[tuple[int, int]], ids: set[int], old_ranges: list[dict], old_ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """The ranges and items of this block and of those before."""
    return merged([*ranges, *((x["start"], x["end"]) for x in old_ranges)]), ids | set(old_ids)


def _pass(docs: DataFrame, items: Broadcast, size: int, carry: list[str], again: bool) -> DataFrame:
    """Adds n_words, word_ranges and item_ids, or what this block of items adds to them."""
    more = {"n_words": T.LongType(), "word_ranges": SPANS, "item_ids": T.ArrayType(T.LongType()), "spans": SPANS}
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(k, t) for k, t in more.items())])
    name = uuid4().hex
    docs = docs.select(*dict.fromkeys([*carry, "text", *(["word_ranges", "item_ids"] if again else [])]))

    kinds = pa.schema([("n_words", pa.int64()), ("word_ranges", _RANGES), ("item_ids", pa.list_(pa.int64())), ("spans", _RANGES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _automata:
            _automata.clear()
            _automata[name] = automaton_of(items.value, size)
        for b in batches:
            rows = {k: [] for k in kinds.names}
            before = zip(b["word_ranges"].to_pylist(), b["item_ids"].to_pylist(), strict=True) if again else None
            for text in b["text"].to_pylist():
                text = text or ""
                n, ranges, ids = scan(text, _automata[name])
                if before:
                    ranges, ids = _joined(ranges, ids, *next(before))
                spans = []
                if ranges:
                    at = [m.span() for m in WORD.finditer(lowered(text))]
                    spans = [{"start": at[a][0], "end": at[z - 1][1]} for a, z in ranges]
                for k, v in zip(kinds.names, (n, [{"start": a, "end": z} for a, z in ranges], sorted(ids), spans), strict=True):
                    rows[k].append(v)
            found = [pa.array(rows[f.name], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in carry), *found], names=[*carry, *kinds.names])

    return docs.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: list[str] | None = None, block_bytes: int = 32 << 20) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> the `keep` columns of docs (doc_id) and n_words,
    word_ranges, item_ids (sorted, each once) and spans: the hit passages as offsets (code points) in text.

    A document word is hit if it lies in any occurrence of a window of `size` consecutive item
    words; an item of fewer words is one window. Null texts have no words; items without words or
    without an id are left out; no items, no hits. Repeated rows each get their result. Other columns are
    dropped; `keep` names none that the result adds.
    """
    carry = keep or ["doc_id"]
    docs = docs.select(*dict.fromkeys([*carry, "text"]))
    items = benchmark.select("item_id", "text").dropna()
    sizes = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-sizes // block_bytes))
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])  # a block is bounded
        last = k == blocks - 1
        out = _pass(out, block, size, carry if last else list(dict.fromkeys([*carry, "text"])), k > 0)
        if not last:
            out = settled(out)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = 32 << 20) -> DataFrame:
    """The documents without a hit, with the columns they came with, whatever their names."""
    found = find_leaks(docs.select(F.struct("*").alias("row"), "text"), benchmark, size, keep=["row"], block_bytes=block_bytes)
    return found.where(F.size("word_ranges") == 0).select("row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("word_ranges", F.lit(0), lambda a, r: a + r["end"] - r["start"]).cast("long")
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


EMPTY_SHA = sha256(b"").hexdigest()

SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
i AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p : p + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
x AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))),
m AS (SELECT x.rid, x.p, x.n, i.item_id FROM x JOIN i ON x.n = i.n AND x.win = i.win),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM m) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, '{EMPTY_SHA}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
