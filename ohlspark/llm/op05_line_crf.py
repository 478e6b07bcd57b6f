"""Quality rules and line labels: a linear-chain conditional random field over a document's lines.

Viterbi decoding marks each line as content or boilerplate; a document whose content share, by
code points of its lines, is below a half is not kept. The field is trained by gradient ascent on
a bounded sample of labelled documents (SAMPLE). Labels are by document, so lines that change from one kind
to the other are made: besides the documents themselves, whose lines all have the document's label, the field
learns from spliced texts, where some lines of a document of the other kind stand within a document's lines. The
rule counts (words, symbols, repeated lines and words) come from the same pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohlspark.llm.common import settled, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: At most so many labelled documents train the field, of those with at most so many characters and lines.
SAMPLE, SAMPLE_LINES, SAMPLE_CHARS = 3000, 400, 100_000
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
CONTENT_SHARE = 0.5
FEATURES = ["bias", "few words", "words", "word length", "upper", "digits", "symbols", "marks", "repeated neighbours", "repeated windows", "repeated line", "ends a sentence", "starts upper", "first", "last"]


class Parsed:
    """What one pass over a text gives: the rule counts and the features of its lines with a word."""

    def __init__(self, text: str):
        lines = text.split("\n")
        words_of = [WORD.findall(x) for x in lines]
        words = [w for ws in words_of for w in ws]
        full = [k for k, ws in enumerate(words_of) if ws]
        self.n_words = len(words)
        self.word_chars = sum(map(len, words))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        seen: set[str] = set()
        again = []
        for k in full:
            again.append(lines[k] in seen)
            seen.add(lines[k])
        self.n_dup_lines = sum(again)
        at: dict[str, int] = {}
        ids = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, len(words))
        inside = self._in_repeated(ids, len(at))
        self.n_repeat_words = int(inside.sum())
        self.sizes = np.array([len(lines[k]) for k in full], float)
        self.features = self._features([lines[k] for k in full], np.array([len(words_of[k]) for k in full], np.int64), ids, inside, np.array(again, float))

    @staticmethod
    def _in_repeated(ids: np.ndarray, distinct: int) -> np.ndarray:
        """Words that lie in a window of three that is found twice or more."""
        inside = np.zeros(len(ids), bool)
        if len(ids) > 3:
            pair = ids[:-1] * distinct + ids[1:]
            if distinct > 1 << 20:
                pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            _, code, n = np.unique(pair[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
            hit = n[code] > 1
            for k in range(3):
                inside[k : k + len(hit)] |= hit
        return inside

    @staticmethod
    def _features(lines: list[str], n: np.ndarray, ids: np.ndarray, inside: np.ndarray, again: np.ndarray) -> np.ndarray:
        if not lines:
            return np.zeros((0, len(FEATURES)))
        cp = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = CLASSES[np.minimum(cp, len(CLASSES) - 1)]
        size = np.array([len(x) for x in lines])
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        share = [np.add.reduceat((kind == k).astype(np.int64), start) / size for k in (1, 2, 3, 4)]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        same = np.zeros(len(ids), np.int64)
        same[1:] = ids[1:] == ids[:-1]
        per_line = lambda x: np.add.reduceat(x.astype(np.int64), first) / n
        out = np.stack([
            np.ones(len(lines)), n <= 3, np.log1p(n) / 4, np.minimum(size / n, 20) / 10, *share, per_line(same), per_line(inside), again,
            [x.rstrip()[-1:] in ".!?…:" for x in lines], [x.lstrip()[:1].isupper() for x in lines], np.zeros(len(lines)), np.zeros(len(lines)),
        ], 1).astype(float)
        out[0, -2] = out[-1, -1] = 1
        return out

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: By code point: 1 upper case, 2 digit, 3 symbol, 4 other mark, 0 else.
CLASSES = np.array([1 if (c := chr(k)).isupper() else 2 if c.isdigit() else 3 if c in SYMBOLS else 4 if not c.isalnum() and not c.isspace() else 0 for k in range(1 << 11)] + [0], np.int8)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best labels, 1 for content, of scores (lines, 2) and moves (2, 2); ties go to content."""
    if not len(scores):
        return []
    (m00, m01), (m10, m11) = moves.tolist()
    back, (a, b) = [], scores[0].tolist()
    for s0, s1 in scores[1:].tolist():
        x0, x1, y0, y1 = a + m00, b + m10, a + m01, b + m11
        back.append((x1 >= x0, y1 >= y0))
        a, b = max(x0, x1) + s0, max(y0, y1) + s1
    out = [int(b >= a)]
    for to in reversed(back):
        out.append(int(to[out[-1]]))
    return out[::-1]


def train(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(features of the lines, a label for each line) -> weights (features, 2) and moves (2, 2) that maximise the
    penalised likelihood; by forward and backward sums over all sequences at once."""
    k = len(FEATURES)
    weights, moves = np.zeros((k, 2)), np.zeros((2, 2))
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
    if len({int(y) for _, ys in sequences for y in ys}) < 2:
        weights[0, 1] = 1.0  # nothing to tell apart: all is content
        return weights, moves
    n, length = len(sequences), len(sequences[0][0])
    x, there, y = np.zeros((length, n, k)), np.zeros((length, n), bool), np.zeros((length, n), np.int64)
    steps = np.zeros((2, 2))
    for j, (f, ys) in enumerate(sequences):
        x[: len(f), j], there[: len(f), j], y[: len(f), j] = f, True, ys
        np.add.at(steps, (ys[:-1], ys[1:]), 1)
    alive = there.sum(1)  # sequences stand longest first
    flat, gold = x[there], np.eye(2)[y[there]]
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
    for t in range(1, STEPS + 1):
        s = x @ weights
        f, b = s.copy(), np.zeros_like(s)
        for i in range(1, length):
            a = alive[i]
            f[i, :a] += lse(f[i - 1, :a, :, None] + moves, 1)
        for i in range(length - 2, -1, -1):
            a = alive[i + 1]
            b[i, :a] = lse(moves + (s[i + 1, :a] + b[i + 1, :a])[:, None, :], 2)
        z = lse(f[0] + b[0], 1)
        p = np.exp(f + b - z[:, None])[there]
        both = np.exp(f[:-1, :, :, None] + moves + (s[1:] + b[1:])[:, :, None, :] - z[:, None, None])[there[1:]].sum(0)
        grads = (flat.T @ (gold - p) / len(flat) - PENALTY * weights, (steps - both) / len(flat) - PENALTY * moves)
        for g, value, at in zip(grads, (weights, moves), (0, 2), strict=True):
            state[at] = 0.9 * state[at] + 0.1 * g
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * g * g
            value += RATE * (state[at] / (1 - 0.9**t)) / (np.sqrt(state[at + 1] / (1 - 0.99**t)) + 1e-8)
    return weights, moves


def spliced(text: str, other: str, seed: int) -> tuple[str, list[int]]:
    """Some lines of `other` within those of `text`, where the seed says; 1 for each line of the latter, 0 of the former. Lines
    without words are left out."""
    mine, theirs = ([x for x in t.split("\n") if WORD.search(x)] for t in (text, other))
    at, first = seed % (len(mine) + 1), seed // 7 % max(len(theirs), 1)
    some = theirs[first : first + 1 + seed // 11 % 12]
    return "\n".join([*mine[:at], *some, *mine[at:]]), [*[1] * at, *[0] * len(some), *[1] * (len(mine) - at)]


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The field trained on the `sample` labelled documents whose ids hash least, and on as many spliced texts; ids with
    labels of both kinds are left out, and of rows that share an id the one of the least text counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    some = known.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("y") > 0).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    texts = settled(texts.groupBy("doc_id", "good").agg(F.min("text").alias("text")))  # at most `sample` rows
    nth = F.row_number().over(Window.partitionBy("good").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1
    placed = settled(texts.withColumn("nth", nth))
    n = dict(placed.groupBy("good").count().collect())
    pairs = placed.select("doc_id", "good", "text", "nth", F.lit(None).cast("string").alias("other"))
    if len(n) == 2:  # each text also with one of the other kind
        others = placed.select((~F.col("good")).alias("good"), F.col("nth").alias("place"), F.col("text").alias("other"))
        place = F.pmod(F.col("nth"), F.when(F.col("good"), n[False]).otherwise(n[True]))
        mixed = placed.withColumn("place", place).join(others, ["good", "place"])
        pairs = pairs.unionByName(mixed.select(*pairs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, y = [], []
            for doc_id, good, text, other in zip(*(b[c].to_pylist() for c in ("doc_id", "good", "text", "other")), strict=True):
                marks = None
                if other is not None:
                    text, marks = spliced(text, other, zlib.crc32(str(doc_id).encode()))
                x = Parsed(text).features
                f.append(x.astype("<f4").tobytes())
                marks = [1] * len(x) if marks is None else marks
                y.append(bytes(marks if good else [1 - v for v in marks]))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "f": pa.array(f, pa.binary()), "y": pa.array(y, pa.binary())})

    rows = pairs.mapInArrow(run, "doc_id long, f binary, y binary").collect()  # at most twice `sample` rows
    rows.sort(key=lambda r: (r.doc_id, r.f))
    return train([(np.frombuffer(r.f, "<f4").reshape(-1, len(FEATURES)).astype(float), np.frombuffer(r.y, np.uint8).astype(np.int64)) for r in rows if len(r.y) <= SAMPLE_LINES])


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], share: float = CONTENT_SHARE) -> DataFrame:
    """docs(doc_id, text) -> a row for each: doc_id, the rule counts, base_failed, content_share, kept.

    A document fails the base rules with fewer than 50 words or with more than half of its words in
    repeated windows; else it is kept if its content share is `share` or more. A null or empty text
    has no words, fails, and has a content share of 0. Repeated rows and null ids stay; columns
    other than doc_id and text are ignored.
    """
    weights, moves = field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                p = Parsed(text or "")
                marks = np.array(viterbi(p.features @ weights, moves), float)
                good = float((p.sizes * marks).sum() / p.sizes.sum()) if len(marks) else 0.0
                rows.append((p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, p.base_failed, good, not p.base_failed and good >= share))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fitted(docs, table(spark, sf_dir, "labels")))
