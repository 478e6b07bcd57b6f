"""Packing by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A piece goes into the open window that it
fills best; when none has room, the fullest is emitted and a new one opened. Windows still open
at the end of the partitions are merged across partitions, as wholes, by best fit.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohlspark.llm.common import settled, table

LENGTH, OPEN, END_ID = 2048, 64, 1
#: A piece is cut to fill the window that is emitted if its gap has this many tokens or more.
FILL = 128
CACHE, AT_ONCE = 200_000, 1_000_000  # words a worker keeps; characters tokenized together

KINDS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset")), ("open", pa.bool_())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Text whose runs of Latin letters can be encoded apart: no apostrophe (the tokenizer cuts 's and
#: the like) and no letter but these. Lower-casing is all that the normaliser changes in it.
APART = re.compile(r"[\x00-&(-\xa9\xab-\xb4\xb6-\xb9\xbb-\xff]*")
LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
RUNS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[^a-z\xdf-\xf6\xf8-\xff \n]+")


def parts_of(text: str) -> list[str]:
    """Parts that the tokenizer encodes alike alone and in the text."""
    if APART.fullmatch(text) and "<|" not in text:
        return RUNS.findall(text.lower())
    return [x for p in text.replace("\n", " ").split(" ") for x in (RUNS.findall(p.lower()) if APART.fullmatch(p) and "<|" not in p else (p,))]


class Encoder:
    """Texts to token ids as little-endian unsigned 32-bit integers, the end id last.

    Distinct parts (parts_of) are encoded once and kept; the store is emptied when it is full.
    For words of small Latin letters the tokenizer's normaliser and pattern change nothing, so
    they go to a copy without those.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.bare, self.known = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {i: spelt.pre_tokenize_str(chr(i))[0][0] for i in range(0xDF, 0x100)}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for k, i in vocabulary.items() if k.endswith("</w>")]] = True

    def _whole(self, parts: list[str]) -> Iterator[bytes]:
        return (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))

    def _spelt(self, words: str) -> str:
        """As the vocabulary spells the bytes of the letters beyond ASCII."""
        return words if words.isascii() else words.translate(self.spelling)

    def _words(self, words: list[str]) -> list[bytes]:
        """Of words of small Latin letters."""
        out, blocks = [], [words[k : k + 1000] for k in range(0, len(words), 1000)]
        for some, e in zip(blocks, self.bare.encode_batch_fast([self._spelt(" ".join(x)) for x in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)] if len(cuts) == len(some) else self._whole(some)
        return out

    def _learn(self, parts: set[str]) -> None:
        words = [p for p in parts if LETTERS.fullmatch(p)]
        for some in ([w for w in words if w.isascii()], [w for w in words if not w.isascii()]):
            self.known.update(zip(some, self._words(some), strict=True))
        other = list(parts.difference(words))
        self.known.update(zip(other, self._whole(other), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [parts_of(t) for t in texts]
        distinct = set().union(*parts)
        if len(self.known) + len(distinct) > CACHE:
            self.known = {}
        self._learn(distinct.difference(self.known))
        end, known = END_ID.to_bytes(4, "little"), self.known
        return [b"".join([known[p] for p in doc]) + end for doc in parts]


_encoders: dict[str, Encoder] = {}  # of this worker


class Windows:
    """The open windows of a partition, ordered by their free room."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.by_room = length, most, []
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def _put(self, room: int, key: int, piece: tuple, n: int) -> list[tuple] | None:
        self.held.setdefault(key, []).append((*piece, self.length - room))
        if room == n:
            return self.held.pop(key)
        insort(self.by_room, (room - n, key))
        return None

    def best(self, n: int) -> tuple[int, int] | None:
        k = bisect_left(self.by_room, (n, -1))
        return self.by_room.pop(k) if k < len(self.by_room) else None

    def fullest(self) -> tuple[int, int] | None:
        """The fullest window, once as many as may be are open."""
        return self.by_room.pop(0) if len(self.by_room) >= self.most else None

    def put(self, at: tuple[int, int] | None, piece: tuple, n: int) -> list[tuple] | None:
        """Into the window `at`, or a new one; what a window holds, when it is full."""
        if at is None:
            at, self.opened = (self.length, self.opened), self.opened + 1
        return self._put(*at, piece, n)


def _packed(batches: Iterator[pa.RecordBatch], path: str, length: int, most: int, fill: int, key: int) -> Iterator[pa.RecordBatch]:
    encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
    windows, out = Windows(length, most), []

    def emit(pieces: list[tuple] | None, still_open: bool = False) -> None:
        for doc_id, start, n, crc, total, window, offset in pieces or ():
            out.append((doc_id, start, n, crc, total, key << 32 | window, offset, still_open))

    def place(doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(length, total - start)
            if (at := windows.best(n)) is None and (at := windows.fullest()) is not None:
                if at[0] >= fill:
                    n = at[0]
                else:
                    emit(windows.held.pop(at[1]))
                    at = None
            window = windows.opened if at is None else at[1]
            emit(windows.put(at, (doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), total, window), n))
            start += n

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(KINDS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, KINDS, strict=True)], schema=KINDS)

    for b in batches:
        held, chars = [], 0
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            held.append((doc_id, text or ""))
            chars += len(held[-1][1])
            if chars >= AT_ONCE:
                for (i, _), ids in zip(held, encode([t for _, t in held]), strict=True):
                    place(i, ids)
                held, chars = [], 0
        for (i, _), ids in zip(held, encode([t for _, t in held]), strict=True):
            place(i, ids)
        yield rows()
    for pieces in windows.held.values():
        emit(pieces, still_open=True)
    yield rows()


def _merged(length: int) -> callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = pd.concat([*batches, pd.DataFrame({"window": [], "used": []}, dtype="int64")])
        bins = Windows(length, len(left) + 1)
        first: dict[int, int] = {}
        rows = []
        for used, window in sorted(zip(left["used"], left["window"], strict=True), key=lambda x: (-x[0], x[1])):
            at = bins.best(used)
            at = at or (length, len(first))
            sequence = first.setdefault(at[1], window)
            rows.append((window, sequence, length - at[0]))
            if at[0] > used:
                insort(bins.by_room, (at[0] - used, at[1]))
        yield pd.DataFrame(rows, columns=["window", "sequence_id", "base"]).astype("int64")

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, most_open: int = OPEN, fill: int = FILL, windows_per_task: int = 8192) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document longer than a window is cut; so is a piece for which no open window has room,
    where the fullest has a gap of `fill` tokens or more. A null or empty text is the end id
    alone. Repeated rows are packed each, null ids stay null, an empty table gives no rows;
    columns other than doc_id and text are ignored. Sequence ids are unique, not gapless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(batches, path or tokenizer_path(), length, most_open, fill, TaskContext.get().partitionId())

    pieces = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES))
    left = pieces.where("open").groupBy("window").agg(F.sum("length").alias("used"))
    tasks = max(1, -(-left.count() // windows_per_task))
    bins = left.repartition(tasks, "window").mapInPandas(_merged(length), "window long, sequence_id long, base long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    merged = pieces.where("open").join(bins, "window").select(*columns, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return pieces.where("NOT open").select(*columns, F.col("window").alias("sequence_id"), "offset").unionByName(merged)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
