import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from ohlspark.llm.op09_packing import op9_packing, pack, tokenizer_path

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def verified(rows, texts, length=2048):
    """Each id of each document in one piece, windows gapless and not over their length; padded share."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and len(part) == p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p.length
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        used += at
    return 1 - used / (length * len(by_sequence))


def test_whole_table_is_packed_with_little_padding(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert verified(op9_packing(spark, SF).collect(), texts) < 0.02


def test_nulls_long_texts_special_strings_and_clashing_columns(spark):
    texts = {1: None, 2: "", 3: "Word, word! " * 4000, 4: "a <|endoftext|>b\tİstanbul\x1cΣΑΣ café ́x", 5: "it's  we'll\n\n3.14", 6: "x" * 9000, 7: "Жук ªb Été it's l'eau ² ½ab µ 日本語 İ"}
    rows = [Row(doc_id=k, text=v, window=1, start="s", open=2.0) for k, v in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, window int, start string, open double")
    verified(pack(df, length=64, most_open=3).collect(), texts, 64)


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert pack(spark.createDataFrame([], schema)).columns == COLUMNS
    assert pack(spark.createDataFrame([], schema)).count() == 0
    big = (1 << 60) + 1
    rows = pack(spark.createDataFrame([(None, "a"), (big, "a b"), (big, "a b")], schema)).collect()
    assert sorted(str(r.doc_id) for r in rows) == [str(big), str(big), "None"]


@pytest.mark.parametrize("length", [1, 2, 7])
def test_tiny_windows(spark, length):
    texts = {i: "word " * (i % 5) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    verified(pack(df, length=length, most_open=2).collect(), texts, length)
