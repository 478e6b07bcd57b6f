"""The pipeline and each of its stages on planted cases, odd rows and extra columns."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ohlspark.llm.op09_packing import tokenizer_path

SF = "/root/testdata/sf0.01"
SECRET = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"


@pytest.fixture(scope="module")
def planted(spark):
    """Real documents, and with them copies, leaks, a secret, junk and odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 20000")
    good = [r.text for r in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id").where("length(text) > 2500").orderBy("doc_id").limit(6).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    words = good[0].split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (10**9 + 1, good[0][::1]), (10**9 + 2, near), (10**9 + 3, good[1] + "\n" + item), (10**9 + 4, good[2] + f' token = "{SECRET}" and the'),
        (10**9 + 5, "### %%% " * 400), (10**9 + 6, None), (10**9 + 7, ""), (None, good[3] + " extra end"), (10**9 + 8, good[4] + " one"), (10**9 + 8, good[4] + " one"), (10**9 + 9, good[5] * 40),
    ]
    own = spark.createDataFrame([(i, t, "en", "planted", None if t is None else len(t)) for i, t in rows], docs.schema)
    return docs.unionByName(own).cache()


def run_stage(spark, name, docs, out):
    stage = dict(corpus_pipeline.STAGES)[name]
    stage(spark, docs, SF).write.parquet(str(out))
    return spark.read.parquet(str(out))


def test_stages_in_turn(spark, planted, tmp_path):
    docs, kept = planted, {}
    for k, (name, _) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, run_stage(spark, name, docs, tmp_path / str(k))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").distinct().collect()} for name, df in kept.items()}
    junk = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    quality = ids["quality classifier"]
    assert 10**9 + 5 not in quality and len(junk & quality) < 0.2 * len(junk)
    assert {10**9 + k for k in (1, 2, 3, 4, 6, 7, 8, 9)} <= quality and None in quality
    # of a text, its copy and its near copy one stays
    dedup = kept["MinHash near-dedup"]
    assert not {10**9 + 1, 10**9 + 2} & ids["MinHash near-dedup"]
    assert dedup.where(F.col("doc_id") == 10**9 + 8).count() + dedup.where(F.col("text").endswith(" one")).count() <= 2
    assert 10**9 + 6 in ids["MinHash near-dedup"]  # no text, no copy
    assert 10**9 + 3 not in ids["benchmark decontamination"]
    secrets = kept["secret scans"].where(F.col("text").contains(SECRET)).count()
    assert secrets == 0 and kept["secret scans"].count() == kept["benchmark decontamination"].count()
    # the pieces hold every id of every text once
    tokenizer, pieces = Tokenizer.from_file(tokenizer_path()), kept["packing"]
    texts = kept["secret scans"].select("doc_id", "text").collect()
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in random.Random(1).sample(texts, len(texts)))
    assert pieces.agg(F.sum("length")).first()[0] == want
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n != end OR n > 2048").count() == 0


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables_and_clashing_names(spark, planted, name):
    extra = ["node", "comp", "bands", "low", "n_words", "word_ranges", "item_ids", "spans", "row", "text_key", "flags", "doc", "score", "kept", "lang_n", "block", "task", "best_id"]
    some = planted.where("doc_id IS NULL OR doc_id < 60 OR doc_id > 1000000").select("*", *(F.lit(3).alias(c) for c in extra))
    out = dict(corpus_pipeline.STAGES)[name](spark, some, SF)
    empty = dict(corpus_pipeline.STAGES)[name](spark, some.where("false"), SF)
    assert empty.count() == 0
    if name != "packing":
        assert out.columns == some.columns == empty.columns
        assert out.select(*extra).distinct().count() == 1


def test_stages_leave_only_the_last_behind(spark, monkeypatch, tmp_path):
    seen = []
    keep = lambda s, docs, d: (seen.append(docs.count()), docs.select("doc_id", "text"))[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", keep), ("two", keep), ("three", keep)])
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda s: str(tmp_path))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and seen == [200, 200, 200]
    assert [p.name for folder in tmp_path.iterdir() for p in folder.iterdir()] == ["2"]
