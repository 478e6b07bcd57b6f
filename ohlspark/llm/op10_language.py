"""Language identification by Bayesian fusion of four kinds of evidence on a page.

Text likelihoods come from a byte-trigram model of labelled texts; the declared markup language
and the address suffix from tables of how often each goes with each language; the prior from
counts of languages by host, smoothed towards those of its domain, these towards its suffix, and
these towards all pages. All tables are made by grouped aggregation of the posteriors that text alone gives,
as whole millionths, so sums are the same in any order. A page's own text doesn't count in its prior.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlspark.llm.common import ascii_lower, broadcast_if, settled, table
from ohlspark.llm.urls import url_host, url_path

#: At most so many labelled texts train the model of each language, those whose ids hash least.
SAMPLE = 2000
#: The table of log-probabilities goes to every task: at most so many languages (128 MB).
LANGUAGES = 256
SLOTS = 1 << 16
#: Text counts as so many independent trigrams at most: neighbouring trigrams tell much the same.
EVIDENCE = 60.0
ALPHA, BETA = 2.0, 1.0
ONE = 1_000_000
TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def visible_text(page: str) -> str:
    return entities.unescape(TAGS.sub(" ", page))


def slots(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((b[:-2] * 40503 + b[1:-1] * 2531 + b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) if len(b) > 2 else np.empty(0, np.int64)


def text_model(texts: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """texts(doc_id, text, lang) -> the languages, sorted, and log-probabilities (SLOTS, languages). More than LANGUAGES languages are refused."""
    known = texts.where("text IS NOT NULL AND lang IS NOT NULL")
    order = F.xxhash64("doc_id", "lang")
    cut = settled(known.groupBy("lang").agg(F.count("*").alias("n")))
    if (found := cut.count()) > LANGUAGES:
        raise ValueError(f"{found} languages; at most {LANGUAGES}")
    # of n texts those in the first sample / n of the hash's range: about `sample`, without sorting a language in one task
    share = (order.cast("double") / 2.0**64 + 0.5) < F.col("share")
    some = known.select("doc_id", "lang", "text").join(F.broadcast(cut.select("lang", (sample / F.col("n")).alias("share"))), "lang").where(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                counts.setdefault(lang, np.zeros(SLOTS, np.int64))
                counts[lang] += np.bincount(slots(text), minlength=SLOTS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "slot": at, "n": n[at]})

    rows = some.select("lang", "text").mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())  # at most SLOTS rows a language
    n = np.full((SLOTS, len(langs)), 0.5)
    n[rows["slot"].to_numpy(np.int64), rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)] += rows["n"].to_numpy(float)
    return langs, np.log(n / n.sum(0))


def domain_of(host: Column) -> Column:
    """The last two labels of a host without its port."""
    return F.substring_index(F.regexp_replace(host, ":[0-9]*$", ""), ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(F.regexp_replace(host, ":[0-9]*$", ""), ".", -1)


def evidence(pages: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, domain, suffix, hint, declared, n_grams, and like: log-likelihoods
    of the text by language in millionths, tempered."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    own = pages.select(
        "page_id", host.alias("host"), domain_of(host).alias("domain"), suffix_of(host).alias("suffix"),
        ascii_lower(F.regexp_extract(path, "^/([A-Za-z]{2})(?:[/_-]|$)", 1)).alias("hint"),
        ascii_lower(F.coalesce(F.regexp_extract("html", DECLARED, 1), F.lit(""))).alias("declared"), "html",
    )
    carry = own.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like, n = [], []
            for page in b["html"].to_pylist():
                at = slots(visible_text(page or ""))
                total = logp[at].sum(0) if len(at) else np.zeros(len(langs))
                total = (total - total.max(initial=-np.inf)) * min(1.0, EVIDENCE / max(len(at), 1))
                like.append(np.rint(total * ONE).astype(np.int64).tolist())
                n.append(len(at))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in carry), pa.array(n, pa.int64()), pa.array(like, pa.list_(pa.int64()))], names=[*carry, "n_grams", "like"])

    kept = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(run, f"{kept}, n_grams long, like array<long>")


def softmax(scores: Column) -> Column:
    """Of an array of logarithms."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def identify(pages: DataFrame, texts: DataFrame, sample: int = SAMPLE, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """pages(page_id, url, html), texts(doc_id, text, lang) -> a row for each page: page_id, host, declared,
    suffix, text_lang, lang, confidence (posterior of lang, rounded to 4 digits).

    A null or empty page has no text and no declaration: its host's prior decides; a null url has
    the host ''. text_lang is null without text. Ties go to the language first in order. Without any labelled text lang is
    null. Repeated rows stay and count each; columns other than those named are ignored.
    """
    langs, logp = text_model(texts, sample)
    if not langs:
        host = url_host(F.col("url"))
        return pages.select("page_id", host.alias("host"), ascii_lower(F.coalesce(F.regexp_extract("html", DECLARED, 1), F.lit(""))).alias("declared"), suffix_of(host).alias("suffix"), *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")), F.lit(None).cast("double").alias("confidence"))
    size = len(langs)
    names = F.array(*map(F.lit, langs))
    seen = evidence(pages, langs, logp)
    soft = softmax(F.transform("like", lambda x: x / ONE))
    own = F.when(F.col("n_grams") > 0, F.transform(soft, lambda p: F.round(p * ONE).cast("long"))).otherwise(F.array(*[F.lit(0).cast("long")] * size))
    seen = settled(seen.withColumn("own", own))

    def counts(by: list[str], name: str) -> DataFrame:
        """Millionths of pages of each language by a key; partial sums come before the shuffle."""
        sums = seen.groupBy(*by).agg(*(F.sum(F.col("own")[k]).alias(f"s{k}") for k in range(size)))
        return sums.select(*by, F.array(*(F.col(f"s{k}") for k in range(size))).alias(name))

    tables = [(["host", "domain", "suffix"], "by_host"), (["domain", "suffix"], "by_domain"), (["suffix"], "by_suffix"), (["declared"], "by_declared"), (["hint"], "by_hint")]
    joined = seen
    for by, name in tables:
        t = settled(counts(by, name))
        joined = joined.join(broadcast_if(t, t.count() * (60 * len(by) + 8 * size), broadcast_bytes), by)
    total = counts([], "all_pages")
    joined = joined.join(F.broadcast(total))  # one row

    def level(name: str, above: Column, alpha: float) -> Column:
        """Counts without this page's own, smoothed towards the level above."""
        rest = F.zip_with(name, F.col("own"), lambda a, b: (a - b) / ONE)
        n = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, above, lambda c, p: (c + alpha * p) / (n + alpha))

    even = F.array(*[F.lit(1.0 / size)] * size)
    steps = [("p_all", "all_pages", even), ("p_suffix", "by_suffix", F.col("p_all")), ("p_domain", "by_domain", F.col("p_suffix")), ("prior", "by_host", F.col("p_domain"))]
    for name, by, above in steps:
        joined = joined.withColumn(name, level(by, above, ALPHA))

    def given(name: str) -> Column:
        """Log P(sign | language) up to a constant: share of the language's pages that have the sign, pages without a sign say nothing."""
        rest = F.zip_with(name, F.col("own"), lambda a, b: (a - b) / ONE)
        return F.transform(F.zip_with(rest, F.zip_with("all_pages", F.col("own"), lambda a, b: (a - b) / ONE), lambda c, n: (c + BETA) / (n + BETA * size)), lambda x: F.log(x))

    none = F.array(*[F.lit(0.0)] * size)
    marked = F.when(F.col("declared") != "", given("by_declared")).otherwise(none)
    hinted = F.when(F.col("hint") != "", given("by_hint")).otherwise(none)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = plus(plus(F.transform("prior", lambda x: F.log(x)), F.transform("like", lambda x: x / ONE)), plus(marked, hinted))
    posterior = F.transform(softmax(fused), lambda p: F.round(p, 6))
    out = joined.select("page_id", "host", "declared", "suffix", "n_grams", "like", posterior.alias("posterior"))
    first = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return out.select(
        "page_id", "host", "declared", "suffix", F.when(F.col("n_grams") > 0, first(F.col("like"))).alias("text_lang"),
        first(F.col("posterior")).alias("lang"), F.round(F.array_max("posterior"), 4).alias("confidence"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
