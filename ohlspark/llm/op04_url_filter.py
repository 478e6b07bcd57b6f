"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits on to an
exact hash join; rules on host and path take precedence. Only DataFrame functions are used.

The filter is itself a table: a URL's hash picks one block of four 64-bit words, and one bit
in each word. Blocks are built by a grouped bit_or and met by an equi-join on the block number,
so neither building nor probing depends on the filter fitting into one machine. It is broadcast
only while its size, known from the number of listed URLs, is within a limit.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohlspark.llm.common import broadcast_if, table
from ohlspark.llm.urls import canonical_url, url_host, url_path

WORDS = 4

#: Fixed rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Names of the hosts whose pages make up the URL list of the registered query.
LISTED_HOSTS = r"(^|\.)(spam-farm|cheap-pills|casino-win|ads-track|free-bets)\."


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def _mask(url: Column, word: int) -> Column:
    bit = F.shiftrightunsigned(F.xxhash64(url, F.lit("bits")), 6 * word).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """listed(url), distinct -> block, w0..w3: the blocks in which any bit is set."""
    return listed.groupBy(_block(F.col("url"), n_blocks).alias("block")).agg(
        *(F.bit_or(_mask(F.col("url"), i)).alias(f"w{i}") for i in range(WORDS))
    )


def listed_urls(pages: DataFrame, listed: DataFrame, bits_per_url: int = 12, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """pages(page_id, url_key, ...) -> the same rows and `listed`: whether url_key is in listed(url).

    Null and unlisted keys give false; repeated rows stay; an empty list lists nothing.
    Rows that miss the filter never reach the exact join.
    """
    listed = listed.select("url").where(F.col("url").isNotNull()).distinct()
    n_blocks = max(1, ceil(listed.count() * bits_per_url / (64 * WORDS)))
    blocks = broadcast_if(bloom_blocks(listed, n_blocks), n_blocks * 8 * (WORDS + 1), broadcast_bytes)
    keyed = pages.withColumn("block", F.coalesce(_block(F.col("url_key"), n_blocks), F.lit(-1)))
    hit = F.lit(True)
    for i in range(WORDS):
        m = _mask(F.col("url_key"), i)
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    tested = keyed.join(blocks, "block", "left").withColumn("maybe", F.coalesce(hit & F.col("url_key").isNotNull(), F.lit(False)))
    columns = [F.col(c) for c in pages.columns]
    passed = tested.where("maybe").select(columns)
    exact = listed.select(F.col("url").alias("url_key"), F.lit(True).alias("found"))
    return (
        passed.join(exact, "url_key", "left")
        .select(*columns, F.coalesce("found", F.lit(False)).alias("listed"))
        .unionByName(tested.where("NOT maybe").select(*columns, F.lit(False).alias("listed")))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages(page_id, url), listed(url: canonical) -> page_id, host, path, rule, verdict, canonical_url, listed.

    The longest fitting rule decides; else a listed canonical URL is blocked, all others allowed.
    A null url, or one without ://, has an empty host and path, fits no rule and is allowed.
    Repeated rows and null ids stay as they are; columns other than page_id and url are ignored.
    """
    url = F.col("url")
    keyed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("url_key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return listed_urls(keyed, listed).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        F.col("url_key").alias("canonical_url"), "listed",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the canonical URLs of all pages on hosts named in LISTED_HOSTS."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(url_host(F.col("url")).rlike(LISTED_HOSTS)).select(canonical_url(F.col("url")).alias("url"))
    return filter_urls(pages, listed)


SQL = r"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN contains(url, '://') THEN list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) END AS params
  FROM pages),
k AS (
  SELECT page_id, host, path,
    CASE WHEN contains(url, '://') THEN regexp_replace(host, ':(80|443)?$', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical_url
  FROM p),
l AS (SELECT DISTINCT canonical_url AS url FROM k WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|casino-win|ads-track|free-bets)\.')),
r AS (
  SELECT k.*, l.url IS NOT NULL AS listed,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM k LEFT JOIN l ON k.canonical_url = l.url)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict,
  canonical_url, listed
FROM r
"""
