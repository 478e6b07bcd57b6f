"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Captures of a URL fall into cells of time. The latest full response of each cell is found by
aggregation, the cells of a URL are filled forward, and only within a cell are captures ordered
by time; so a URL that holds a third of all captures is dealt out over its cells. Payloads are
not moved: a resolved revisit names the response whose payload it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohlspark.llm.common import table
from ohlspark.llm.urls import canonical_url

#: Headers that a 304 response may renew (RFC 9110, 15.4.5, and RFC 9111, 3.2); fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
CELL_SECONDS = 3600


def _etag(headers: Column) -> Column:
    """For weak comparison: without W/."""
    return F.regexp_replace(headers["etag"], "^W/", "")


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last one's value."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"])
    return F.when(headers.isNotNull(), F.map_from_entries(F.filter(entries, last))).otherwise(F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, renewed by the permitted ones of the revisit."""
    allowed = F.map_filter(fresh, lambda k, _: k.isin(PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(captures: DataFrame, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """captures(record_id, url, type, status, captured_at: whole seconds, headers: map) -> record_id,
    url_key, type, captured_at, source_id, outcome, headers.

    A full response is a record of type `response` with status 200 and an id. A revisit is of type `revisit`;
    its source is the full response of the same canonical URL with the latest captured_at before
    its own (of equal times the greatest record_id,
    of records that share it the one with the greatest headers). Outcome: `matched` if the etags are equal (weakly), or
    without an etag on one side the last-modified values; `unchecked` if they share no validator;
    `mismatch` if they differ; `orphan` without a source, or without url or time; null for other records.
    Headers: merged for matched and unchecked revisits, else the record's own, names in lower case.
    Only matched and unchecked revisits have a source_id. Null header maps are empty; repeated rows
    stay; columns other than those named are ignored.
    """
    own = captures.select("record_id", canonical_url(F.col("url")).alias("url_key"), "type", "status", F.col("captured_at").cast("long").alias("captured_at"), _lowered(F.col("headers")).alias("headers"))
    rows = own.withColumn("cell", F.floor(F.col("captured_at") / cell_seconds))
    usable = rows.where("url_key IS NOT NULL AND captured_at IS NOT NULL")
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    stored = F.struct("captured_at", "record_id", F.array_sort(F.map_entries("headers")).alias("headers"))
    # the latest full response of each cell, filled forward to the cells after it: a row a cell
    cells = usable.groupBy("url_key", "cell").agg(F.max(F.when(full, stored)).alias("latest"))
    before = Window.partitionBy("url_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("url_key", "cell", F.last("latest", ignorenulls=True).over(before).alias("carried"))
    # within a cell: full responses of an earlier second; equal seconds don't count
    inside = Window.partitionBy("url_key", "cell").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    near = usable.withColumn("near", F.max(F.when(full, F.struct("captured_at", "record_id"))).over(inside))
    revisits = near.where("type = 'revisit'").join(carried, ["url_key", "cell"], "left")
    inner = usable.where(full).groupBy("url_key", "cell", "captured_at", "record_id").agg(F.max(F.array_sort(F.map_entries("headers"))).alias("near_headers"))
    r, i = revisits.alias("r"), inner.alias("i")
    same = (F.col("r.url_key") == F.col("i.url_key")) & (F.col("r.cell") == F.col("i.cell")) & (F.col("r.near.captured_at") == F.col("i.captured_at")) & (F.col("r.near.record_id") == F.col("i.record_id"))
    got = r.join(i, same, "left").select("r.*", "near_headers").select(
        "record_id", "url_key", "type", "captured_at", "headers",
        F.coalesce("near.record_id", "carried.record_id").alias("found"),
        F.map_from_entries(F.when(F.col("near").isNotNull(), F.col("near_headers")).otherwise(F.col("carried.headers"))).alias("stored"),
    )
    new, old = F.col("headers"), F.col("stored")
    equal = F.coalesce(_etag(new) == _etag(old), new["last-modified"] == old["last-modified"])
    outcome = F.when(F.col("found").isNull(), "orphan").when(equal.isNull(), "unchecked").when(equal, "matched").otherwise("mismatch")
    good = F.col("outcome").isin("matched", "unchecked")
    columns = ["record_id", "url_key", "type", "captured_at"]
    resolved = got.withColumn("outcome", outcome).select(
        *columns, F.when(good, F.col("found")).alias("source_id"), "outcome", F.when(good, merged_headers(old, new)).otherwise(new).alias("headers")
    )
    nil = F.lit(None)
    usual = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull() & (F.col("type") == "revisit")
    others = own.where(~F.coalesce(usual, F.lit(False))).select(*columns, nil.cast(own.schema["record_id"].dataType).alias("source_id"), F.when(F.col("type") == "revisit", "orphan").alias("outcome"), "headers")
    return resolved.unionByName(others)


def captures_of(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> three captures of each page: a full response, the same again
    with changed content for every third page (else a revisit), and a later revisit. Record 10 * page_id
    + k is captured page_id + 86400 * k seconds after 2024-01-01; entity tags are digests of the html."""
    k = F.col("k")
    changed = (k == 1) & (F.col("page_id") % 3 == 0)
    response = (k == 0) | changed
    state = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    tag = F.concat(F.when(F.col("page_id") % 5 == 0, "W/").otherwise(""), F.lit('"'), F.substring(state, 1, 16), F.when(changed | ((k == 2) & (F.col("page_id") % 6 == 0)), "-2").otherwise(""), F.lit('"'))
    time = F.col("page_id") + 86400 * k
    date = F.concat(F.lit("t"), time.cast("string"))
    headers = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("Date").alias("key"), date.alias("value")),
        F.struct(F.lit("ETag").alias("key"), F.when((F.col("page_id") % 7 != 0), tag).alias("value")),
        F.struct(F.lit("Content-Length").alias("key"), F.when(response, F.octet_length("html").cast("string")).otherwise("0").alias("value")),
    ), lambda e: e["value"].isNotNull()))
    return pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        (10 * F.col("page_id") + k).alias("record_id"), "url", F.when(response, "response").otherwise("revisit").alias("type"),
        F.when(response, 200).otherwise(304).alias("status"), (F.lit(1704067200) + time).cast("long").alias("captured_at"), headers.alias("headers"),
    )


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of all pages (captures_of); headers as `name: value` lines, sorted."""
    found = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(lines, "\n"))


SQL = r"""
WITH p AS (
  SELECT page_id, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS params
  FROM pages),
c AS (
  SELECT 10 * page_id + k AS record_id,
    regexp_replace(host, ':(80|443)?$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key,
    CASE WHEN k = 0 OR (k = 1 AND page_id % 3 = 0) THEN 'response' ELSE 'revisit' END AS type,
    1704067200 + page_id + 86400 * k AS captured_at, 't' || (page_id + 86400 * k) AS d,
    CASE WHEN page_id % 7 <> 0 THEN '"' || left(md5(coalesce(html, '')), 16) || CASE WHEN (k = 1 AND page_id % 3 = 0) OR (k = 2 AND page_id % 6 = 0) THEN '-2' ELSE '' END || '"' END AS bare,
    CASE WHEN page_id % 5 = 0 THEN 'W/' ELSE '' END AS weak,
    CASE WHEN k = 0 OR (k = 1 AND page_id % 3 = 0) THEN strlen(html)::VARCHAR ELSE '0' END AS n
  FROM p, range(3) t(k)),
j AS (
  SELECT r.*, s.record_id AS found, s.bare AS s_bare, s.weak AS s_weak, s.n AS s_n,
    row_number() OVER (PARTITION BY r.record_id ORDER BY s.captured_at DESC NULLS LAST, s.record_id DESC) AS nth
  FROM c r LEFT JOIN c s ON r.type = 'revisit' AND s.type = 'response' AND s.url_key = r.url_key AND s.captured_at < r.captured_at),
o AS (
  SELECT *, CASE WHEN type = 'response' THEN NULL WHEN found IS NULL OR url_key IS NULL THEN 'orphan' WHEN bare IS NULL OR s_bare IS NULL THEN 'unchecked' WHEN bare = s_bare THEN 'matched' ELSE 'mismatch' END AS outcome
  FROM j WHERE nth = 1),
g AS (SELECT *, outcome IS NOT NULL AND outcome IN ('matched', 'unchecked') AS good FROM o)
SELECT record_id, url_key, type, captured_at::BIGINT AS captured_at, CASE WHEN good THEN found END AS source_id, outcome,
  concat_ws(chr(10), 'content-length: ' || CASE WHEN good THEN s_n ELSE n END, 'date: ' || d,
    'etag: ' || CASE WHEN bare IS NOT NULL THEN weak || bare WHEN good THEN s_weak || s_bare END) AS headers
FROM g
"""
