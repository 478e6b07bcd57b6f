"""URL parts and canonical URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ohlspark.llm.common import ascii_lower

#: Query parameters that say where a visitor came from, not what is shown.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without a default port, path without a trailing slash, and the sorted query
    parameters that are not tracking; no scheme and no fragment. Null for null or no ://."""
    host = F.regexp_replace(url_host(url), r":(80|443)?$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host, path, tail))
