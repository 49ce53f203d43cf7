"""Not-modified revisits of web archives, resolved to the response that they stand for.

A crawler that asks again and is told "not modified" stores a revisit record without a body. It stands for the latest
earlier full response of the same canonical URL, if the validators agree: the ETag where both have one (weak comparison),
else Last-Modified. The resolved record has the earlier body and the earlier headers, with those that a not-modified
answer may renew taken from the revisit.

The as-of join is two-level, because one URL may have a third of all captures: captures of a URL are cut into time
slices of its own; a window carries the latest full response along within a slice, and the last one of each slice is
carried along the slices. Windows move identifiers only. Bodies never move; a result names the record that has the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import table
from formloom.session import kept

#: Time slice of the as-of join, in units of the captures' time.
SLICE = 4096
# Headers that a 304 answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
HEADERS = "map<string,string>"


def canonical_url(url: Column) -> Column:
    """Scheme, leading www., default port, fragment, tracking parameters, last slash and letter case of the host go."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    split = F.regexp_extract(bare, r"^([^/?]*)(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(split), r"^www\.", ""), ":(80|443)$", "")
    rest = F.regexp_extract(bare, r"^([^/?]*)(.*)$", 2)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolved(captures: DataFrame, slice_width: int = SLICE) -> DataFrame:
    """A row per revisit: record_id, url_key, fetched_at, refers_to, status, digest, headers.

    ``captures`` has record_id (unique), url, fetched_at (long), kind ('response' or 'revisit'), headers (lower-case names) and
    digest of the body; further columns are left out. ``status`` is resolved, mismatch (the latest earlier response has
    other validators), unchecked (no validator on one side) or missing (no earlier response). Only a resolved record has
    a digest and merged headers; others keep their own headers.

    "Earlier" is by (fetched_at, record_id), so captures of one moment have an order. A null url, time or kind takes no part as
    a response; revisits without url or time are missing. Null headers are none. Captures without record id are left
    out; of those that share one, the first by url, time, kind and digest counts. An empty table gives an empty result.
    """
    c = captures.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("fetched_at").cast("long").alias("fetched_at"), "kind", "digest",
        F.coalesce(F.col("headers"), F.create_map().cast(HEADERS)).alias("headers"),
    )
    whole = F.struct(*c.columns).alias("c")
    c = c.filter(F.col("kind").isin("response", "revisit") & F.col("record_id").isNotNull())
    c = c.groupBy("record_id").agg(F.min_by(whole, F.struct("url_key", "fetched_at", "kind", "digest")).alias("c")).select("c.*")
    c = kept(c)
    timed = F.col("url_key").isNotNull() & F.col("fetched_at").isNotNull()
    full = F.when(F.col("kind") == "response", F.struct("fetched_at", "record_id"))
    slim = c.filter(timed).select("record_id", "url_key", "fetched_at", "kind", F.floor(F.col("fetched_at") / slice_width).alias("slice"))
    before = Window.partitionBy("url_key", "slice").orderBy("fetched_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = slim.withColumn("near", F.last(full, ignorenulls=True).over(before)).filter(F.col("kind") == "revisit")
    lasts = slim.filter(F.col("kind") == "response").groupBy("url_key", "slice").agg(F.max(F.struct("fetched_at", "record_id")).alias("own"))
    asked = near.filter(F.col("near").isNull()).select("url_key", "slice").distinct()
    along = Window.partitionBy("url_key").orderBy("slice", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    marks = lasts.unionByName(asked.withColumn("own", F.lit(None).cast(lasts.schema["own"].dataType)), allowMissingColumns=True)
    # One row per slice: the response that the slice ends with, and what a revisit without one in its slice sees.
    marks = marks.groupBy("url_key", "slice").agg(F.max("own").alias("own"))
    far = marks.withColumn("far", F.last("own", ignorenulls=True).over(along)).select("url_key", "slice", "far")
    found = near.join(far, ["url_key", "slice"], "left").select(
        "record_id", "url_key", "fetched_at", F.coalesce("near", "far").getField("record_id").alias("refers_to")
    )
    responses = c.filter((F.col("kind") == "response") & timed).select(
        F.col("record_id").alias("refers_to"), F.col("headers").alias("old"), F.col("digest").alias("old_digest")
    )
    own = c.filter(F.col("kind") == "revisit").select("record_id", "url_key", "fetched_at", "headers")
    pairs = own.join(found.select("record_id", "refers_to").distinct(), "record_id", "left").join(responses, "refers_to", "left")
    tags = _weak(F.col("headers")["etag"]), _weak(F.col("old")["etag"])
    dates = F.col("headers")["last-modified"], F.col("old")["last-modified"]
    agrees = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).when(
        dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1]
    )
    status = (
        F.when(F.col("refers_to").isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    )
    renewed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    unchanged = F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    good = F.col("status") == "resolved"
    return pairs.withColumn("status", status).select(
        "record_id", "url_key", "fetched_at", "refers_to", "status",
        F.when(good, F.col("old_digest")).alias("digest"),
        F.when(good, F.map_concat(unchanged, renewed)).otherwise(F.col("headers")).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures for the test pages: each page is fetched in full and asked for again three times, at times that follow
    from its id. The second question has the validators of a later version for some pages, the third has none for some.
    """
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    base = pages.select("page_id", "url", digest.alias("digest")).withColumn("tag", tag)
    nth = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")
    rows = base.select("page_id", "url", "digest", "tag", nth)
    own = F.when((F.col("n") == 2) & (F.col("page_id") % 5 == 0), F.lit('"changed"')).otherwise(F.concat(F.when(F.col("n") == 1, "W/").otherwise(""), "tag"))
    headers = F.map_from_arrays(
        F.array(F.lit("date"), F.lit("content-type"), F.lit("etag")),
        F.array(F.concat(F.lit("day "), F.col("fetched_at").cast("string")), F.when(F.col("n") == 0, "text/html").otherwise("text/plain"), own),
    )
    silent = (F.col("n") == 3) & (F.col("page_id") % 7 == 0)
    headers = F.when(silent, F.map_filter(headers, lambda k, _: k != "etag")).otherwise(headers)
    return rows.withColumn("fetched_at", F.col("page_id") + F.col("n") * (F.lit(3) + F.col("page_id") % 1000)).select(
        (F.col("page_id") * 4 + F.col("n")).alias("record_id"), "url", "fetched_at",
        F.when(F.col("n") == 0, "response").otherwise("revisit").alias("kind"), headers.alias("headers"),
        F.when(F.col("n") == 0, F.col("digest")).alias("digest"),
    )


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolved(captures_of(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.select("record_id", "url_key", "fetched_at", "refers_to", "status", "digest", F.array_join(entries, ";").alias("headers"))


ORACLE = r"""
WITH c AS (SELECT page_id, url, n, sha256(coalesce(html, '')) AS digest, '"' || substr(sha256(coalesce(html, '')), 1, 12) || '"' AS tag,
    page_id + n * (3 + page_id % 1000) AS fetched_at, page_id * 4 + n AS record_id
  FROM pages, (SELECT unnest([0, 1, 2, 3]) AS n)),
h AS (SELECT *, CASE WHEN n = 3 AND page_id % 7 = 0 THEN NULL WHEN n = 2 AND page_id % 5 = 0 THEN '"changed"'
    WHEN n = 1 THEN 'W/' || tag ELSE tag END AS etag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
    list_sort([p FOR p IN string_split(regexp_extract(bare, '\?(.*)$', 1), '&') IF p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid)(=|$)')]) AS q FROM h),
k AS (SELECT *, stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM u),
a AS (SELECT *, last_value(CASE WHEN n = 0 THEN record_id END IGNORE NULLS) OVER w AS refers_to,
    last_value(CASE WHEN n = 0 THEN etag END IGNORE NULLS) OVER w AS old_tag, last_value(CASE WHEN n = 0 THEN digest END IGNORE NULLS) OVER w AS old_digest
  FROM k WINDOW w AS (PARTITION BY url_key ORDER BY fetched_at, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'missing' WHEN etag IS NULL THEN 'unchecked'
    WHEN regexp_replace(etag, '^W/', '') = old_tag THEN 'resolved' ELSE 'mismatch' END AS status FROM a WHERE n > 0)
SELECT record_id, url_key, fetched_at, refers_to, status, CASE WHEN status = 'resolved' THEN old_digest END AS digest,
  CASE WHEN status = 'resolved' THEN 'content-type=text/html;' ELSE 'content-type=text/plain;' END || 'date=day ' || fetched_at || coalesce(';etag=' || etag, '') AS headers
FROM s"""
