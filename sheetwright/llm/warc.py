"""Not-modified revisit resolution for WARC captures.

A revisit says that a page had not changed since an earlier capture.  It is
joined, as of its own time, to the latest earlier full response of the same
canonical URL; its validators are checked against that response; and the
response's headers are refreshed with those that a 304 may update.

The answer depends on URL and time alone, so the join is made once for each
distinct pair of them, and repeated captures cost nothing.  It never sorts all
captures of a URL in one task: time is cut into ranges of about ROWS_PER_RANGE
pairs by a range partitioning; inside a (URL, range) a window finds the latest
earlier response, the latest response of each (URL, range) is carried forward
over the ranges, and a pair takes the former or else the latter.

Rows without a URL or a time match nothing and are reported as orphans; rows
without an id resolve and are found like any other.  Of responses at one time
the greatest record id counts, and of rows that share it the one with the least
hash of its contents; a response at the revisit's own time is not earlier.
Repeated revisits resolve each for itself, repeated responses count once.  Null
header maps count as empty; of header names that differ in case alone the one
greatest by code point counts.  Very long URLs and headers are read whole.  Other columns are not
read, so they can't clash.  An empty table gives an empty result.  All
operations are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetwright.llm.common import Scratch

ROWS_PER_RANGE = 200_000
#: Fields that a 304 response may update in a stored one.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query fields that do not name a resource.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, user, www., default port, fragment, tracking fields or closing slash; host in lower case, query fields sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^(?i)https?://([^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def weak_tag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def lower_names(headers: Column) -> Column:
    """The map with names in lower case; of names that then agree the greatest counts."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])
    return F.coalesce(F.map_from_arrays(names, values), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored header map with the permitted fields of ``fresh``; names in lower case."""
    update = F.map_filter(lower_names(fresh), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(lower_names(stored), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return F.map_concat(kept, update)


def latest_before(spark: SparkSession, records: DataFrame, scratch: Scratch, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """key, ts, target_ts, target: the latest earlier response of each distinct key and time of a revisit that has one, from
    ``records`` (record_id, key, ts long, is_response)."""
    pairs = records.where("key is not null and ts is not null").groupBy("key", "ts", "is_response").agg(F.max("record_id").alias("record_id"))
    kept = scratch.save(pairs, "captures")
    parts = max(1, kept.count() // rows_per_range)
    # The number of a range partition is that of its range of times; it is written, as partitions are drawn from a sample.
    placed = scratch.save(kept.repartitionByRange(parts, "ts").withColumn("_range", F.spark_partition_id()), "ranges")
    answer = F.when(F.col("is_response"), F.struct("ts", "record_id"))
    inside = Window.partitionBy("key", "_range").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.max(answer).over(inside)).where(~F.col("is_response"))
    latest = placed.where("is_response").groupBy("key", "_range").agg(F.max(F.struct("ts", "record_id")).alias("_last"))
    spots = latest.select("key", "_range", "_last").unionByName(local.where("_local is null").select("key", "_range").distinct().withColumn("_last", F.lit(None).cast(latest.schema["_last"].dataType)))
    spots = spots.groupBy("key", "_range").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select("key", "_range", F.max("_last").over(before).alias("_carried")).where("_carried is not null")
    found = local.join(carried, ["key", "_range"], "left").select("key", "ts", F.coalesce("_local", "_carried").alias("_found"))
    return found.where("_found is not null").select("key", "ts", F.col("_found.ts").alias("target_ts"), F.col("_found.record_id").alias("target"))


def resolve_revisits(spark: SparkSession, records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts long, kind, status, etag, last_modified, digest, headers).

    ``verdict``: orphan without an earlier response; etag or last_modified
    where that validator agrees; unchecked where the revisit has neither;
    mismatch where they differ (the tag decides if both sides have one).  Only
    a match or an unchecked revisit takes over digest and headers.
    """
    scratch = Scratch(spark, "revisits")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    again = F.col("kind") == "revisit"
    key = canonical_url(F.col("url"))
    rows = records.where(F.coalesce(full | again, F.lit(False))).select("record_id", key.alias("key"), "ts", F.coalesce(full, F.lit(False)).alias("is_response"))
    links = latest_before(spark, rows, scratch).alias("l")
    revisits = records.where(again).select("record_id", key.alias("canonical"), "ts", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"), F.col("headers").alias("_fresh")).alias("v")
    contents = F.struct("etag", "last_modified", "digest", "headers")
    content = F.xxhash64("etag", "last_modified", "digest", F.map_entries("headers"))
    responses = records.where(full).groupBy(key.alias("key"), "ts", "record_id").agg(F.min_by(contents, content).alias("_r")).select("key", "ts", "record_id", "_r.*").alias("r")
    joined = revisits.join(links, F.expr("v.canonical = l.key and v.ts = l.ts"), "left").join(responses, F.expr("l.key = r.key and l.target_ts = r.ts and l.target <=> r.record_id"), "left")
    joined = joined.select("v.*", "target", "target_ts", "etag", "last_modified", "digest", "headers")
    both_tags = F.col("_etag").isNotNull() & F.col("etag").isNotNull()
    both_times = F.col("_modified").isNotNull() & F.col("last_modified").isNotNull()
    verdict = (
        F.when(F.col("target_ts").isNull(), "orphan")
        .when(both_tags & (weak_tag(F.col("_etag")) == weak_tag(F.col("etag"))), "etag")
        .when(both_tags, "mismatch")
        .when(both_times & (F.col("_modified") == F.col("last_modified")), "last_modified")
        .when(F.col("_etag").isNotNull() | F.col("_modified").isNotNull(), "mismatch")
        .otherwise("unchecked")
    )
    taken = F.col("verdict").isin("etag", "last_modified", "unchecked")
    out = joined.withColumn("verdict", verdict)
    return out.select("record_id", "canonical", "ts", "target", "target_ts", "verdict", F.when(taken, F.col("digest")).alias("digest"), F.when(taken, merged_headers(F.col("headers"), F.col("_fresh"))).alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Capture records of a crawl over ``pages``: a response at 10 * page_id, unless page_id is a multiple of 5, and a
    revisit 15 later, whose validators agree, are changed (multiples of 7), are times alone (of 3) or lack (of 11)."""
    page = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    day = lambda n: F.concat(F.lit("day "), n.cast("string"))
    entries = lambda **h: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in h]), F.array(*h.values())), lambda _, v: v.isNotNull())
    rows = pages.select("page_id", "url", tag.alias("tag"), F.octet_length("html").alias("size"), F.sha1("html").alias("digest"))
    response = rows.where(page % 5 != 0).select(
        (page * 2).alias("record_id"), "url", (page * 10).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.col("tag").alias("etag"), day(page % 97).alias("last_modified"), "digest",
        entries(Content_Type=F.lit("text/html"), Content_Length=F.col("size").cast("string"), ETag=F.col("tag"), Date=day(page)).alias("headers"),
    )
    sent = F.when(page % 11 == 0, None).when(page % 7 == 0, F.lit('"changed"')).when(page % 3 == 0, None).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    since = F.when(page % 11 == 0, None).otherwise(day(page % 97))
    revisit = rows.select(
        (page * 2 + 1).alias("record_id"), "url", (page * 10 + 15).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), sent.alias("etag"), since.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        entries(Date=day(page + 1), Cache_Control=F.lit("max-age=60"), Content_Length=F.lit("0"), ETag=sent).alias("headers"),
    )
    return response.unionByName(revisit)


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


def revisit_digest(resolved: DataFrame) -> DataFrame:
    return resolved.select("record_id", "canonical", "ts", "target", "target_ts", "verdict", "digest", header_text(F.col("headers")).alias("headers"))


ORACLE = r"""
WITH bare AS (
  SELECT page_id, html, '"' || substr(md5(html), 1, 12) || '"' AS tag, strlen(html) AS size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://([^/?@]*@)?', '') AS u
  FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS fields
  FROM bare
), keyed AS (
  SELECT page_id, html, tag, size,
         CASE WHEN host <> '' THEN host || path || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical
  FROM parts
), responses AS (
  SELECT page_id * 2 AS target, page_id * 10 AS target_ts, canonical, tag, 'day ' || (page_id % 97) AS modified, sha1(html) AS digest, size, page_id
  FROM keyed WHERE page_id % 5 <> 0
), revisits AS (
  SELECT page_id * 2 + 1 AS record_id, page_id * 10 + 15 AS ts, canonical, page_id,
         CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 3 = 0 THEN NULL ELSE 'W/' || tag END AS sent,
         CASE WHEN page_id % 11 = 0 THEN NULL ELSE 'day ' || (page_id % 97) END AS since
  FROM keyed
), joined AS (
  SELECT v.record_id, v.canonical, v.ts, v.sent, v.since, v.page_id AS own, r.target, r.target_ts, r.tag, r.modified, r.digest, r.size
  FROM revisits v ASOF LEFT JOIN responses r ON v.canonical = r.canonical AND v.ts > r.target_ts
), judged AS (
  SELECT *, CASE WHEN target IS NULL THEN 'orphan'
                 WHEN sent IS NOT NULL AND regexp_replace(sent, '^W/', '') = tag THEN 'etag'
                 WHEN sent IS NOT NULL THEN 'mismatch'
                 WHEN since IS NOT NULL AND since = modified THEN 'last_modified'
                 WHEN since IS NOT NULL THEN 'mismatch'
                 ELSE 'unchecked' END AS verdict
  FROM joined
)
SELECT record_id, canonical, ts, target, target_ts, verdict,
       CASE WHEN verdict IN ('etag', 'last_modified', 'unchecked') THEN digest END AS digest,
       CASE WHEN verdict IN ('etag', 'last_modified', 'unchecked')
            THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;date=day ' || (own + 1) || ';etag=' || coalesce(sent, tag) END AS headers
FROM judged
"""
