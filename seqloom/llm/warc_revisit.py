"""Operator 8: resolving not-modified revisit records.

A revisit says that a url had not changed since an earlier capture. It is resolved against the
latest strictly earlier full response of the same canonical url (of responses of one instant, the
one with the largest id). The validators decide: the entity tags are compared weakly where both
sides have one, else the modification dates where both have one. A revisit that agrees takes the
response's payload, and its permitted headers replace the stored ones.

The as-of join is a sorted union in place of a range join. So that a url with a third of all records
does not meet in one task, all records are dealt by ranges of (url, instant) into buckets of about
``BUCKET_ROWS`` rows, as many as there are rows for; each (url, bucket) is walked by itself, and what a
bucket starts with is the last response of an earlier bucket, found among one row per (url, bucket).
Only validators, headers and ids take part; payloads join once the response is known.

Defined cases: a null or unparsable url forms its own key and is matched like any other text; a null
time makes a revisit an orphan and a response invisible; a null validator counts as absent, and
without a common validator the status is ``unvalidated`` and nothing is merged; repeated revisits
come back repeated; of responses that share url, instant and id any one gives the payload; an empty
side gives orphans or an empty result; very long urls and payloads are read whole; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, stored, table

#: Headers that a not-modified answer may renew (RFC 9110, section 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
BUCKET_ROWS = 20_000
#: Query parameters that do not select content.
IGNORED = r"^(utm_[^=]*|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, user-visible variants of the host, fragment, tracking parameters, last slash."""
    whole = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    rest = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(IGNORED)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers with the permitted ones of ``fresh`` in place of their own."""
    renewed = F.map_filter(fresh, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(renewed), k)), renewed)


def latest_earlier(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (key, t, id, full, what): the rows that aren't full, with ``found``, the what of the last full row before."""
    n = max(1, -(-rows.count() // bucket_rows))
    # written at once: a row's bucket is decided here and nowhere else
    rows = stored(rows.repartitionByRange(n, "key", "t", "full", "id").withColumn("bucket", F.spark_partition_id()), "revisit-buckets")

    full = F.when(F.col("full"), F.struct("t", "id", "what"))
    walk = W.partitionBy("key", "bucket").orderBy("t", "full", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = rows.withColumn("near", F.last(full, ignorenulls=True).over(walk)).filter(~F.col("full"))
    ends = rows.groupBy("key", "bucket").agg(F.max_by(F.when(F.col("full"), F.col("what")), F.when(F.col("full"), F.struct("t", "id"))).alias("end"))
    carry = ends.withColumn("carried", F.last("end", ignorenulls=True).over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    carry = carry.filter("carried IS NOT NULL").select("key", "bucket", "carried")
    return near.join(carry, ["key", "bucket"], "left").withColumn("found", F.coalesce("near.what", "carried")).drop("near", "carried", "bucket", "full")


def with_payloads(found: DataFrame, responses: DataFrame, columns: list[str]) -> DataFrame:
    """found (key, response_id, response_t, status, ...) with the payload of each resolved row's response."""
    bodies = responses.filter("t IS NOT NULL").select(canonical_url(F.col("url")).alias("key"), F.col("id").alias("response_id"), F.col("t").alias("response_t"), "payload")
    place = ["key", "response_id", "response_t"]
    if not bodies.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # stored, so that the join deals it itself and a response of very many revisits can be split
        bodies = stored(bodies.dropDuplicates(place), "revisit-bodies")
    resolved = found.filter("status = 'resolved'").join(bodies, place)
    others = found.filter("status <> 'resolved'").withColumn("payload", F.lit(None).cast("string"))
    return resolved.select(*columns).unionByName(others.select(*columns))


def resolve(responses: DataFrame, revisits: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per revisit: id, key, response_id, status, payload, headers.

    responses and revisits: id long, url string, t long, etag string, modified string,
    headers map<string,string>; responses also payload string.
    """
    fields = ["id", "t", "etag", "modified", "headers"]
    told = responses.filter("t IS NOT NULL").select(canonical_url(F.col("url")).alias("key"), "t", "id", F.lit(True).alias("full"), F.struct(*fields).alias("what"))
    asked = revisits.select(canonical_url(F.col("url")).alias("key"), "t", "id", F.lit(False).alias("full"), F.struct(*fields).alias("what"))
    found = latest_earlier(stored(told.unionByName(asked), "revisit-rows"), bucket_rows)
    found = found.withColumn("found", F.when(F.col("t").isNotNull(), F.col("found")))
    same_tag, same_date = _weak(F.col("what.etag")) == _weak(F.col("found.etag")), F.col("what.modified") == F.col("found.modified")
    agrees = F.coalesce(same_tag, same_date)
    status = F.when(F.col("found").isNull(), "orphan").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    fresh = F.coalesce(F.col("what.headers"), F.create_map().cast("map<string,string>"))
    kept = F.coalesce(F.col("found.headers"), F.create_map().cast("map<string,string>"))
    decided = found.withColumn("status", status).select(
        "id", "key", F.col("found.id").alias("response_id"), F.col("found.t").alias("response_t"), "status",
        F.when(F.col("status") == "resolved", merged_headers(kept, fresh)).alias("headers"),
    )
    return with_payloads(stored(decided, "revisit-decided"), responses, ["id", "key", "response_id", "status", "payload", "headers"])


#: In op8 every page is asked for again so many pages later, and a section has one revision for so many pages.
AGAIN_AFTER, REVISION = 100, 150
_SECTION = r"(?s)^[^:]*://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+/[^/?#]*)"


def records_of_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Capture records of site sections, derived from the table pages.

    A section is the last two labels of a host with the first part of a path, and each of its pages is a
    capture of it: page p is a full response at instant 2p whose payload is the page's html. A section's
    validators, a weak entity tag and a date, tell its revision, which is one for ``REVISION`` pages; one
    response in ten has no tag. At instant 2 (p + AGAIN_AFTER) + 1 the crawler asked for the section again
    with the validators of capture p and was told that nothing changed. One in ten such answers came
    without validators, and one in ten is of a crawl before all captures.
    """
    p, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    turn = F.pmod(p, F.lit(10))
    revision = F.floor(p / REVISION).cast("string")
    of_section = F.regexp_extract(F.coalesce("url", F.lit("")), _SECTION, 1)
    url = F.when(of_section == "", F.col("url")).otherwise(F.concat(F.lit("https://"), of_section))
    tag, date = F.when(turn != 3, F.concat(F.lit("W/r"), revision)), F.concat(F.lit("d"), revision)
    said, asked = p * 2, F.when(turn == 9, -1 - p).otherwise((p + AGAIN_AFTER) * 2 + 1)
    at = lambda t: F.coalesce(F.concat(F.lit("t"), t.cast("string")), F.lit(""))
    full = pages.select(
        p.alias("id"), url.alias("url"), said.alias("t"), tag.alias("etag"), date.alias("modified"),
        F.create_map(F.lit("content-length"), F.length(html).cast("string"), F.lit("date"), at(said), F.lit("server"), F.concat(F.lit("s"), turn.cast("string"))).alias("headers"), html.alias("payload"),
    )
    again = pages.select(
        p.alias("id"), url.alias("url"), asked.alias("t"), F.when(turn != 7, F.regexp_replace(tag, "^W/", "")).alias("etag"), F.when(turn != 7, date).alias("modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), at(asked), F.lit("cache-control"), F.concat(F.lit("max-age="), turn.cast("string"))).alias("headers"),
    )
    return full, again


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved records, with digest and length of the payload in place of the payload."""

    def make() -> DataFrame:
        found = resolve(*records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
        lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
        return found.select(
            F.col("id").alias("page_id"), F.col("key").alias("section"), "response_id", "status", F.sha2("payload", 256).alias("payload_sha256"),
            F.length("payload").cast("long").alias("payload_chars"), lines.alias("headers"),
        )

    return settled(spark, "revisits", make)


OP8_SQL = r"""
WITH u AS (
  SELECT page_id AS p, coalesce(html, '') AS html, page_id % 10 AS turn,
         CAST(floor(page_id / CAST(150 AS DOUBLE)) AS BIGINT) AS revision,
         regexp_extract(coalesce(url, ''), '^[^:]*://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+/[^/?#]*)', 1, 's') AS section
  FROM pages),
k AS (
  SELECT *, regexp_replace(lower(regexp_extract(section, '^[^/?]*')), '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(section, '^[^/?]*(.*)$', 1, 's'), '/+$', '') AS key,
         2 * p AS said, CASE WHEN turn = 9 THEN -1 - p ELSE 2 * (p + 100) + 1 END AS asked
  FROM u),
j AS (
  SELECT a.p, a.key, a.turn, a.asked, a.revision, b.p AS response_id, b.html, b.turn AS b_turn, b.revision AS b_revision, b.said
  FROM k a ASOF LEFT JOIN k b ON a.key = b.key AND a.asked > b.said),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN turn = 7 THEN 'unvalidated'
                 WHEN revision = b_revision THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j)
SELECT p AS page_id, key AS section, response_id, status,
       CASE WHEN status = 'resolved' THEN sha256(html) END AS payload_sha256,
       CASE WHEN status = 'resolved' THEN CAST(length(html) AS BIGINT) END AS payload_chars,
       CASE WHEN status = 'resolved' THEN 'cache-control=max-age=' || turn || ';content-length=' || length(html) || ';date=t' || asked || ';server=s' || b_turn END AS headers
FROM s
"""
