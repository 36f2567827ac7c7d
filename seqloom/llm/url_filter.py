"""Operator 6: URL filters by host suffix and path prefix.

Each distinct (host, path) is expanded into expressions: every suffix of its host that has no more
labels than the longest rule, with every prefix of its path that is as long as some rule's path.
The expressions equi-join the rules on the first ``PREFIX_HEX`` digits of their SHA-256; the full
digests then confirm, and the longest rule wins (of equally long ones the first in code-point
order). Verdicts come back to the rows by (host, path).

Hot hosts cost one row per distinct path, whatever their number of rows; the join back is a left
join of one row per key, which adaptive execution splits where a key is hot.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets
the default verdict; repeated rows come back repeated; an empty table gives an empty result;
further columns are ignored; very long urls are read whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PREFIX_HEX = 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict. rules: host, path, verdict."""
    # two small facts about the rule list: its longest host, and how long its paths are
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"] or [])

    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    split = F.split("host", r"\.")
    suffixes = F.expr(f"transform(sequence(1, least({labels}, size(_labels))), i -> array_join(slice(_labels, size(_labels) - i + 1, i), '.'))")
    places = rows.filter("host <> ''").select("host", "path").distinct().withColumn("_labels", split)
    expanded = places.select("host", "path", F.explode(suffixes).alias("_suffix")).select(
        "host", "path", "_suffix", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))).alias("_n")
    )
    expression = F.concat("_suffix", F.expr("left(path, _n)"))
    expanded = expanded.select("host", "path", F.sha2(expression, 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    ruled = rules.select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("says"), F.sha2(F.concat("host", "path"), 256).alias("full")
    ).withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    hits = expanded.join(ruled, "prefix").filter(F.col("digest") == F.col("full"))
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "says"), F.struct(-F.length("rule"), F.col("rule"), F.col("says"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark)).withColumnRenamed("id", "page_id")


OP6_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
         row_number() OVER () AS line
  FROM pages),
r(rhost, rpath, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.line, rhost || rpath AS rule, says,
         row_number() OVER (PARTITION BY p.line ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, m.rule, coalesce(m.says, 'allow') AS verdict
FROM p LEFT JOIN m ON p.line = m.line AND m.k = 1
"""
