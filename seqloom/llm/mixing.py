"""Operator 9: mixing sources to target weights by Sainte-Lague apportionment.

The size of a document is its number of words. The sources share the total of all sizes by weight;
no target exceeds ``cap`` times what its source holds, the excess is shared anew by weight. The
total is cut into equal-token blocks, and the blocks are allocated as seats by highest quotients
(target / 1, 3, 5, ...): first to sources, then, inside each source, to its shards, which gives an
integer quota per shard. In a shard the documents lie in seeded order on a circle of tokens; the
shard takes as many consecutive blocks as its quota says, from a seeded block on, going around
again where the quota exceeds the shard.

A source is dealt to shards of about ``shard_rows`` rows (65,536 shards at most), so a source that
holds a third of all rows is spread like the others. The rows that meet in one task are those of a
shard, or one row per source, or about 2.5 per shard of a source: the highest quotients need only
be ranked among the seats near each party's ideal share, the seats below are certain.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; an empty table gives an empty result; documents of equal id and size share one
place in the order; a source whose target is below half a block may get no block, so a corpus of fewer
words than half a block has an empty mix; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, settled, table

SEED, BLOCK_TOKENS, SHARD_ROWS, MAX_SHARDS, CAP, WEIGHTS = 17, 32, 1_000, 65_536, 3, 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, cap: float = CAP, weights: int = WEIGHTS) -> DataFrame:
    """Adds place, weight and target to one row per source with source_size.

    The level at which the uncapped sources share is the largest one seen while the sources are
    capped one after the other in order of cap / weight.
    """
    ordered = sources.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ordered = ordered.withColumn("weight", (F.col("place") % weights + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rank = W.orderBy(F.col("most") / F.col("weight"), "place")
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rank.rowsBetween(0, W.unboundedFollowing))
    levelled = ordered.withColumn("level", level)
    return levelled.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(every))).drop("level", "most")


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` seats (a column, the same in a group) dealt by highest quotients.

    Ties go to the party that is first in ``order``. Rounding votes to the nearest seat misses the
    number of seats by half the number of parties at most, so the seats up to
    ideal * (1 - n / 2 seats) - 1/2 are certain and those above ideal * (1 + n / 2 seats) + 1/2
    are not to be had; only the seats between are ranked.
    """
    own = W.partitionBy(*group)
    share = F.col(votes) / F.sum(votes).over(own)
    n, has = F.count(F.lit(1)).over(own), F.sum(votes).over(own) > 0
    banded = parties.withColumn("_share", F.when(has, share).otherwise(F.lit(0.0))).withColumn("_n", n)
    banded = banded.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col(seats) - F.col("_n") / 2) - 1)).cast("long"))
    banded = banded.withColumn("_top", F.ceil(F.col("_share") * (F.col(seats) + F.col("_n") / 2) + 1).cast("long"))
    banded = banded.withColumn("_left", F.col(seats) - F.sum("_sure").over(own))
    seat = banded.filter("_share > 0").select("*", F.explode(F.expr("sequence(_sure + 1, _top)")).alias("_seat"))
    best = W.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_seat") - 1)).desc(), *order, "_seat")
    won = seat.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= F.col("_left"))
    won = won.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_won"))
    keys = list(dict.fromkeys([*group, *order]))
    held = banded.alias("p").join(won.alias("w"), [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], "left")
    return held.select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("p._sure") + F.coalesce("w._won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, cap: int = CAP, weights: int = WEIGHTS, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken, rounds, head, first, run, and ``keys``.

    ``taken`` words of the document are in the mix: ``rounds`` times the whole document, its first
    ``head`` words once more, and ``run`` words from word ``first`` (counted from 0) on once more.
    ``keys`` are columns of docs that tell rows of equal id apart; they come last in the order.
    """
    return settled(docs.sparkSession, "mix", lambda: _mix(docs, id_col, text_col, source_col, seed, block_tokens, shard_rows, cap, weights, keys))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block_tokens: int, shard_rows: int, cap: int, weights: int, keys: tuple[str, ...]) -> DataFrame:
    sizes = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *keys))
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), cap, weights)
    sources = sources.withColumn("blocks", F.round(F.sum("source_size").over(W.partitionBy()) / block_tokens).cast("long")).withColumn("everything", F.lit(0))
    sources = sainte_lague(sources, ["everything"], "target", "blocks", ["place"]).withColumnRenamed("quota", "source_quota")
    sources = checkpointed(sources.withColumn("shards", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_rows") / shard_rows)).cast("long")).drop("blocks", "everything", "source_rows", "weight"))

    digest = _seeded(seed, F.col("d.id"))
    dealt = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    dealt = dealt.select("d.id", "d.source", "d.size", "s.place", "s.source_size", "s.target", "s.source_quota", digest.alias("digest"), (_number(digest) % F.col("s.shards")).alias("shard"), *[F.col(f"d.{k}") for k in keys])
    shards = dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source").alias("source"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, ["place"], "shard_size", "source_quota", ["shard"])
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_tokens)).cast("long")
    shards = shards.withColumn("tokens", F.least(F.col("quota") * block_tokens, F.col("shard_size") * cap)).select(
        "place", "shard", "shard_size", F.expr("CASE WHEN shard_size > 0 THEN tokens div shard_size ELSE 0 END").alias("rounds"),
        F.expr("CASE WHEN shard_size > 0 THEN tokens % shard_size ELSE 0 END").alias("arc"),
        (_number(_seeded(seed, F.col("source"), F.col("shard"))) % n_blocks * block_tokens).alias("start"),
    )

    order = W.partitionBy("place", "shard").orderBy("digest", "id", "size", *keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(order)).withColumn("begin", F.col("end") - F.col("size"))
    laid = laid.join(shards, ["place", "shard"])
    zero, stop = F.lit(0), F.col("start") + F.col("arc")
    ahead = F.greatest(zero, F.least("end", stop) - F.greatest("begin", "start"))
    around = F.greatest(zero, F.least(F.col("end"), stop - F.col("shard_size")) - F.col("begin"))
    return laid.select(
        "id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + ahead + around).alias("taken"), "rounds",
        around.cast("long").alias("head"), F.greatest(F.col("start") - F.col("begin"), zero).cast("long").alias("first"), ahead.cast("long").alias("run"), *keys,
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, least(most, weight * max(level) OVER ()) AS target, CAST(round(sum(source_size) OVER () / CAST(32 AS DOUBLE)) AS BIGINT) AS seats, count(*) OVER () AS parties FROM s3),
a1 AS (SELECT place, target, seats, unnest(generate_series(1, CAST(ceil(target / greatest(1, sum(target) OVER ()) * (seats + parties / CAST(2 AS DOUBLE)) + 2) AS BIGINT))) AS j FROM s4),
a2 AS (SELECT place, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, place, j) AS k FROM a1 WHERE target > 0) WHERE k <= seats GROUP BY place),
s5 AS (SELECT s4.source, s4.place, source_size, target, coalesce(quota, 0) AS source_quota, CAST(least(65536, ceil(n / CAST(1000 AS DOUBLE))) AS BIGINT) AS shards FROM s4 LEFT JOIN a2 ON a2.place = s4.place),
e AS (SELECT d.doc_id, d.size, d.h, s5.*, CAST('0x' || substr(d.h, 1, 8) AS BIGINT) % s5.shards AS shard FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
p AS (SELECT place, shard, source, source_quota, CAST(sum(size) AS BIGINT) AS shard_size FROM e GROUP BY place, shard, source, source_quota),
p1 AS (SELECT *, count(*) OVER (PARTITION BY place) AS parties, sum(shard_size) OVER (PARTITION BY place) AS whole FROM p),
b1 AS (SELECT place, shard, shard_size, source_quota, unnest(generate_series(1, CAST(ceil(shard_size / CAST(greatest(1, whole) AS DOUBLE) * (source_quota + parties / CAST(2 AS DOUBLE)) + 2) AS BIGINT))) AS j FROM p1),
b2 AS (SELECT place, shard, count(*) AS quota
       FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY shard_size / CAST(2 * j - 1 AS DOUBLE) DESC, shard, j) AS k FROM b1 WHERE shard_size > 0) WHERE k <= source_quota GROUP BY place, shard),
q AS (SELECT p.place, p.shard, p.shard_size, least(coalesce(quota, 0) * 32, p.shard_size * 3) AS tokens,
             CAST('0x' || substr(md5('17:' || coalesce(source, '') || ':' || p.shard), 1, 8) AS BIGINT) % CAST(greatest(1, ceil(p.shard_size / CAST(32 AS DOUBLE))) AS BIGINT) * 32 AS start
      FROM p LEFT JOIN b2 ON b2.place = p.place AND b2.shard = p.shard),
q1 AS (SELECT *, CASE WHEN shard_size > 0 THEN tokens // shard_size ELSE 0 END AS rounds, CASE WHEN shard_size > 0 THEN tokens % shard_size ELSE 0 END AS arc FROM q),
l AS (SELECT e.doc_id, e.size, e.source_size, e.target, q1.rounds, q1.arc, q1.start, q1.shard_size,
             sum(e.size) OVER (PARTITION BY e.place, e.shard ORDER BY e.h, e.doc_id, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
      FROM e JOIN q1 ON q1.place = e.place AND q1.shard = e.shard)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(stop, start + arc) - greatest(stop - size, start)) + greatest(0, least(stop, start + arc - shard_size) - (stop - size)) AS BIGINT) AS taken
FROM l
"""
