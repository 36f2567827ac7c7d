"""Corpora of symbol sequences as (seq_id, pos, sym, len) rows.

A corpus row is one symbol; ``pos`` counts from 0 in its sequence of ``len`` symbols. Windows run over blocks of
``BLOCK`` places of a sequence, so a long one is spread over tasks: rows near a border are guests in the block beyond it,
where lags and leads reach them, and what depends on a whole sequence is summed up by block and carried on.
Sequences of one block, which nearly all are, have no guests and nothing to carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


#: Places of a sequence that a window holds.
BLOCK = 4_096
#: Buckets of orders that are named to a filter; beyond them all orders are counted.
CROWDED = 100


def block_of(place: str = "pos", block: int | None = None) -> Column:
    return F.floor(F.col(place) / (block or BLOCK))


def by_block(place: str = "pos") -> WindowSpec:
    """Inside a block of ``with_guests``, in order."""
    return W.partitionBy("seq_id", "block").orderBy(place)


def has_long(rows: DataFrame, size: str = "len") -> bool:
    """Whether a sequence has several blocks. On a stored corpus that takes the statistics of its files."""
    return not rows.filter(F.col(size) > BLOCK).isEmpty()


def with_guests(rows: DataFrame, reach: int, place: str = "pos", size: str = "len", block: int | None = None, long: bool = True) -> DataFrame:
    """rows with block and guest: each in its own block, and as a guest in the neighbouring one if that is at most
    ``reach`` places away. long: whether a sequence may have several blocks; without any there are no guests."""
    if not long:
        return rows.withColumn("block", F.lit(0).cast("long")).withColumn("guest", F.lit(False))
    block = block or BLOCK
    own, inside = block_of(place, block), F.col(place) % block
    before = F.when((inside < reach) & (own > 0), own - 1)
    after = F.when((inside >= block - reach) & (own < F.floor((F.col(size) - 1) / block)), own + 1)
    every = F.when(F.col(size) <= block, F.array(own)).otherwise(F.filter(F.array(own, before, after), lambda b: b.isNotNull()))
    return rows.withColumn("block", F.explode(every)).withColumn("guest", F.col("block") != own)


def carried(rows: DataFrame, total: Column, place: str = "pos", size: str = "len", block: int | None = None) -> DataFrame:
    """seq_id, block, carried: the sum of ``total`` over the blocks before, for blocks of sequences that have several."""
    of = rows.filter(F.col(size) > (block or BLOCK)).groupBy("seq_id", block_of(place, block).alias("block")).agg(total.alias("own"))
    before = W.partitionBy("seq_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return of.select("seq_id", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("carried"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_corpus(rows: DataFrame, seq, order: list, sym) -> DataFrame:
    """A corpus of rows that have a total order inside each sequence."""
    named = rows.select(seq.alias("seq_id"), sym.alias("sym"), *[F.col(c) if isinstance(c, str) else c for c in order])
    own = W.partitionBy("seq_id")
    return named.select(
        "seq_id", (F.row_number().over(own.orderBy(*order)) - 1).alias("pos"), "sym", F.count(F.lit(1)).over(own).alias("len")
    )


#: Lines that agree in these have the same symbol, so whatever their order, the sequence is the same.
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence per order: the suppliers of its lines. Closest to short inscriptions."""
    return ordered_corpus(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), _LINE_ORDER, F.col("l_suppkey"))


def long_orders(spark: SparkSession, sf_dir: str) -> bool:
    """Whether an order has more lines than a block holds.

    Lines are counted by buckets of orders, 4 for each block that they fill. Only if a bucket has more than a block are its orders counted
    one by one, so as a rule a few counts are shuffled where there would be one for each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    buckets = 4 * (lines.count() // BLOCK + 1)
    dealt = lines.withColumn("bucket", F.pmod(F.xxhash64("l_orderkey"), F.lit(buckets)))
    crowded = [r["bucket"] for r in dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("bucket").limit(CROWDED + 1).collect()]
    if not crowded:
        return False
    inside = dealt.filter(F.col("bucket").isin(crowded)) if len(crowded) <= CROWDED else dealt
    return not inside.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).isEmpty()


def order_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, symbols: ``order_lines`` with a sequence in each row, where none is longer than a block.

    Lines are dealt by order first: an order's lines lie apart, so lists of each task would be about as many as lines."""
    dealt = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq_id"), *_LINE_ORDER).repartition("seq_id")
    lines = dealt.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct(*_LINE_ORDER))).alias("lines"))
    return lines.select("seq_id", F.col("lines.l_suppkey").alias("symbols"))


def array_corpus(sequences: DataFrame, seq_col: str = "seq_id", symbols_col: str = "symbols") -> DataFrame:
    """A corpus of sequences that are held as arrays; empty and null arrays have no rows."""
    return sequences.select(F.col(seq_col).alias("seq_id"), F.posexplode(symbols_col).alias("pos", "sym"), F.size(symbols_col).cast("long").alias("len"))
