"""Symbol statistics of a corpus: frequencies, positional entropy, n-grams and their association."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import safe_log
from ..sources.corpora import by_block, with_guests
from ..storage import stored


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a frame that is one row by construction (a global aggregate)."""
    return df.crossJoin(F.broadcast(one_row))


def symbol_counts(corpus: DataFrame) -> DataFrame:
    """sym, n, starts, ends."""
    return corpus.groupBy("sym").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == 0).alias("starts"), F.count_if(F.col("pos") == F.col("len") - 1).alias("ends")
    )


def distribution_score(corpus: DataFrame) -> DataFrame:
    """sym, score: the share of a symbol among all symbols."""
    counts = corpus.groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    return with_scalars(counts, corpus.agg(F.count(F.lit(1)).alias("total"))).select("sym", (F.col("n") / F.col("total")).alias("score"))


def positional_entropy(corpus: DataFrame) -> DataFrame:
    """sym, entropy: of its absolute positions, in bits, over log2 of the longest sequence.

    From sums alone: H = log2 N - (sum of n log2 n) / N over the counts n of a symbol's positions.
    """
    at = corpus.groupBy("sym", "pos").agg(F.count(F.lit(1)).alias("n"))
    return entropy_of_positions(at, corpus.agg(F.max("len").alias("longest")))


def entropy_of_positions(at: DataFrame, longest: DataFrame) -> DataFrame:
    """sym, entropy of counts (sym, pos, n); longest: one row with the length of the longest sequence."""
    own = at.groupBy("sym").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    bits = F.greatest(F.lit(0.0), F.log2("total") - F.col("weighted") / F.col("total"))
    return with_scalars(own, longest).select("sym", F.coalesce(F.try_divide(bits, F.log2("longest")), F.lit(0.0)).alias("entropy"))


def ngrams(corpus: DataFrame, n: int) -> DataFrame:
    """seq_id, pos (of the first symbol), and the symbols a, b, ... of each n-gram inside a sequence."""
    names = "abcdefgh"[:n]
    ahead = [F.lead("sym", k).over(by_block()).alias(names[k]) if k else F.col("sym").alias(names[0]) for k in range(n)]
    found = with_guests(corpus, n - 1).select("seq_id", "pos", "len", "guest", *ahead)
    return found.filter(~F.col("guest") & (F.col("pos") + n <= F.col("len"))).drop("len", "guest")


def ngram_counts(corpus: DataFrame, n: int) -> DataFrame:
    names = "abcdefgh"[:n]
    return ngrams(corpus, n).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def placed(corpus: DataFrame, long: bool = True) -> DataFrame:
    """seq_id, pos, len, sym with s1 and s2, the symbols one and two places before."""
    back = [F.lag("sym", k).over(by_block()).alias(f"s{k}") for k in (1, 2)]
    return with_guests(corpus, 2, long=long).select("seq_id", "pos", "len", "sym", "guest", *back).filter(~F.col("guest")).drop("guest")


def gram_counts(rows: DataFrame) -> DataFrame:
    """kind, a, b, c, at, n, starts, ends of ``placed`` rows, counted in one pass and one shuffle.

    kind 1, 2, 3: symbols, pairs and triples (a, b, c); kind 0: symbols (a) by position (at).
    """
    kinds = {"sym": rows.schema["sym"].dataType, "pos": rows.schema["pos"].dataType}
    none, nowhere = F.lit(None).cast(kinds["sym"]), F.lit(None).cast(kinds["pos"])
    row = lambda kind, a, b, c, at: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"), at.alias("at"))
    sym, s1, s2 = F.col("sym"), F.col("s1"), F.col("s2")
    every = F.array(
        row(1, sym, none, none, nowhere), row(0, sym, none, none, F.col("pos")),
        F.when(F.col("pos") >= 1, row(2, s1, sym, none, nowhere)), F.when(F.col("pos") >= 2, row(3, s2, s1, sym, nowhere)),
    )
    each = rows.select("pos", "len", F.explode(every).alias("g")).filter("g IS NOT NULL").select("pos", "len", "g.*")
    first, last = (F.col("kind") == 1) & (F.col("pos") == 0), (F.col("kind") == 1) & (F.col("pos") == F.col("len") - 1)
    return each.groupBy("kind", "a", "b", "c", "at").agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("starts"), F.count_if(last).alias("ends"))


def percentiles(rows: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact percentiles, interpolated, of some columns: column -> shares to column -> values (None without values).

    Values are counted, their counts dealt by ranges of (column, value), and the ranges' totals say in which of them a
    rank lies; only there is it looked up. A task holds a range of distinct values, never a column.
    """
    columns = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])).alias("e")
    counts = rows.select(each).select("e.column", "e.value").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()), "percentiles")
    sizes: dict[int, list] = {}
    for r in ranged.groupBy("column", "part").agg(F.sum("n").alias("n")).orderBy("column", "part").collect():
        sizes.setdefault(r["column"], []).append((r["part"], r["n"]))
    asked, spots = set(), {}
    for i, c in enumerate(columns):
        total = sum(n for _, n in sizes.get(i, []))
        for share in wanted[c] if total else []:
            spot = share * (total - 1)
            spots[i, share] = spot, math.floor(spot), math.ceil(spot)
            for rank in spots[i, share][1:]:
                start = 0
                for part, n in sizes[i]:
                    if rank < start + n:
                        asked.add((i, part, start, rank))
                        break
                    start += n
    at: dict[tuple[int, int], float] = {}
    if asked:
        ranks = rows.sparkSession.createDataFrame(sorted(asked), "column int, part int, start long, rank long")
        running = F.sum("n").over(W.partitionBy("column", "part").orderBy("value"))
        # as many ranks as shares are asked for, twice
        met = ranged.join(F.broadcast(ranks.select("column", "part").distinct()), ["column", "part"], "left_semi").withColumn("up_to", running)
        met = met.join(F.broadcast(ranks), ["column", "part"])
        hit = (F.col("start") + F.col("up_to") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("up_to"))
        at = {(r["column"], r["rank"]): r["value"] for r in met.filter(hit).select("column", "rank", "value").collect()}

    def value(i: int, share: float) -> float | None:
        if (i, share) not in spots:
            return None
        spot, low, high = spots[i, share]
        return at[i, low] if low == high else (high - spot) * at[i, low] + (spot - low) * at[i, high]

    return {c: [value(i, share) for share in wanted[c]] for i, c in enumerate(columns)}


def npmi(grams: DataFrame, symbols: DataFrame, n: int, alpha: float = 1.0, places: DataFrame | None = None) -> DataFrame:
    """Adds ``npmi`` to n-gram counts (a, b, ..., n): smoothed, normalized pointwise mutual information.

    symbols: sym, n. places: rows whose ``n`` sum up to that of the n-grams, where they are easier to sum up.
    """
    names = "abcdefgh"[:n]
    uni = symbols.agg(F.greatest(F.sum("n"), F.lit(1)).cast("double").alias("n1"), F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("v"))
    total = (grams if places is None else places).agg(F.greatest(F.sum("n"), F.lit(1)).cast("double").alias("nn"))
    joined = grams.withColumnRenamed("n", "count")
    for x in names:
        joined = joined.join(symbols.select(F.col("sym").alias(x), F.col("n").alias(f"n_{x}")), x)
    joined = with_scalars(with_scalars(joined, uni), total)
    own = F.log((F.col("count") + alpha) / (F.col("nn") + alpha * F.pow("v", F.lit(float(n)))))
    apart: Column = F.lit(0.0)
    for x in names:
        apart = apart + F.log((F.col(f"n_{x}") + alpha) / (F.col("n1") + alpha * F.col("v")))
    value = F.when(-own <= 1e-12, F.lit(0.0)).otherwise((own - apart) / -own)
    return joined.select(*names, F.col("count").alias("n"), value.alias("npmi"))


def shannon(counts: Column, total: Column) -> Column:
    """A summand of entropy in nats, guarded as its users expect."""
    p = counts / total
    return -p * safe_log(p + 1e-300)


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, n: equal bins from the least to the largest value, empty ones too.

    The largest value belongs to the last bin; where all are equal the bins span one around them;
    without values all bins are empty and have no ends.
    """
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    apart = F.when(F.col("low") == F.col("high"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = ends.select((F.col("low") - apart).alias("low"), (F.col("high") + apart).alias("high"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * bins))
    counts = with_scalars(values.select(column).filter(F.col(column).isNotNull()), ends).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = with_scalars(values.sparkSession.range(bins).select(F.col("id").alias("bin")), ends).join(counts, "bin", "left")
    edge = lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / bins
    return every.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
