"""The segment lexicon: inventory, contexts, features, association tests and seeds.

Inputs are segment rows (seq_id, seg_pos, n_segs, seg_key, tokens). Per-segment results come from
aggregates over (segment, side, neighbour) counts; corpus-wide totals are one-row frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import COMMODITY, NAME, TITLE, numeric_like
from ..storage import stored
from ..sources.corpora import by_block, has_long, with_guests
from .stats import percentiles, shannon, with_scalars

EXAMPLES = 10
#: The features of the mixture model, in its order.
MIXTURE_FEATURES = ["freq", "start_prob", "end_prob", "avg_pos", "mean_len", "H_total", "avg_pmi_left", "avg_pmi_right", "numeric_assoc", "burstiness", "idf", "coll_skew"]


#: The order of segments in an inventory: descending freq, then key.
_BY_FREQ = ["_exact", "seg_key"]


def _examples(rows: DataFrame, most: int, *beside: str) -> DataFrame:
    """seg_key, examples: the first places of each segment, and columns beside, which are the same for all its rows. At most ``most``
    a partition and key are kept before the rows are dealt by key, by the limit that Spark puts below a ranking."""
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("seg_key").orderBy("seq_id", "seg_pos"))).filter(F.col("k") <= most)
    places = F.array_sort(F.collect_list(F.struct(F.col("seq_id").alias("seq"), F.col("seg_pos").cast("int").alias("pos"))))
    return first.groupBy("seg_key").agg(places.alias("examples"), *[F.first(c).alias(c) for c in beside])


def top_examples(rows: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """seg_key, seq, pos of the first places of each segment."""
    return _examples(rows, most).select("seg_key", F.explode("examples").alias("e")).select("seg_key", "e.seq", "e.pos")


def inventory(rows: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """seg_key, seg_id, tokens (if the rows have them), freq, examples. seg_id counts by (freq descending, key). Tokens come with the
    examples: with an array beside it, the count of all rows would be taken by sorting them."""
    counted = rows.groupBy("seg_key").agg(F.count(F.lit(1)).alias("freq"))
    tokens = [c for c in rows.columns if c == "tokens"]
    return numbered(counted, _BY_FREQ).join(_examples(rows, most, *tokens), "seg_key").select("seg_key", "seg_id", *tokens, "freq", "examples")


def numbered(counted: DataFrame, order: list) -> DataFrame:
    """Adds seg_id, a place in a total order.

    Rows are dealt by ranges of the order and numbered inside a range, after the rows of the ranges before it, so no
    task sees all rows, however many there are of one freq. A range is sorted when it is dealt and its rows are counted as they
    come (an increasing id has the range in its upper bits and the place in its lower 33), so ranges aren't dealt again.
    """
    dealt = counted.withColumn("_exact", -F.col("freq")).repartitionByRange(*order).sortWithinPartitions(*order)
    part = stored(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = part.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each range
    ranked = part.join(F.broadcast(starts), "_part")
    return ranked.withColumn("seg_id", F.format_string("seg_%05d", F.col("_start") + F.col("_in") + 1)).drop("_exact", "_id", "_part", "_start", "_in")


def contexts(rows: DataFrame) -> DataFrame:
    """seg_key, side (left, right), nbr, n: neighbours in the same sequence. rows may name the segment before in ``before``."""
    if "before" in rows.columns:
        back = rows.select(F.lit(False).alias("guest"), F.col("seg_key").alias("b"), F.col("before").alias("a"))
    else:
        back = with_guests(rows.select("seq_id", "seg_pos", "n_segs", "seg_key"), 1, "seg_pos", "n_segs", long=has_long(rows, "n_segs")).select("guest", F.col("seg_key").alias("b"), F.lag("seg_key").over(by_block("seg_pos")).alias("a"))
    pairs = back.filter("a IS NOT NULL AND NOT guest").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(
        F.struct(F.col("b").alias("seg_key"), F.lit("left").alias("side"), F.col("a").alias("nbr")), F.struct(F.col("a").alias("seg_key"), F.lit("right").alias("side"), F.col("b").alias("nbr"))
    )
    return pairs.select(F.explode(both).alias("c"), "n").select("c.seg_key", "c.side", "c.nbr", "n")


def _per_side(ctx: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """seg_key, side, nbr, n, total: counts with the total of their segment and side.

    With counts (of all segments: seg_key, freq, starts, ends) totals need no sums over ctx: a segment has a left
    neighbour wherever it is not the first, and a right one wherever it is not the last.
    """
    if counts is not None:
        total = F.col("freq") - F.when(F.col("side") == "left", F.col("starts")).otherwise(F.col("ends"))
        return ctx.join(counts.select("seg_key", "freq", "starts", "ends"), "seg_key").select("seg_key", "side", "nbr", "n", total.alias("total"))
    totals = ctx.groupBy("seg_key", "side").agg(F.sum("n").alias("total"))
    return ctx.join(totals, ["seg_key", "side"])


def side_entropy(ctx: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """seg_key, H_left, H_right, H_total in nats, and coll_skew, the mean concentration of the sides. counts: as for ``_per_side``."""
    p = F.col("n") / F.col("total")
    own = _per_side(ctx, counts).groupBy("seg_key", "side").agg(F.sum(shannon(F.col("n"), F.col("total"))).alias("h"), F.sum(p * p).alias("hhi"))
    of = lambda side, value: F.coalesce(F.max(F.when(F.col("side") == side, F.col(value))), F.lit(0.0))
    return own.groupBy("seg_key").agg(
        of("left", "h").alias("H_left"), of("right", "h").alias("H_right"), (of("left", "h") + of("right", "h")).alias("H_total"), (0.5 * (of("left", "hhi") + of("right", "hhi"))).alias("coll_skew")
    )


def segment_counts(rows: DataFrame) -> DataFrame:
    """seg_key, tokens, freq, docfreq, squares, starts, ends, avg_pos. squares: the sum over sequences of squared counts."""
    place = F.col("seg_pos") / F.greatest(F.lit(1), F.col("n_segs") - 1)
    per = rows.groupBy("seg_key", "seq_id").agg(
        F.count(F.lit(1)).alias("c"), F.first("tokens").alias("tokens"), F.count_if(F.col("seg_pos") == 0).alias("starts"), F.count_if(F.col("seg_pos") == F.col("n_segs") - 1).alias("ends"), F.sum(place).alias("places"),
    )
    return per.groupBy("seg_key").agg(
        F.first("tokens").alias("tokens"), F.sum("c").alias("freq"), F.count(F.lit(1)).alias("docfreq"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), (F.sum("places") / F.sum("c")).alias("avg_pos"),
    )


def segment_frequencies(rows: DataFrame) -> DataFrame:
    """seg_key, freq, starts, ends and numeric (whether it looks like a number): what one count by segment gives, without
    the count by sequence that ``segment_counts`` starts from."""
    return rows.groupBy("seg_key").agg(
        F.count(F.lit(1)).alias("freq"), F.count_if(F.col("seg_pos") == 0).alias("starts"), F.count_if(F.col("seg_pos") == F.col("n_segs") - 1).alias("ends"), F.first(numeric_like(F.col("tokens"))).alias("numeric")
    )


def average_pmi(ctx: DataFrame, counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """seg_key, avg_pmi_left, avg_pmi_right: unweighted means over distinct neighbours; 0 without any."""
    uni = counts.agg(F.sum("freq").cast("double").alias("n1"), F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("v"))
    big = ctx.filter(F.col("side") == "right").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n2"))
    named = ctx.join(counts.select("seg_key", F.col("freq").alias("fx")), "seg_key").join(counts.select(F.col("seg_key").alias("nbr"), F.col("freq").alias("fy")), "nbr")
    named = with_scalars(with_scalars(named, uni), big)
    share = lambda c: F.log((F.col(c) + alpha) / (F.col("n1") + alpha * F.col("v")))
    pmi = F.log((F.col("n") + alpha) / (F.col("n2") + alpha * F.col("v") * F.col("v"))) - share("fx") - share("fy")
    means = named.groupBy("seg_key").agg(*[F.avg(F.when(F.col("side") == s, pmi)).alias(f"avg_pmi_{s}") for s in ("left", "right")])
    found = counts.select("seg_key").join(means, "seg_key", "left")
    return found.select("seg_key", *[F.coalesce(f"avg_pmi_{s}", F.lit(0.0)).alias(f"avg_pmi_{s}") for s in ("left", "right")])


def context_features(ctx: DataFrame, counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``side_entropy``, ``average_pmi`` and ``numeric_association`` of segments that have neighbours, in one pass.

    ctx is shuffled twice, by neighbour and by segment. Totals of a side need no sums over ctx: a segment has a left
    neighbour wherever it is not the first, and a right one wherever it is not the last.
    """
    uni = counts.agg(
        F.sum("freq").cast("double").alias("n1"), F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("v"), F.coalesce(F.sum(F.col("freq") - F.col("ends")), F.lit(0)).cast("double").alias("n2")
    )
    beside = counts.select(F.col("seg_key").alias("nbr"), F.col("freq").alias("fy"), numeric_like(F.col("tokens")).alias("numeric"))
    own = counts.select("seg_key", F.col("freq").alias("fx"), "starts", "ends")
    named = with_scalars(ctx.join(beside, "nbr").join(own, "seg_key"), uni)
    left = F.col("side") == "left"
    total = F.col("fx") - F.when(left, F.col("starts")).otherwise(F.col("ends"))
    p = F.col("n") / total
    share = lambda c: F.log((F.col(c) + alpha) / (F.col("n1") + alpha * F.col("v")))
    pmi = F.log((F.col("n") + alpha) / (F.col("n2") + alpha * F.col("v") * F.col("v"))) - share("fx") - share("fy")
    values = named.select("seg_key", left.alias("left"), "n", "numeric", shannon(F.col("n"), total).alias("h"), (p * p).alias("hhi"), pmi.alias("pmi"))
    of = lambda side, f, c: f(F.when(F.col("left") == F.lit(side), F.col(c)))
    sums = values.groupBy("seg_key").agg(
        *[F.coalesce(of(side, F.sum, c), F.lit(0.0)).alias(f"{c}_{side}") for side in (True, False) for c in ("h", "hhi")], *[F.coalesce(of(side, F.avg, "pmi"), F.lit(0.0)).alias(f"pmi_{side}") for side in (True, False)],
        F.sum(F.when(F.col("numeric"), F.col("n")).otherwise(F.lit(0))).alias("num_adj"), F.sum("n").alias("total_adj"),
    )
    return sums.select(
        "seg_key", F.col("h_True").alias("H_left"), F.col("h_False").alias("H_right"), (F.col("h_True") + F.col("h_False")).alias("H_total"), (0.5 * (F.col("hhi_True") + F.col("hhi_False"))).alias("coll_skew"),
        F.col("pmi_True").alias("avg_pmi_left"), F.col("pmi_False").alias("avg_pmi_right"), (F.col("num_adj") / F.greatest(F.lit(1), F.col("total_adj"))).alias("numeric_assoc"),
    )


def numeric_neighbours(ctx: DataFrame, counts: DataFrame) -> DataFrame:
    """seg_key, num_adj, total_adj for every segment: neighbours that look like numbers, and all. counts: of segments, with ``tokens`` or ``numeric``."""
    numeric = F.col("numeric") if "numeric" in counts.columns else numeric_like(F.col("tokens"))
    flags = counts.select(F.col("seg_key").alias("nbr"), numeric.alias("numeric"))
    own = ctx.join(flags, "nbr").groupBy("seg_key").agg(F.sum(F.when(F.col("numeric"), F.col("n")).otherwise(F.lit(0))).alias("num_adj"), F.sum("n").alias("total_adj"))
    return counts.select("seg_key").join(own, "seg_key", "left").select("seg_key", F.coalesce("num_adj", F.lit(0)).alias("num_adj"), F.coalesce("total_adj", F.lit(0)).alias("total_adj"))


def numeric_association(adjacent: DataFrame) -> DataFrame:
    return adjacent.select("seg_key", (F.col("num_adj") / F.greatest(F.lit(1), F.col("total_adj"))).alias("numeric_assoc"))


def _with_all(adjacent: DataFrame) -> DataFrame:
    return with_scalars(adjacent, adjacent.agg(F.sum("num_adj").alias("all_num"), F.sum("total_adj").alias("all_adj")))


def log_odds(adjacent: DataFrame, k: float = 0.5) -> DataFrame:
    """seg_key, log_odds: of a number beside the segment against beside the others."""
    non, all_non = F.col("total_adj") - F.col("num_adj"), F.col("all_adj") - F.col("all_num")
    a, b = F.col("num_adj") + k, non + k
    c, d = F.greatest(F.lit(0.0), F.col("all_num") - F.col("num_adj")) + k, F.greatest(F.lit(0.0), all_non - non) + k
    return _with_all(adjacent).select("seg_key", F.log(a * d / (b * c) + 1e-300).alias("log_odds"))


def g2(adjacent: DataFrame) -> DataFrame:
    """seg_key, g2: likelihood ratio of the segment's share of numbers against the corpus's."""
    p, q = F.try_divide("num_adj", "total_adj"), F.try_divide("all_num", "all_adj")
    value = 2.0 * F.col("total_adj") * (p * F.log(F.try_divide(p, q)) + (1 - p) * F.log(F.try_divide(1 - p, 1 - q)))
    inner = (F.col("total_adj") > 0) & (p > 0) & (p < 1) & (q > 0) & (q < 1)
    return _with_all(adjacent).select("seg_key", F.when(inner, value).otherwise(F.lit(0.0)).alias("g2"))


def burstiness_and_idf(counts: DataFrame, sequences: DataFrame) -> DataFrame:
    """seg_key, burstiness, idf. sequences: one row with ``n``, the number of sequences."""
    mean = F.col("freq") / F.col("n")
    variance = F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean)
    return with_scalars(counts, sequences).select("seg_key", (variance / (mean + 1e-12)).alias("burstiness"), F.log((F.col("n") + 1) / (F.col("docfreq") + 1)).alias("idf"))


def sequence_count(rows: DataFrame) -> DataFrame:
    """One row: n, the number of sequences that have segments."""
    return rows.filter("seg_pos = 0").agg(F.count(F.lit(1)).alias("n"))


def feature_matrix(rows: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """One row per segment with all its features, seg_id and first examples."""
    counts = stored(segment_counts(rows), "counts")
    sequences = sequence_count(rows) if sequences is None else sequences
    base = counts.select(
        "seg_key", "tokens", "freq", "docfreq", (F.col("starts") / F.greatest(F.lit(1), F.col("freq"))).alias("start_prob"), (F.col("ends") / F.greatest(F.lit(1), F.col("freq"))).alias("end_prob"),
        F.coalesce("avg_pos", F.lit(0.5)).alias("avg_pos"), F.size("tokens").cast("double").alias("mean_len"),
    )
    wide = base.join(context_features(contexts(rows), counts), "seg_key", "left").join(burstiness_and_idf(counts, sequences), "seg_key")
    wide = wide.fillna(0.0, ["H_left", "H_right", "H_total", "coll_skew", "avg_pmi_left", "avg_pmi_right", "numeric_assoc"])
    ids = numbered(counts.select("seg_key", "freq"), _BY_FREQ).select("seg_key", "seg_id")
    return wide.join(ids, "seg_key").join(_examples(rows, EXAMPLES), "seg_key")


def seeds(matrix: DataFrame) -> DataFrame:
    """seg_key and whether it is a seed of each class; a segment may be one of several."""
    marks = percentiles(matrix, {"freq": [0.5], "H_total": [0.6]})
    mid, high = (F.lit(marks[c][0]).cast("double") for c in ("freq", "H_total"))
    return matrix.select(
        "seg_key",
        ((F.col("numeric_assoc") >= 0.6) & (F.col("freq") >= mid)).alias(COMMODITY),
        ((F.col("start_prob") >= 0.6) & (F.col("coll_skew") >= 0.12)).alias(TITLE),
        ((F.col("freq") <= mid) & (F.col("H_total") >= high)).alias(NAME),
    )


def seed_precision(labels: DataFrame, seed: DataFrame) -> DataFrame:
    """label, precision_proxy, recall_proxy, tp, pred_count, seed_count; null rates without seeds.

    labels: seg_key, label.
    """
    joined = seed.join(labels, "seg_key", "left")
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("seed"), F.coalesce(F.col("label") == x, F.lit(False)).alias("pred")) for x in (COMMODITY, TITLE, NAME)]))
    per = joined.select(rows.alias("r")).groupBy("r.label").agg(
        F.count_if(F.col("r.seed") & F.col("r.pred")).alias("tp"), F.count_if("r.pred").alias("pred_count"), F.count_if("r.seed").alias("seed_count")
    )
    rate = lambda n: F.when(F.col("seed_count") > 0, F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(F.lit(0.0)))
    return per.select("label", rate("pred_count").alias("precision_proxy"), rate("seed_count").alias("recall_proxy"), "tp", "pred_count", "seed_count")


def rule_labels(seed: DataFrame) -> DataFrame:
    """seg_key, label by the seeds (seg_key and one column a class) alone, where a label is needed without the mixture:
    numbers first, then titles, else names."""
    return seed.select("seg_key", F.when(F.col(COMMODITY), COMMODITY).when(F.col(TITLE), TITLE).otherwise(NAME).alias("label"))


def robust_scale(matrix: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(x - median) / (P75 - P25) of each column; a range below 1e-9 counts as 1."""
    marks = percentiles(matrix, dict.fromkeys(columns, [0.25, 0.5, 0.75]))

    def scaled(c: str) -> Column:
        low, mid, high = (F.lit(q).cast("double") for q in marks[c])
        return ((F.col(c) - mid) / F.when(high - low < 1e-9, F.lit(1.0)).otherwise(high - low)).alias(c)

    return matrix.select(*keep, *[scaled(c) for c in columns])


def coverage(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how many positions and sequences have a segment with one of the three labels."""
    known = labels.filter(F.col("label").isin(COMMODITY, TITLE, NAME)).select("seg_key", F.lit(1).alias("hit"))
    per = rows.join(known, "seg_key", "left").groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return per.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("covered_positions"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_positions"),
        (F.coalesce(F.sum("hits"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0))) * 100.0).alias("pct"), F.count_if(F.col("hits") > 0).alias("sequences_with_any"), F.count(F.lit(1)).alias("total_sequences"),
    )


def representatives(labelled: DataFrame, most: int = 30) -> DataFrame:
    """label, place, seg_key, ...: the segments that stand for a label, best first, ties by seg_id.

    labelled: seg_key, seg_id, freq, label, post_commodity, post_title, post_proper_name.
    """
    rank = F.when(F.col("label") == COMMODITY, F.col("post_commodity") * F.log1p("freq")).when(F.col("label") == TITLE, F.col("post_title") * F.log1p("freq")).otherwise(F.col("post_proper_name") / (1 + F.col("freq")))
    scored = labelled.withColumn("score", rank)
    place = F.row_number().over(W.partitionBy("label").orderBy(F.col("score").desc(), "seg_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= most)


def categories(matrix: DataFrame, labelled: DataFrame, adjacent: DataFrame, stable: DataFrame) -> DataFrame:
    """Each segment's features with component, label and posteriors, both association tests and stability.

    labelled, adjacent and stable: of the mixture, of ``numeric_neighbours`` and of the jackknife.
    """
    tests = log_odds(adjacent).withColumnRenamed("log_odds", "log_odds_num_adj").join(g2(adjacent).withColumnRenamed("g2", "g2_num_adj"), "seg_key")
    return matrix.join(labelled.drop("seg_id", "freq"), "seg_key").join(tests, "seg_key").join(stable, "seg_key")


def summary(labelled: DataFrame, rows: DataFrame, seed_rates: DataFrame, most: int = 30, sequences: DataFrame | None = None) -> DataFrame:
    """One row: n_segments, n_sequences, class_counts, avg_posteriors, seed_evaluation, representatives
    and coverage of a lexicon. Lists hold three labels and ``most`` segments of each."""
    classes = (COMMODITY, TITLE, NAME)
    by_class = lambda f: F.create_map(*[x for c in classes for x in (F.lit(c), f(c))])
    one = labelled.agg(
        F.count(F.lit(1)).alias("n_segments"), by_class(lambda c: F.count_if(F.col("label") == c)).alias("class_counts"), by_class(lambda c: F.avg(f"post_{c}")).alias("avg_posteriors")
    )
    as_map = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    rates = seed_rates.agg(as_map("label", F.struct("precision_proxy", "recall_proxy", "tp", "pred_count", "seed_count").alias("rates")).alias("seed_evaluation"))
    fields = ["seg_key", "seg_id", "freq", *[f"post_{c}" for c in classes]]
    best = representatives(labelled, most).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("best"))
    best = best.agg(as_map("label", F.col("best")).alias("representatives"))
    covered = coverage(rows, labelled.select("seg_key", "label"))
    found = with_scalars(one, (sequence_count(rows) if sequences is None else sequences).withColumnRenamed("n", "n_sequences"))
    return with_scalars(with_scalars(with_scalars(found, rates), best), covered.select(F.struct("*").alias("coverage")))
