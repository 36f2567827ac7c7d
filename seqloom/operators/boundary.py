"""Candidate boundaries, their features, detectors, and the segments that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clip01, normal_cdf
from ..sources.corpora import BLOCK, block_of, by_block, carried, has_long, with_guests
from ..storage import settled, stored
from .stats import entropy_of_positions, gram_counts, ngram_counts, npmi, placed, symbol_counts, with_scalars

N_FEATURES = 13
FEATURES = [f"f{i}" for i in range(N_FEATURES)]


def features(corpus: DataFrame, entropy: DataFrame | None = None, diversity: DataFrame | None = None, alpha: float = 1.0) -> DataFrame:
    """seq_id, pos and f0..f12 of ``_features``, stored; what is written on the way is deleted."""
    return settled(corpus.sparkSession, "features", lambda: _features(corpus, entropy, diversity, alpha))


def _features(corpus: DataFrame, entropy: DataFrame | None, diversity: DataFrame | None, alpha: float) -> DataFrame:
    """seq_id, pos and f0..f12 for each candidate boundary, before position pos >= 1.

    entropy and diversity: (sym, value); by default the corpus's own positional entropy and shares.
    All counts come from one pass. Every statistic is joined once to the position it belongs to and reaches the
    neighbouring candidates by windows over blocks of a sequence: three joins and one return to sequence order in all.
    """
    long = has_long(corpus)
    here = stored(placed(corpus, long), "placed")
    grams = stored(gram_counts(here), "grams")
    # symbols are stored by themselves, so that their size is known and joins send them to all tasks while they are few
    symbols = stored(grams.filter("kind = 1").select(F.col("a").alias("sym"), "n", "starts", "ends"), "symbols")
    if entropy is None:
        at = grams.filter("kind = 0").select(F.col("a").alias("sym"), F.col("at").alias("pos"), "n")
        entropy = entropy_of_positions(at, here.agg(F.max("len").alias("longest"))).select("sym", F.col("entropy").alias("value"))
    if diversity is None:
        total = symbols.agg(F.sum("n").alias("total"))
        diversity = with_scalars(symbols, total).select("sym", (F.col("n") / F.col("total")).alias("value"))
    bi = npmi(grams.filter("kind = 2").select("a", "b", "n"), symbols.select("sym", "n"), 2, alpha)
    tri = npmi(grams.filter("kind = 3").select("a", "b", "c", "n"), symbols.select("sym", "n"), 3, alpha)

    scalars = symbols.agg(
        F.greatest(F.sum("starts"), F.lit(1)).alias("all_starts"), F.greatest(F.sum("ends"), F.lit(1)).alias("all_ends"), F.greatest(F.count(F.lit(1)), F.lit(1)).alias("v")
    )
    means = entropy.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean_h")).crossJoin(F.broadcast(diversity.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean_d"))))
    known = stored(symbols.join(entropy.withColumnRenamed("value", "h"), "sym", "left").join(diversity.withColumnRenamed("value", "d"), "sym", "left"), "known")

    here = here.join(known, "sym")
    here = here.join(bi.select(F.col("a").alias("s1"), F.col("b").alias("sym"), F.col("npmi").alias("bi")), ["s1", "sym"], "left")
    here = here.join(tri.select(F.col("a").alias("s2"), F.col("b").alias("s1"), F.col("c").alias("sym"), F.col("npmi").alias("tri")), ["s2", "s1", "sym"], "left")
    here = with_scalars(with_scalars(here, scalars), means)
    near = with_guests(here, 1, long=long).select(
        "seq_id", "pos", "len", "guest", "bi", "tri", "n", "starts", "ends", "all_starts", "all_ends", "v",
        F.coalesce("h", "mean_h").alias("h"), F.coalesce("d", "mean_d").alias("d"),
        *[f.over(by_block()).alias(name) for name, f in (
            ("bi_before", F.lag("bi")), ("bi_after", F.lead("bi")), ("tri_after", F.lead("tri")), ("n_left", F.lag("n")), ("starts_left", F.lag("starts")),
            ("h_left", F.lag(F.coalesce("h", "mean_h"))), ("d_left", F.lag(F.coalesce("d", "mean_d"))),
        )],
    )
    none = F.lit(-1.0)
    f: list[Column] = [
        F.coalesce("bi", none),
        F.coalesce("bi_before", none),
        F.coalesce("bi_after", none),
        F.greatest(none, F.coalesce("tri", none), F.coalesce("tri_after", none)),
        F.abs(F.col("h") - F.col("h_left")),
        F.col("h") - F.col("h_left"),
        (F.col("d_left") + F.col("d")) / 2,
        (F.col("starts_left") + alpha) / (F.col("all_starts") + alpha * F.col("v")),
        (F.col("ends") + alpha) / (F.col("all_ends") + alpha * F.col("v")),
        F.when(F.col("len") > 2, (F.col("pos") - 1) / F.greatest(F.lit(1), F.col("len") - 2)).otherwise(F.lit(0.5)),
        (F.col("n_left") + alpha) / (F.col("n") + alpha),
        (F.col("starts_left") > 0.01 * F.col("all_starts")).cast("double"),
        (F.col("ends") > 0.01 * F.col("all_ends")).cast("double"),
    ]
    return near.filter("pos >= 1 AND NOT guest").select("seq_id", "pos", *[c.alias(n) for c, n in zip(f, FEATURES, strict=True)])


def association(corpus: DataFrame, alpha: float = 1.0) -> DataFrame:
    """seq_id, pos, f0 of the candidate boundaries: the first feature alone, which takes bigram counts and one join."""
    pairs = npmi(ngram_counts(corpus, 2), symbol_counts(corpus).select("sym", "n"), 2, alpha)
    back = with_guests(corpus, 1, long=has_long(corpus)).select("seq_id", "pos", "guest", F.lag("sym", 1).over(by_block()).alias("a"), F.col("sym").alias("b"))
    here = back.filter("pos >= 1 AND NOT guest").drop("guest")
    return here.join(pairs.select("a", "b", "npmi"), ["a", "b"], "left").select("seq_id", "pos", F.coalesce("npmi", F.lit(-1.0)).alias("f0"))


def zscore_detector(candidates: DataFrame) -> DataFrame:
    """seq_id, pos, p: unlikely pairs are boundaries. p >= 0.5 exactly where f0 is at most its mean."""
    own = candidates.agg(F.avg("f0").alias("mean"), F.stddev_pop("f0").alias("std"))
    z = (F.col("f0") - F.col("mean")) / (F.col("std") + 1e-12)
    flat = F.col("std") < 1e-8
    return with_scalars(candidates.select("seq_id", "pos", "f0"), own).select("seq_id", "pos", F.when(flat, F.lit(0.5)).otherwise(clip01(1 - normal_cdf(z))).alias("p"))


def zscore_reliability(candidates: DataFrame) -> DataFrame:
    """One row: the mean of |z| / (1 + |z|), or 0.2 where f0 doesn't vary."""
    own = candidates.agg(F.avg("f0").alias("mean"), F.stddev_pop("f0").alias("std"))
    z = F.abs((F.col("f0") - F.col("mean")) / (F.col("std") + 1e-12))
    return with_scalars(candidates.select("f0"), own).agg(F.coalesce(F.when(F.max("std") < 1e-8, F.lit(0.2)).otherwise(F.avg(z / (1 + z))), F.lit(0.0)).alias("reliability"))


def ensemble(detectors: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """seq_id, pos, p: the mean of detectors' p, weighted by their reliabilities (equally if all are 0).

    detectors: name -> ((seq_id, pos, p), one row of reliability). One aggregation over the union, in
    place of a join per detector. Detectors without rows say nothing; there has to be one at least.
    """
    if not detectors:
        raise ValueError("an ensemble needs a detector")
    every = None
    for p, rel in detectors.values():
        own = with_scalars(p.select("seq_id", "pos", "p"), rel.select(F.greatest(F.lit(0.0), "reliability").alias("w")))
        every = own if every is None else every.unionByName(own)
    mean = F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("w")), F.sum("w")), F.avg("p"))
    return every.groupBy("seq_id", "pos").agg(clip01(mean).alias("p"))


def choose(corpus: DataFrame, probabilities: DataFrame, threshold: float = 0.5, long: bool = True) -> DataFrame:
    """The corpus with ``boundary``: p reaches the threshold, or, where it does nowhere in a sequence of
    several symbols, p is largest there (the first of equals); without any p the middle is taken.
    long: whether a sequence may have several blocks."""
    joined = corpus.join(probabilities.select("seq_id", "pos", "p"), ["seq_id", "pos"], "left").withColumn("block", block_of())
    rank, reached = F.when(F.col("p").isNotNull(), F.struct(-F.col("p"), F.col("pos"))), F.coalesce(F.col("p") >= threshold, F.lit(False))
    summary = {"best": F.min_by("pos", rank), "some": F.max(reached), "any_p": F.max(F.col("p").isNotNull())}
    own = W.partitionBy("seq_id", "block")
    marked = joined.select("seq_id", "pos", "sym", "len", "p", *[c.over(own).alias(name) for name, c in summary.items()])
    best, some, any_p = (F.col(name) for name in summary)
    if long:  # sequences of several blocks: the same over all of them, which is a row for each such sequence
        whole = joined.filter(F.col("len") > BLOCK).groupBy("seq_id").agg(*[c.alias(f"whole_{name}") for name, c in summary.items()])
        marked = marked.join(whole, "seq_id", "left")
        best, some, any_p = (F.when(F.col("len") > BLOCK, F.col(f"whole_{name}")).otherwise(F.col(name)) for name in summary)
    forced = F.when(any_p, best).otherwise(F.greatest(F.lit(1), F.floor(F.col("len") / 2)))
    chosen = F.when(some, F.coalesce(F.col("p") >= threshold, F.lit(False))).otherwise(F.col("pos") == forced)
    return marked.select("seq_id", "pos", "sym", "len", (chosen & (F.col("pos") >= 1)).alias("boundary"))


def segments(marked: DataFrame, long: bool = True) -> DataFrame:
    """seq_id, seg_pos, n_segs, seg_key, tokens: the runs of symbols between boundaries. long: as for ``choose``."""
    marked = marked.withColumn("block", block_of())
    running = W.partitionBy("seq_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = F.col("boundary").cast("int")
    numbered = marked.select("seq_id", "block", "pos", "sym", F.sum(cut).over(running).alias("inside"), F.sum(cut).over(W.partitionBy("seq_id", "block")).alias("cuts"))
    inside, cuts = F.col("inside"), F.col("cuts")
    if long:
        total = marked.filter(F.col("len") > BLOCK).groupBy("seq_id").agg(F.sum(cut).alias("whole_cuts"))
        numbered = numbered.join(carried(marked, F.sum(cut)), ["seq_id", "block"], "left").join(total, "seq_id", "left")
        inside, cuts = F.coalesce("carried", F.lit(0)) + inside, F.coalesce("whole_cuts", "cuts")
    numbered = numbered.withColumn("seg_pos", inside.cast("int")).withColumn("n_segs", cuts + 1)
    whole = numbered.groupBy("seq_id", "seg_pos").agg(F.first("n_segs").alias("n_segs"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda t: t["sym"]).alias("tokens"))
    return whole.select("seq_id", "seg_pos", "n_segs", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("seg_key"), "tokens")


def segmented_lines(found: DataFrame) -> DataFrame:
    """seq_id, line: segments as text, ``1, 2 | 3``."""
    parts = F.array_sort(F.collect_list(F.struct("seg_pos", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ", ").alias("text"))))
    return found.groupBy("seq_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " | ").alias("line"))


def segment_corpus(corpus: DataFrame, probabilities: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Segments of a corpus, by default by the z-score detector alone."""
    if probabilities is None:
        probabilities = zscore_detector(stored(association(corpus), "association"))
    long = has_long(corpus)
    return segments(choose(corpus, probabilities, threshold, long), long)


def sequence_association(sequences: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``association`` of sequences (seq_id, symbols) of a block at most: neighbours are in the row, so only counts of
    pairs and the pairs themselves are shuffled."""
    spots = F.when(F.size("symbols") > 1, F.sequence(F.lit(1), F.size("symbols") - 1))
    each = sequences.select("seq_id", "symbols", F.explode(spots).alias("pos"))
    here = each.select("seq_id", "pos", F.get("symbols", F.col("pos") - 1).alias("a"), F.get("symbols", F.col("pos")).alias("b"))
    symbols = stored(sequences.select(F.explode("symbols").alias("sym")).groupBy("sym").agg(F.count(F.lit(1)).alias("n")), "symbols")
    places = sequences.select(F.greatest(F.lit(0), F.size("symbols") - 1).alias("n"))
    pairs = npmi(here.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), symbols, 2, alpha, places)
    return here.join(pairs.select("a", "b", "npmi"), ["a", "b"], "left").select("seq_id", "pos", F.coalesce("npmi", F.lit(-1.0)).alias("f0"))


def sequence_segments(sequences: DataFrame, probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``segments`` of what ``choose`` marks, for sequences (seq_id, symbols) of a block at most, with ``before``, the key of
    the segment before. probabilities: seq_id, pos, p of places of the sequences, from 1 on. A sequence meets its cuts in one row.
    They are dealt by sequence before they are listed: they come by pair, so lists of each task would hold a place or two."""
    rank = F.when(F.col("p").isNotNull(), F.struct(-F.col("p"), F.col("pos")))
    found = probabilities.select("seq_id", "pos", "p").repartition("seq_id").groupBy("seq_id").agg(F.collect_list(F.when(F.col("p") >= threshold, F.col("pos"))).alias("reached"), F.min_by("pos", rank).alias("best"))
    size = F.size("symbols")
    forced = F.coalesce("best", F.greatest(F.lit(1), F.floor(size / 2)).cast("int"))
    cuts = F.when(size < 2, F.array().cast("array<int>")).when(F.size("reached") > 0, F.sort_array("reached")).otherwise(F.array(forced))
    rows = sequences.join(found, "seq_id", "left").select("seq_id", "symbols", F.concat(F.array(F.lit(0)), cuts).alias("starts"))
    each = rows.select("seq_id", "symbols", "starts", F.posexplode("starts").alias("seg_pos", "start"))
    stop, back = F.coalesce(F.get("starts", F.col("seg_pos") + 1), size), F.get("starts", F.col("seg_pos") - 1)
    part = lambda low, high: F.slice("symbols", low + 1, high - low)
    key = lambda tokens: F.array_join(tokens.cast("array<string>"), ",")
    tokens, before = part(F.col("start"), stop), F.when(F.col("seg_pos") > 0, key(part(back, F.col("start"))))
    return each.select("seq_id", "seg_pos", F.size("starts").cast("long").alias("n_segs"), key(tokens).alias("seg_key"), tokens.alias("tokens"), before.alias("before"))


def segment_sequences(sequences: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``segment_corpus`` of sequences (seq_id, symbols) of a block at most, by the z-score detector."""
    return sequence_segments(sequences, zscore_detector(stored(sequence_association(sequences), "association")), threshold)
