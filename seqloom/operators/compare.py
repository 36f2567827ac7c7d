"""Similarity of corpora by their class labels.

Labels come as (corpus, label) or (corpus, pattern) counts; two corpora are compared over the union of
their keys by one aggregation, in place of a full outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import svo_pattern

WEIGHT = 0.2


def _sides(counts: DataFrame, one: str, two: str, key: str) -> DataFrame:
    """key, f1, f2 over all keys of corpora one and two. counts: corpus, key, n."""
    of = lambda c: F.sum(F.when(F.col("corpus") == c, F.col("n")).otherwise(F.lit(0)))
    return counts.filter(F.col("corpus").isin(one, two)).groupBy(key).agg(of(one).alias("f1"), of(two).alias("f2"))


def class_entropy(counts: DataFrame) -> DataFrame:
    """corpus, entropy in bits of its label counts."""
    own = counts.filter("n > 0").groupBy("corpus").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    return own.select("corpus", F.greatest(F.lit(0.0), F.log2("t") - F.col("w") / F.col("t")).alias("entropy"))


def entropy_similarity(counts: DataFrame, one: str, two: str) -> DataFrame:
    """One row: entropy_1, entropy_2, similarity; 1 where both are 0."""
    of = lambda c: F.coalesce(F.max(F.when(F.col("corpus") == c, F.col("entropy"))), F.lit(0.0))
    both = class_entropy(counts).agg(of(one).alias("entropy_1"), of(two).alias("entropy_2"))
    most = F.greatest("entropy_1", "entropy_2")
    return both.withColumn("similarity", F.when(most == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.abs(F.col("entropy_1") - F.col("entropy_2")), most)))


def cosine(counts: DataFrame, one: str, two: str) -> DataFrame:
    """One row: similarity, the cosine of label counts; 0 if a side is empty."""
    f = _sides(counts, one, two, "label").agg(F.sum(F.col("f1") * F.col("f2")).alias("dot"), F.sqrt(F.sum(F.col("f1") * F.col("f1"))).alias("n1"), F.sqrt(F.sum(F.col("f2") * F.col("f2"))).alias("n2"))
    return f.select(F.coalesce(F.try_divide(F.col("dot"), F.col("n1") * F.col("n2")), F.lit(0.0)).alias("similarity"))


def jaccard(counts: DataFrame, one: str, two: str) -> DataFrame:
    """One row: similarity of the sets of labels; 1 if both are empty."""
    f = _sides(counts, one, two, "label").agg(F.count_if((F.col("f1") > 0) & (F.col("f2") > 0)).alias("i"), F.count_if((F.col("f1") > 0) | (F.col("f2") > 0)).alias("u"))
    return f.select(F.coalesce(F.try_divide("i", "u"), F.lit(1.0)).alias("similarity"))


def dice(counts: DataFrame, one: str, two: str, key: str = "pattern", empty_side: float | None = 0.0) -> DataFrame:
    """One row: the mean over all patterns of 2 min / sum. empty_side: the value if one side has none
    (None: as it comes; both empty is then 1, where a division by zero would be)."""
    f = _sides(counts, one, two, key).agg(F.avg(2 * F.least("f1", "f2") / (F.col("f1") + F.col("f2"))).alias("s"), F.coalesce(F.sum("f1"), F.lit(0)).alias("t1"), F.coalesce(F.sum("f2"), F.lit(0)).alias("t2"))
    value = F.coalesce("s", F.lit(1.0))
    if empty_side is not None:
        value = F.when((F.col("t1") == 0) | (F.col("t2") == 0), F.lit(empty_side)).otherwise(value)
    return f.select(value.alias("similarity"))


def report(counts: DataFrame, structures: DataFrame, patterns: DataFrame, one: str, two: str, labels: DataFrame | None = None) -> DataFrame:
    """One row with the five similarities (4 digits) and the overall one in percent (2 digits).

    counts: corpus, label, n; structures and patterns: corpus, pattern, n. labels: the counts that the order
    is compared by, if they are others.
    """
    e = entropy_similarity(counts, one, two).withColumnRenamed("similarity", "entropy_similarity")
    parts = {
        "order_similarity": cosine(counts if labels is None else labels, one, two), "semantic_similarity": jaccard(counts, one, two),
        "structure_similarity": dice(structures, one, two), "svo_similarity": dice(patterns, one, two, empty_side=None),
    }
    for name, frame in parts.items():
        e = e.crossJoin(F.broadcast(frame.select(F.col("similarity").alias(name))))
    total = sum((F.col(c) for c in ["entropy_similarity", *parts]), F.lit(0.0)) * WEIGHT * 100
    rounded = [F.round(c, 4).alias(c) for c in ["entropy_similarity", *parts, "entropy_1", "entropy_2"]]
    return e.select(*rounded, F.round(total, 2).alias("overall_similarity_percent"))


def of_summaries(summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Counts of lexicon summaries (corpus, class_counts, representatives): classes and labels (corpus, label, n),
    structures and role patterns (corpus, pattern, n).

    A representative counts with its label_sequence, by default its own label alone.
    """
    classes = summaries.select("corpus", F.explode("class_counts").alias("label", "n"))
    lists = summaries.select("corpus", F.explode("representatives").alias("of", "list")).select("corpus", "of", F.explode("list").alias("r"))
    labels = lists.select("corpus", F.coalesce("r.label_sequence", F.array(F.coalesce("r.assigned_label", "of"))).alias("labels"))
    count = lambda df, key: df.groupBy("corpus", key).agg(F.count(F.lit(1)).alias("n"))
    return (
        classes, count(labels.select("corpus", F.explode("labels").alias("label")), "label"),
        count(labels.select("corpus", F.array_join("labels", ",").alias("pattern")), "pattern"), count(labels.select("corpus", svo_pattern(F.col("labels")).alias("pattern")), "pattern"),
    )


def summary_report(summaries: DataFrame, one: str, two: str) -> DataFrame:
    """One row: the report of two summaries with class counts, numbers of labels and role patterns of both."""
    classes, labels, structures, patterns = of_summaries(summaries)
    found = report(classes, structures, patterns, one, two, labels)
    as_map = lambda df, key, c: df.filter(F.col("corpus") == c).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("m"))
    for i, c in enumerate((one, two), 1):
        found = found.crossJoin(F.broadcast(as_map(classes, "label", c).withColumnRenamed("m", f"class_counts_{i}")))
        found = found.crossJoin(F.broadcast(labels.filter(F.col("corpus") == c).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_labels_{i}"))))
        found = found.crossJoin(F.broadcast(as_map(patterns, "pattern", c).withColumnRenamed("m", f"svo_patterns_{i}")))
    return found
