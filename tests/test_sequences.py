"""Sequences held in rows against the same sequences a symbol a row."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import boundary, lexicon
from seqloom.sources.corpora import array_corpus

KEYS = ["seq_id", "seg_pos", "n_segs", "seg_key", "tokens"]


def sequences(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.randint(0, 9) * 30 for _ in range(rnd.choice([1, 2, 3, 7]))]) for i in range(120)] + [(900, [5]), (901, [7, 7]), (902, [7, 7, 7])]
    return spark.createDataFrame(rows, "seq_id long, symbols array<long>")


def as_set(frame, *columns):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in frame.select(*columns).collect()}


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_segments_of_sequences(spark, threshold):
    given = sequences(spark, 3)
    corpus = array_corpus(given)
    own, wanted = boundary.segment_sequences(given, threshold), boundary.segment_corpus(corpus, threshold=threshold)
    assert as_set(own, *KEYS) == as_set(wanted, *KEYS) and own.count() == wanted.count()
    assert as_set(lexicon.contexts(own), "seg_key", "side", "nbr", "n") == as_set(lexicon.contexts(wanted), "seg_key", "side", "nbr", "n")
    shuffles = boundary.sequence_segments(given, spark.createDataFrame([(1, 1, 0.5)], "seq_id long, pos int, p double"))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles <= 2


def test_sequences_without_probabilities(spark):
    found = boundary.sequence_segments(sequences(spark, 4), spark.createDataFrame([], "seq_id long, pos int, p double"))
    none = array_corpus(sequences(spark, 4))
    wanted = boundary.segment_corpus(none, none.select("seq_id", "pos", F.lit(None).cast("double").alias("p")).limit(0))
    assert as_set(found, *KEYS) == as_set(wanted, *KEYS)


def test_context_features_equal_those_taken_apart(spark):
    rows = boundary.segment_sequences(sequences(spark, 5))
    counts, ctx = lexicon.segment_counts(rows), lexicon.contexts(rows)
    found = {r.seg_key: r.asDict() for r in lexicon.context_features(ctx, counts).collect()}
    apart = lexicon.side_entropy(ctx).join(lexicon.average_pmi(ctx, counts), "seg_key").join(lexicon.numeric_association(lexicon.numeric_neighbours(ctx, counts)), "seg_key").collect()
    assert found.keys() == {r.seg_key for r in apart} and len(apart) > 10
    for r in apart:
        assert found[r.seg_key] == pytest.approx(r.asDict(), abs=1e-12)
