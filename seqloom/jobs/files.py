"""The five stages over files: readers, operators and writers of each, from folder to folder.

Every stage reads text files (one path, a folder or a pattern) and writes folders under ``out``.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import boundary, compare, decode, detectors, lexicon, mixture, stats
from ..sources import readers, writers
from ..sources.corpora import array_corpus

#: Bins of the first feature, of each detector, and of posteriors.
FEATURE_BINS, DETECTOR_BINS, POSTERIOR_BINS = 60, 50, 40


def _clearing(stage):
    """The stage with what it stored on the way deleted once its outputs are written."""

    @wraps(stage)
    def run(spark: SparkSession, *args, **options) -> None:
        with storage.clearing(spark):
            stage(spark, *args, **options)

    return run


@_clearing
def symbol_statistics(spark: SparkSession, sequences: str, out: str) -> None:
    """distribution_score and normalized_positional_entropy: lines of symbol, tab and value."""
    corpus = storage.stored(array_corpus(readers.read_tokens(spark, sequences)), "corpus")
    writers.write_lines(writers.score_lines(stats.distribution_score(corpus), "score"), f"{out}/distribution_score")
    writers.write_lines(writers.score_lines(stats.positional_entropy(corpus), "entropy"), f"{out}/normalized_positional_entropy")


@_clearing
def segmentation(spark: SparkSession, sequences: str, entropy: str, diversity: str, out: str, threshold: float = 0.5, diagnostics: bool = True) -> None:
    """segmented: a line for each sequence, by all three detectors. entropy, diversity: scalar maps of symbols.

    diagnostics: candidates with all features, and histograms of the first feature and of each detector.
    """
    given = storage.stored(readers.read_sequences(spark, sequences), "sequences")
    corpus = storage.stored(array_corpus(given), "corpus")
    candidates = boundary.features(corpus, readers.read_scalar_map(spark, entropy), readers.read_scalar_map(spark, diversity))
    found = {
        "mixture": detectors.gmm_detector(candidates), "density": detectors.density_detector(candidates),
        "zscore": (boundary.zscore_detector(candidates), boundary.zscore_reliability(candidates)),
    }
    found = {name: (storage.stored(p, "detector"), reliability) for name, (p, reliability) in found.items()}
    lines = boundary.segmented_lines(boundary.segment_corpus(corpus, boundary.ensemble(found), threshold))
    writers.write_lines(writers.corpus_lines(lines, given), f"{out}/segmented")
    if diagnostics:
        writers.write_table(writers.candidate_table(candidates), f"{out}/candidates")
        writers.write_table(stats.histogram(candidates, "f0", FEATURE_BINS).orderBy("bin"), f"{out}/histogram_f0")
        for name, (p, _) in found.items():
            writers.write_table(stats.histogram(p, "p", DETECTOR_BINS).orderBy("bin"), f"{out}/histogram_{name}")


@_clearing
def segment_lexicon(spark: SparkSession, segmented: str, out: str, rounds: int = 40, diagnostics: bool = True) -> None:
    """categories (a table of segments) and summary (an object). Blank lines count as sequences.

    diagnostics: posteriors, parameters and labels of the components, rates of the seeds, a short table, and
    histograms of the posteriors.
    """
    given = storage.stored(readers.read_segmented(spark, segmented), "segmented")
    rows = storage.stored(readers.segment_rows(given), "segments")
    sequences = given.agg(F.count(F.lit(1)).alias("n"))
    matrix = storage.stored(lexicon.feature_matrix(rows, sequences), "matrix")
    if matrix.isEmpty():
        return
    scaled = storage.stored(mixture.scaled_rows(matrix), "scaled")
    models = mixture.fit(matrix, scaled, mixture.left_out_rows(scaled.count(), rounds))
    labelled = storage.stored(mixture.labelled(matrix, scaled, models[0]), "labelled")
    adjacent = lexicon.numeric_neighbours(lexicon.contexts(rows), lexicon.segment_counts(rows))
    stable = storage.stored(mixture.agreement(scaled, models), "stable")
    writers.write_table(writers.category_table(lexicon.categories(matrix, labelled, adjacent, stable)), f"{out}/categories")
    rates = storage.stored(lexicon.seed_precision(labelled.select("seg_key", "label"), lexicon.seeds(matrix)), "rates")
    writers.write_objects(lexicon.summary(labelled, rows, rates, sequences=sequences), f"{out}/summary")
    if diagnostics:
        posteriors = [f"post_{c}" for c in mixture.LABELS]
        short = labelled.join(stable, "seg_key").orderBy("label", F.col("freq").desc(), "seg_id")
        writers.write_table(labelled.orderBy("seg_id").select("seg_id", "component", *posteriors), f"{out}/posteriors")
        writers.write_table(short.select("seg_key", "seg_id", "freq", "label", *posteriors, "stability"), f"{out}/summary_table")
        writers.write_objects(rates.orderBy("label"), f"{out}/seed_evaluation")
        writers.write_objects(parameters(spark, models[0], mixture.component_labels(models[0], matrix)), f"{out}/components")
        for c in posteriors:
            writers.write_table(stats.histogram(labelled, c, POSTERIOR_BINS).orderBy("bin"), f"{out}/histogram_{c}")


def parameters(spark: SparkSession, model: mixture.Mixture, labels: list[str]) -> DataFrame:
    """component, label, pi, mu, sigma of a fit: three rows."""
    m = asdict(model)
    rows = [(k, labels[k], float(m["pi"][k]), [float(x) for x in m["mu"][k]], [float(x) for x in m["sigma"][k]]) for k in range(len(labels))]
    return spark.createDataFrame(rows, "component int, label string, pi double, mu array<double>, sigma array<double>")


@_clearing
def comparison(spark: SparkSession, one: str, two: str, out: str) -> None:
    """report: the similarities of two summaries, their counts and role patterns, as an object."""
    both = [readers.read_summary(spark, path).withColumn("corpus", F.lit(name)) for name, path in (("1", one), ("2", two))]
    writers.write_objects(compare.summary_report(both[0].unionByName(both[1]), "1", "2"), f"{out}/report")


@_clearing
def decoding(spark: SparkSession, segmented: str, lexicon_table: str, phrases: str, out: str, categories: str | None = None) -> None:
    """decoded (sentences by line), decoded_words (the best phrases of each segment that no lexicon entry
    names) and decoded_lines (objects with line, sentence and confidence).

    categories: objects of segments with label and posteriors, which weigh the scores.
    """
    lines = storage.stored(readers.read_phrases(spark, segmented).select(F.col("line_no").alias("seq_id"), F.col("value").alias("text")), "lines")
    words = storage.stored(readers.lexicon_map(readers.read_table(spark, lexicon_table)), "lexicon")
    candidates = storage.stored(readers.phrase_corpus(readers.read_phrases(spark, phrases)), "phrases")
    labelled = None if categories is None else storage.stored(readers.read_categories(spark, categories), "categories")
    records = storage.stored(decode.decoded_records(lines, words, candidates, labelled), "records")
    writers.write_lines(writers.decoded_lines(records), f"{out}/decoded")
    writers.write_objects(records.orderBy("seq_id"), f"{out}/decoded_lines")
    asked = decode.open_segments(lines.select(F.explode(F.split("text", r"\|")).alias("text")), words)
    writers.write_objects(writers.decoded_words(decode.fuzzy_top(decode.class_lookup(asked, labelled), candidates)), f"{out}/decoded_words")
