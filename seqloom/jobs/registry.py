"""Queries of the library over the driver's tables, each over whole tables.

The main corpus is that of order lines (a sequence of suppliers per order). Corpora to compare are the
two line states, with the return flag of a line as its class. Target phrases are part names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .. import storage
from ..operators import boundary, compare, decode, detectors, lexicon, mixture, stats
from ..sources import readers, writers
from ..sources.corpora import long_orders, order_lines, order_sequences, table
from . import oracle

DIGITS = 6
#: Bins of the association's histogram, and fits of the jackknife that leave a row out.
BINS, ROUNDS = 60, 40
#: Segments that stand for a class in a summary.
REPRESENTATIVES = 30
#: Fixed values of the comparison queries: the class of a return flag, and the two corpora.
FLAG_CLASS = {"A": fx.TITLE, "N": fx.COMMODITY, "R": fx.NAME}
ONE, TWO = "F", "O"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to a number of digits at which two engines agree; no negative zero.

    Halves are judged on the binary value, away from zero, as SQL engines do for doubles; round()
    judges them on the shortest decimal form, which differs for quotients such as 641/640.
    """
    scale = F.lit(10.0**DIGITS)
    value = lambda c: F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale + F.lit(0.0)
    return df.select(*[value(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _kept(df: DataFrame) -> DataFrame:
    """A step's result, written once where a query reads it again and again."""
    return storage.stored(df, "step")


def _segments(spark: SparkSession, sf: str, *without: str) -> DataFrame:
    """Segments of all orders; ``without`` the columns that a query never reads."""

    def make() -> DataFrame:
        if long_orders(spark, sf):
            return boundary.segment_corpus(_kept(order_lines(spark, sf))).drop(*without)
        return boundary.segment_sequences(_kept(order_sequences(spark, sf))).drop(*without)

    return storage.settled(spark, "segments", make)


def _matrix_of(rows: DataFrame) -> DataFrame:
    return storage.settled(rows.sparkSession, "matrix", lambda: lexicon.feature_matrix(rows))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix_of(_segments(spark, sf))


def distribution_score(spark, sf):
    return _rounded(stats.distribution_score(order_lines(spark, sf)), "score")


def positional_entropy(spark, sf):
    return _rounded(stats.positional_entropy(order_lines(spark, sf)), "entropy")


def ngram_counts_uni(spark, sf):
    return stats.symbol_counts(order_lines(spark, sf)).select("sym", "n")


def start_end_counts(spark, sf):
    return stats.symbol_counts(order_lines(spark, sf)).select("sym", "starts", "ends")


def ngram_counts_bi(spark, sf):
    return stats.ngram_counts(order_lines(spark, sf), 2)


def ngram_counts_tri(spark, sf):
    return stats.ngram_counts(order_lines(spark, sf), 3)


def _npmi(spark, sf, n):
    corpus = order_lines(spark, sf)
    return _rounded(stats.npmi(stats.ngram_counts(corpus, n), stats.symbol_counts(corpus).select("sym", "n"), n), "npmi")


def npmi_bigram(spark, sf):
    return _npmi(spark, sf, 2)


def npmi_trigram(spark, sf):
    return _npmi(spark, sf, 3)


def _candidates(spark, sf):
    return boundary.features(_kept(order_lines(spark, sf)))


def boundary_features(spark, sf):
    return _rounded(_candidates(spark, sf), *boundary.FEATURES)


def score_lines(spark, sf):
    return writers.score_lines(stats.distribution_score(order_lines(spark, sf)), "score")


def association_histogram(spark, sf):
    """Bins of the association across candidate boundaries."""
    values = _kept(_rounded(boundary.association(_kept(order_lines(spark, sf))).select("f0"), "f0"))
    return _rounded(stats.histogram(values, "f0", BINS), "low", "high")


def zscore_boundary(spark, sf):
    found = boundary.zscore_detector(_kept(boundary.association(_kept(order_lines(spark, sf)))))
    return found.select("seq_id", "pos", (F.col("p") >= 0.5).alias("is_boundary"), (F.round("p", 5) + F.lit(0.0)).alias("p"))


def segmented_lines(spark, sf):
    return boundary.segmented_lines(_segments(spark, sf, "before", "n_segs", "seg_key"))


def segment_inventory(spark, sf):
    return lexicon.inventory(_segments(spark, sf, "before", "n_segs", "tokens")).select("seg_key", "seg_id", "freq", F.size("examples").cast("long").alias("n_examples"))


def top_examples(spark, sf):
    return lexicon.top_examples(_segments(spark, sf, "before", "n_segs", "tokens"))


def segment_contexts(spark, sf):
    return lexicon.contexts(_segments(spark, sf))


def segment_entropy(spark, sf):
    return _rounded(lexicon.side_entropy(lexicon.contexts(_segments(spark, sf))).drop("coll_skew"), "H_left", "H_right", "H_total")


def segment_avg_pmi(spark, sf):
    rows = _segments(spark, sf)
    return _rounded(lexicon.average_pmi(lexicon.contexts(rows), _kept(lexicon.segment_frequencies(rows))), "avg_pmi_left", "avg_pmi_right")


def segment_burstiness(spark, sf):
    rows = _segments(spark, sf)
    return _rounded(lexicon.burstiness_and_idf(lexicon.segment_counts(rows), lexicon.sequence_count(rows)).select("seg_key", "burstiness"), "burstiness")


def segment_idf_skew(spark, sf):
    rows = _segments(spark, sf)
    counts = _kept(lexicon.segment_counts(rows).drop("tokens", "avg_pos"))
    idf = lexicon.burstiness_and_idf(counts, lexicon.sequence_count(rows)).select("seg_key", "idf")
    skew = lexicon.side_entropy(lexicon.contexts(rows), counts).select("seg_key", "coll_skew")
    return _rounded(idf.join(skew, "seg_key", "left").fillna(0.0, ["coll_skew"]), "idf", "coll_skew")


def _adjacent(spark, sf):
    rows = _segments(spark, sf)
    return _kept(lexicon.numeric_neighbours(lexicon.contexts(rows), _kept(lexicon.segment_frequencies(rows))))


def numeric_assoc(spark, sf):
    return _rounded(lexicon.numeric_association(_adjacent(spark, sf)), "numeric_assoc")


def log_odds(spark, sf):
    return _rounded(lexicon.log_odds(_adjacent(spark, sf)), "log_odds")


def g2_test(spark, sf):
    return _rounded(lexicon.g2(_adjacent(spark, sf)), "g2")


def segment_features(spark, sf):
    wide = _matrix(spark, sf).drop("tokens", "examples", "seg_id")
    return _rounded(wide, *[c for c, t in wide.dtypes if t == "double"])


def seed_sets(spark, sf):
    return lexicon.seeds(_matrix(spark, sf))


def seed_precision(spark, sf):
    seed = lexicon.seeds(_matrix(spark, sf))
    return _rounded(lexicon.seed_precision(lexicon.rule_labels(seed), seed), "precision_proxy", "recall_proxy")


def coverage(spark, sf):
    rows = _segments(spark, sf)
    return _rounded(lexicon.coverage(rows, lexicon.rule_labels(lexicon.seeds(_matrix_of(rows)))), "pct")


def robust_scale(spark, sf):
    columns = ["start_prob", "end_prob", "avg_pos", "mean_len", "H_total", "burstiness", "idf", "coll_skew"]
    return _rounded(lexicon.robust_scale(_matrix(spark, sf), columns, ["seg_key"]), *columns)


# comparison of corpora


def _classes(spark, sf):
    """corpus, seq_id, labels: the classes of an order's lines of one state, in order."""
    label = F.create_map(*[F.lit(x) for kv in FLAG_CLASS.items() for x in kv])[F.col("l_returnflag")]
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", label.alias("label"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("corpus"), F.col("l_orderkey").alias("seq_id"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(place)), lambda p: p["label"]).alias("labels"))


def _label_counts(spark, sf, classes=None):
    classes = _classes(spark, sf) if classes is None else classes
    return classes.select("corpus", F.explode("labels").alias("label")).groupBy("corpus", "label").agg(F.count(F.lit(1)).alias("n"))


def _structures(spark, sf, classes=None):
    classes = _classes(spark, sf) if classes is None else classes
    return classes.select("corpus", F.array_join("labels", ",").alias("pattern")).groupBy("corpus", "pattern").agg(F.count(F.lit(1)).alias("n"))


def _patterns(classes):
    return classes.select("corpus", fx.svo_pattern(F.col("labels")).alias("pattern")).groupBy("corpus", "pattern").agg(F.count(F.lit(1)).alias("n"))


def svo_patterns(spark, sf):
    return _patterns(_classes(spark, sf))


def class_entropy_similarity(spark, sf):
    return _rounded(compare.entropy_similarity(_label_counts(spark, sf), ONE, TWO), "entropy_1", "entropy_2", "similarity")


def label_cosine(spark, sf):
    return _rounded(compare.cosine(_label_counts(spark, sf), ONE, TWO), "similarity")


def jaccard_classes(spark, sf):
    return _rounded(compare.jaccard(_label_counts(spark, sf), ONE, TWO), "similarity")


def dice_structure(spark, sf):
    return _rounded(compare.dice(_structures(spark, sf), ONE, TWO), "similarity")


def svo_similarity(spark, sf):
    return _rounded(compare.dice(svo_patterns(spark, sf), ONE, TWO, empty_side=None), "similarity")


def overall_similarity(spark, sf):
    classes = _kept(_classes(spark, sf))
    return compare.report(_label_counts(spark, sf, classes), _structures(spark, sf, classes), _patterns(classes), ONE, TWO)


def _summary_report(spark, sf):
    """The report of two lexicon summaries: class counts of all lines, and of each first class 30 orders as representatives."""
    classes = _kept(_classes(spark, sf))
    of = classes.withColumn("of", F.col("labels")[0])
    place = F.row_number().over(Window.partitionBy("corpus", "of").orderBy("seq_id"))
    best = of.withColumn("place", place).filter(F.col("place") <= REPRESENTATIVES)
    listed = best.groupBy("corpus", "of").agg(F.collect_list(F.struct(F.col("of").alias("assigned_label"), F.col("labels").alias("label_sequence"))).alias("list"))
    as_map = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    counts = _label_counts(spark, sf, classes).groupBy("corpus").agg(as_map("label", "n").alias("class_counts"))
    summaries = counts.join(listed.groupBy("corpus").agg(as_map("of", "list").alias("representatives")), "corpus")
    return compare.summary_report(_kept(summaries), ONE, TWO)


def summary_comparison(spark, sf):
    return _summary_report(spark, sf).drop(*[f"{c}_{i}" for c in ("class_counts", "svo_patterns") for i in (1, 2)])


def summary_maps(spark, sf):
    """The maps of the report, a row per entry: class counts and role patterns of both summaries."""
    maps = [(i, c) for i in (1, 2) for c in ("class_counts", "svo_patterns")]

    def rows(side: int, name: str):
        return F.transform(F.map_entries(f"{name}_{side}"), lambda e: F.struct(F.lit(side).alias("side"), F.lit(name).alias("map"), e["key"].alias("key"), e["value"].alias("n")))

    entries = F.concat(*[rows(side, name) for side, name in maps])
    return _summary_report(spark, sf).select(F.explode(entries).alias("e")).select("e.side", "e.map", "e.key", "e.n")


# text


def parse_sequences(spark, sf):
    """Property strings of events, read as sequences of integers in brackets."""
    return table(spark, sf, "events").select("event_id", F.array_join(readers.parse_sequence(F.col("props")).cast("array<string>"), ",").alias("symbols"))


def normalize_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(fx.normalize_text(F.col("text")).cast("binary")).alias("text_md5"))


def strip_diacritics(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(fx.strip_diacritics(F.col("text")).cast("binary")).alias("text_md5"))


def _phrases(spark, sf):
    return readers.phrase_corpus(table(spark, sf, "part").select((F.col("p_partkey")).alias("line_no"), F.col("p_name").alias("value")))


def corpus_dedup(spark, sf):
    return _phrases(spark, sf)


def _segment_texts(spark, sf):
    rows = _segments(spark, sf)
    return rows.select("seq_id", "seg_pos", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ", ").alias("text"))


def _queries(spark, sf):
    return _segment_texts(spark, sf).select(fx.normalize_text(F.col("text")).alias("text")).filter("text <> ''").distinct()


def length_bucket_join(spark, sf):
    return decode.candidate_counts(_queries(spark, sf), _phrases(spark, sf))


def _lexicon(spark, sf):
    return readers.lexicon_map(table(spark, sf, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_partkey").alias("seal_id"), F.col("p_name").alias("words")))


def lexicon_lookup(spark, sf):
    return decode.lexicon_lookup(_queries(spark, sf), _lexicon(spark, sf))


def linguistic_weight(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    classes = F.explode(F.array(*[F.lit(c) for c in fx.CLASS_SUFFIXES]))
    return _rounded(words.select("word", classes.alias("label")).withColumn("weight", fx.linguistic_weight(F.col("word"), F.col("label"))), "weight")


def structure_and_length_pairs(spark, sf):
    """Length and structure similarity of each segment with all phrases of each length bucket: number, sum and most.

    Both depend on a phrase by its length alone, so phrases are counted by length before they meet the segments.
    """
    phrases = _phrases(spark, sf).select("text", "cand_id")
    alike = phrases.groupBy(F.length("text").alias("n")).agg(F.min_by("text", "cand_id").alias("text"), F.min("cand_id").alias("cand_id"), F.count(F.lit(1)).alias("phrases"))
    pairs = decode.candidate_pairs(_queries(spark, sf), alike).filter("cand_id IS NOT NULL").join(F.broadcast(alike.select("cand_id", "phrases")), "cand_id")
    e, s = fx.entropy_similarity(F.length("text"), F.length("word")), fx.structure_similarity(F.col("text"), F.col("word"))
    scored = pairs.select("text", "bucket", "phrases", e.alias("length"), s.alias("structure"))
    found = scored.groupBy("text", "bucket").agg(F.sum("phrases").alias("n_pairs"), *[f for c in ("length", "structure") for f in (F.sum(F.col(c) * F.col("phrases")).alias(f"{c}_sum"), F.max(c).alias(f"{c}_most"))])
    return _rounded(found, "length_sum", "length_most", "structure_sum", "structure_most")


def fuzzy_topk(spark, sf):
    return decode.fuzzy_top(decode.class_lookup(_queries(spark, sf)), _phrases(spark, sf)).select("text", "place", "word", "score")


def decoded_sentences(spark, sf):
    return decode.decode(_segment_texts(spark, sf), _lexicon(spark, sf), _phrases(spark, sf))


def decoded_by_class(spark, sf):
    """seq_id, line, decoded, confidence_percent: scores of segments are weighed by the mixture's classes."""
    rows = _segments(spark, sf)
    matrix = _matrix_of(rows)
    scaled = _kept(mixture.scaled_rows(matrix))
    labelled = _kept(mixture.labelled(matrix, scaled, mixture.fit(matrix, scaled)[0]))
    lines = _kept(boundary.segmented_lines(rows).select("seq_id", F.col("line").alias("text")))
    return decode.decoded_records(lines, _lexicon(spark, sf), _phrases(spark, sf), labelled)


def line_confidence(spark, sf):
    lines = boundary.segmented_lines(_segments(spark, sf)).select("seq_id", F.col("line").alias("text"))
    return decode.line_confidence(lines, _phrases(spark, sf))


# models


def _fitted(spark, sf):
    matrix = _matrix(spark, sf)
    scaled = _kept(mixture.scaled_rows(matrix))
    return matrix, scaled


def em_mixture(spark, sf):
    matrix, scaled = _fitted(spark, sf)
    return mixture.labelled(matrix, scaled, mixture.fit(matrix, scaled)[0])


def representatives(spark, sf):
    return lexicon.representatives(em_mixture(spark, sf))


def jackknife_stability(spark, sf):
    return mixture.stability(*_fitted(spark, sf), rounds=ROUNDS)


def lexicon_categories(spark, sf):
    rows = _segments(spark, sf)
    matrix = _matrix_of(rows)
    scaled = _kept(mixture.scaled_rows(matrix))
    models = mixture.fit(matrix, scaled, mixture.left_out_rows(scaled.count(), ROUNDS))
    adjacent = _kept(lexicon.numeric_neighbours(lexicon.contexts(rows), matrix))
    found = lexicon.categories(matrix, mixture.labelled(matrix, scaled, models[0]), adjacent, mixture.agreement(scaled, models))
    return writers.category_table(found)


def lexicon_summary(spark, sf):
    rows = _segments(spark, sf)
    matrix = _matrix_of(rows)
    scaled = _kept(mixture.scaled_rows(matrix))
    labelled = _kept(mixture.labelled(matrix, scaled, mixture.fit(matrix, scaled)[0]))
    rates = lexicon.seed_precision(labelled.select("seg_key", "label"), lexicon.seeds(matrix))
    return lexicon.summary(labelled, rows, rates).select(F.to_json(F.struct("*")).alias("summary"))


def decoded_words(spark, sf):
    return writers.decoded_words(fuzzy_topk(spark, sf)).select("text", F.to_json("top_candidates").alias("top_candidates"))


def bayes_gmm_detector(spark, sf):
    return detectors.gmm_detector(_candidates(spark, sf))[0]


def dbscan_detector(spark, sf):
    return detectors.density_detector(_candidates(spark, sf))[0]


def ensemble_boundary(spark, sf):
    corpus = _kept(order_lines(spark, sf))
    candidates = boundary.features(corpus)
    p = boundary.ensemble({
        "mixture": detectors.gmm_detector(candidates), "density": detectors.density_detector(candidates),
        "zscore": (boundary.zscore_detector(candidates), boundary.zscore_reliability(candidates)),
    })
    return boundary.segmented_lines(boundary.segment_corpus(corpus, p))


_WITH_SQL = [
    distribution_score, positional_entropy, ngram_counts_uni, ngram_counts_bi, ngram_counts_tri, start_end_counts, npmi_bigram, npmi_trigram, score_lines, association_histogram, boundary_features, zscore_boundary, segmented_lines,
    segment_inventory, top_examples, segment_contexts, segment_entropy, segment_avg_pmi, segment_burstiness, segment_idf_skew, numeric_assoc, log_odds, g2_test, segment_features, seed_sets, seed_precision,
    coverage, robust_scale, svo_patterns, class_entropy_similarity, label_cosine, jaccard_classes, dice_structure, svo_similarity, overall_similarity, summary_comparison, summary_maps, parse_sequences, normalize_text, strip_diacritics,
    corpus_dedup, length_bucket_join, lexicon_lookup, linguistic_weight, structure_and_length_pairs,
]
_WITHOUT_SQL = [fuzzy_topk, decoded_words, lexicon_categories, lexicon_summary, decoded_sentences, decoded_by_class, line_confidence, em_mixture, representatives, jackknife_stability, bayes_gmm_detector, dbscan_detector, ensemble_boundary]


def _tidy(query):
    """The query with what it stored on the way deleted: its result alone is left, if anything had to be stored."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return storage.tidy(spark, query.__name__, lambda: query(spark, sf))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(segmented_lines)(spark, sf)


def queries() -> dict:
    return {f.__name__: _tidy(f) for f in [*_WITH_SQL, *_WITHOUT_SQL]}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: oracle.SQL[f.__name__] for f in _WITH_SQL}
