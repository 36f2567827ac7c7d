"""Matching of segments with target words: exact lexicon, length-blocked fuzzy top-k, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, bucket_of, class_weight, entropy_similarity, linguistic_weight, normalize_text, sentence, structure_similarity
from ..storage import settled
from . import fuzzy

TOP, REACH = 3, 2


def with_buckets(queries: DataFrame, candidates: DataFrame, reach: int = REACH) -> DataFrame:
    """queries (text, ...) once for each length bucket of candidates (bucket, ...) that they are compared with: those within
    ``reach`` of their own, or all where there is none, as for a text far longer than all candidates.

    The driver holds the buckets that occur, at most about the root of the candidates' characters.
    """
    known = F.array(*[F.lit(r["bucket"]) for r in candidates.select("bucket").distinct().orderBy("bucket").collect()]).cast("array<int>")
    own = bucket_of(F.col("text"))
    near = F.filter(known, lambda b: (b >= F.greatest(F.lit(1), own - reach)) & (b <= own + reach))
    return queries.withColumn("bucket", F.explode(F.when(F.size(near) > 0, near).otherwise(known)))


def candidate_pairs(queries: DataFrame, candidates: DataFrame, reach: int = REACH) -> DataFrame:
    """queries (text, ...) with each candidate (cand_id, text) that they are compared with: an equi-join on buckets."""
    c = candidates.filter("text IS NOT NULL").select("cand_id", F.col("text").alias("word"), bucket_of(F.col("text")).alias("bucket"))
    return with_buckets(queries, c, reach).join(c, "bucket")


def candidate_counts(queries: DataFrame, candidates: DataFrame, reach: int = REACH) -> DataFrame:
    """text, n_candidates, first_word, last_word of what queries (text) are compared with, from counts of each bucket."""
    c = candidates.filter("text IS NOT NULL").groupBy(bucket_of(F.col("text")).alias("bucket"))
    c = c.agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("low"), F.max("text").alias("high"))
    met = with_buckets(queries.select("text").distinct(), c, reach).join(c, "bucket")
    return met.groupBy("text").agg(F.sum("n").alias("n_candidates"), F.min("low").alias("first_word"), F.max("high").alias("last_word"))


def final_score(segment: Column, word: Column, label: Column, probability: Column, phonetic: Column, literal: Column) -> Column:
    """The score of a word for a segment, before rounding."""
    e, s, sem = entropy_similarity(F.length(segment), F.length(word)), structure_similarity(segment, word), 0.6 * phonetic + 0.4 * literal
    cl = class_weight(label, 3)
    base = class_weight(label, 0) * e + class_weight(label, 1) * s + class_weight(label, 2) * sem
    return (base * (1 - cl) + cl * F.greatest(F.lit(0.15), probability)) * linguistic_weight(word, label)


def fuzzy_top(queries: DataFrame, candidates: DataFrame, k: int = TOP, reach: int = REACH) -> DataFrame:
    """text, label, probability, place, word, score: the k best candidates of each distinct query (text, label,
    probability). Ties keep the order of buckets, then of candidates."""
    return settled(queries.sparkSession, "fuzzy", lambda: fuzzy.fuzzy_top(queries, candidates, k, reach))


def lexicon_lookup(segments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """segments (text, ...) with ``words`` where the lexicon (key, words) has the normalized text."""
    return segments.join(lexicon.withColumnRenamed("key", "text"), "text", "left")


def class_lookup(segments: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Adds label and probability. labelled: seg_key, label, post_commodity, post_title, post_proper_name.

    Without it every segment is unknown with probability 0, which is what a summary that holds no
    segments on its top level comes to.
    """
    if labelled is None:
        return segments.withColumn("label", F.lit(UNKNOWN)).withColumn("probability", F.lit(0.0))
    own = F.create_map(*[x for c in ("commodity", "title", "proper_name") for x in (F.lit(c), F.col(f"post_{c}"))])[F.col("label")]
    known = labelled.groupBy(normalize_text(F.col("seg_key")).alias("text")).agg(F.min_by(F.struct(F.col("label"), own.alias("probability")), "seg_key").alias("c"))
    joined = segments.join(known, "text", "left")
    return joined.select(*segments.columns, F.coalesce("c.label", F.lit(UNKNOWN)).alias("label"), F.coalesce("c.probability", F.lit(0.0)).alias("probability"))


def open_segments(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """text: the distinct normalized segments that the lexicon doesn't name."""
    named = rows.select(normalize_text(F.col("text")).alias("text")).filter("text <> ''").distinct()
    return lexicon_lookup(named, lexicon).filter("words IS NULL").select("text")


def decode(rows: DataFrame, lexicon: DataFrame, candidates: DataFrame, labelled: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """seq_id, decoded: the sentence of each sequence. rows: seq_id, seg_pos, text."""
    named = rows.select("seq_id", "seg_pos", normalize_text(F.col("text")).alias("text")).filter("text <> ''")
    exact = lexicon_lookup(named, lexicon)
    open_texts = class_lookup(exact.filter("words IS NULL").select("text").distinct(), labelled)
    best = fuzzy_top(open_texts, candidates, k).filter("place = 1").select("text", "word")
    chosen = exact.join(best, "text", "left").withColumn("chosen", F.coalesce("words", "word", F.lit(UNKNOWN)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "chosen"))), lambda w: w["chosen"])
    return chosen.groupBy("seq_id").agg(words.alias("words")).select("seq_id", sentence(F.col("words")).alias("decoded"))


def decoded_records(lines: DataFrame, lexicon: DataFrame, candidates: DataFrame, labelled: DataFrame | None = None, k: int = TOP) -> DataFrame:
    """seq_id, line, decoded, confidence_percent of lines (seq_id, text), whose segments a bar parts."""
    rows = lines.select("seq_id", F.posexplode(F.split("text", r"\|")).alias("seg_pos", "text"))
    sentences, sure = decode(rows, lexicon, candidates, labelled, k), line_confidence(lines, candidates, k)
    found = lines.join(sentences, "seq_id", "left").join(sure, "seq_id")
    return found.select("seq_id", F.col("text").alias("line"), F.coalesce("decoded", F.lit("")).alias("decoded"), "confidence_percent")


def line_confidence(lines: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """seq_id, confidence_percent: the k best scores of a whole line over k, whatever their number. lines: seq_id, text."""
    asked = lines.select("text").distinct().withColumn("label", F.lit(UNKNOWN)).withColumn("probability", F.lit(0.5))
    total = fuzzy_top(asked, candidates, k).groupBy("text").agg(F.sum("score").alias("total"))
    return lines.join(total, "text", "left").select("seq_id", F.round(F.coalesce("total", F.lit(0.0)) / k * 100, 2).alias("confidence_percent"))


