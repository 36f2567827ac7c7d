"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> docs, each by one operator.

``docs`` is a table of files with the columns of documents; all stages but the last return those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as bpe_coding
from . import exact_dedup as exact
from . import language_id as languages
from . import mixing as mixtures
from . import near_dedup as near
from .common import WORD, free_names

#: The last stage runs in executors that the others have filled, so its memory is a quarter of the operator's own.
REMEMBERED = 100_000
#: The near-duplicate stage's threshold; op7 has its own.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null and empty texts and those without a letter.

    Very long texts are judged whole, equal rows alike, whatever their ids; an empty table stays empty.
    """
    return languages.kept_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of those with equal text: that of the largest id, of equal ids the last by place.

    A null text equals an empty one; a null id is smaller than every id; an empty table stays empty.
    """
    return exact.dropped_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of near duplicates: that of the smallest id, of equal ids the first by file and row.

    Every row is judged by its own text, whatever other rows of its id hold; rows of null id and texts without words
    are linked with nothing and stay; an empty table stays empty.
    """
    return near.dropped_near_duplicates(docs, percent=NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; what it takes in part comes as its words.

    A piece of a document keeps the document's id, language and source. Its text is its words with
    single spaces between, as many as were taken; n_chars is that of the piece. Shares belong to rows,
    by file and row in it, so rows of equal or null id each come by their own. A null source is a source;
    null and empty texts have no words and are not taken; an empty table stays empty. docs must come from
    files; its columns may have any names but ``_metadata``.
    """
    file, row, size, piece, n_rounds, head, first, run = free_names(docs, "file", "row", "size", "piece", "rounds", "head", "first", "run")
    columns = docs.columns
    rows = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    parts = mixtures.mix(rows.select("doc_id", "text", "source", F.col(file).alias("_in_file"), F.col(row).alias("_in_row")), keys=("_in_file", "_in_row")).filter("taken > 0")
    parts = parts.select(F.col("_in_file").alias(file), F.col("_in_row").alias(row), F.col("size").alias(size), F.col("rounds").alias(n_rounds), F.col("head").alias(head), F.col("first").alias(first), F.col("run").alias(run))
    none = F.lit(0).cast("long")
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.col(n_rounds), F.lit(1))), lambda _: F.struct(none.alias("at"), F.col(size).alias("n")))
    pieces = F.concat(
        F.when(F.col(n_rounds) > 0, whole).otherwise(F.slice(whole, 1, 0)),
        F.filter(F.array(F.struct(none.alias("at"), F.col(head).alias("n")), F.struct(F.col(first).alias("at"), F.col(run).alias("n"))), lambda p: p["n"] > 0),
    )
    joined = rows.join(parts.select(file, row, size, F.explode(pieces).alias(piece)), [file, row])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col(f"{piece}.at") + 1).cast("int"), F.col(f"{piece}.n").cast("int")), " ")
    is_whole = F.col(f"{piece}.n") == F.col(size)
    text = F.when(is_whole, F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).withColumn("n_chars", F.when(is_whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids (array<int>; of a null or empty text an empty one) and drops the text; all rows stay.

    An own column ``tokens`` is called ``_tokens`` then; other columns keep their names.
    """
    import public_tokenizers

    found = bpe_coding.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered=REMEMBERED)
    return found.drop("text")
