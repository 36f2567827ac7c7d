"""Readers of text inputs. Lines are numbered through all files of an input, in the order of their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_text


def lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line_no from 0, value), CRLF and LF alike; an empty last line is none.

    keep: a condition on value; lines that don't meet it are left out and not counted. Large files are
    read in splits: a line's number is its place in its split, after the lines of the splits before it,
    which are counted in one row a split.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    found = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), *split, F.monotonically_increasing_id().alias("place"))
    if keep is not None:
        found = found.filter(keep)
    own = W.partitionBy("file", "block").orderBy("place")
    inside = found.select("file", "block", "value", (F.row_number().over(own) - 1).alias("inside"))
    counts = found.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return inside.join(starts, ["file", "block"]).select((F.col("start") + F.col("inside")).alias("line_no"), "value")


def integers(tokens: Column) -> Column:
    """The first integer of each token; tokens without one are left out."""
    found = F.transform(tokens, lambda t: F.regexp_extract(t, r"(-?\d+)", 1))
    return F.transform(F.filter(found, lambda t: t != ""), lambda t: t.cast("long"))


def parse_sequence(line: Column) -> Column:
    """A line as array<bigint>: one pair of enclosing brackets goes, ``; , |`` separate like blanks."""
    bare = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", ""))
    inner = bare
    for a, b in ("()", "[]", "{}"):
        inner = F.when(bare.startswith(a) & bare.endswith(b) & (F.length(bare) >= 2), bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(inner)
    spaced = F.regexp_replace(inner, r"[;,|]+", " ")
    return integers(F.filter(F.split(spaced, r"\s+"), lambda t: t != ""))


def parse_segments(line: Column) -> Column:
    """A segmented line as array<array<bigint>>; an empty part is an empty segment."""
    bare = F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", "")
    parts = F.transform(F.split(bare, r"\|"), lambda p: integers(F.filter(F.split(p, r"[;,|\s]+"), lambda t: t != "")))
    return F.when(bare == "", F.slice(parts, 1, 0)).otherwise(parts)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, symbols array<string>) for symbol statistics: commas are blanks, empty lines go."""
    tokens = F.filter(F.split(F.regexp_replace("value", ",", " "), r"\s+"), lambda t: t != "")
    return lines(spark, path).select(F.col("line_no").cast("long").alias("seq_id"), tokens.alias("symbols")).filter(F.size("symbols") > 0)


def read_sequences(spark: SparkSession, path: str, first_cell: bool = False) -> DataFrame:
    """(seq_id, symbols array<bigint>); blank lines stay as empty sequences.

    first_cell: only the first cell that isn't empty counts, and blank lines go, as where a comma file
    is taken for a table. A cell in double quotes may hold commas, and a doubled quote stands for one.
    """
    found = lines(spark, path)
    if first_cell:
        raw = F.regexp_extract_all("value", F.lit(r'\s*("(?:[^"]|"")*"|[^,"]*)\s*(?:,|$)'), F.lit(1))
        bare = F.transform(raw, lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')).otherwise(c))
        cells = F.filter(bare, lambda c: F.trim(c) != "")
        found = found.filter(F.trim("value") != "").withColumn("value", F.get(cells, F.lit(0)))
    return found.select(F.col("line_no").cast("long").alias("seq_id"), parse_sequence(F.col("value")).alias("symbols"))


def read_segmented(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, segments array<array<bigint>>); blank lines count as empty sequences."""
    return lines(spark, path).select(F.col("line_no").cast("long").alias("seq_id"), parse_segments(F.col("value")).alias("segments"))


def segment_rows(sequences: DataFrame) -> DataFrame:
    """seq_id, seg_pos, n_segs, seg_key, tokens of (seq_id, segments)."""
    each = sequences.select("seq_id", F.size("segments").cast("long").alias("n_segs"), F.posexplode("segments").alias("seg_pos", "tokens"))
    return each.select("seq_id", "seg_pos", "n_segs", F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").alias("seg_key"), "tokens")


def read_scalar_map(spark: SparkSession, path: str) -> DataFrame:
    """(sym, value) of lines ``symbol value``, by tab, comma, semicolon or blank; the last line of a symbol wins.

    What is no number is tried once more by its first integer or decimal, else its line is left out.
    """
    parts = F.filter(F.split(F.trim("value"), r"[\t,;\s]+"), lambda t: t != "")
    key, value = F.get(F.col("parts"), F.lit(0)), F.get(F.col("parts"), F.lit(1))
    pairs = lines(spark, path).select("line_no", parts.alias("parts")).filter(F.size("parts") >= 2)
    pairs = pairs.select(
        "line_no",
        F.coalesce(key.try_cast("long"), F.regexp_extract(key, r"(-?\d+)", 1).try_cast("long")).alias("sym"),
        F.coalesce(value.try_cast("double"), F.regexp_extract(value, r"([-+]?\d*\.?\d+)", 1).try_cast("double")).alias("value"),
    ).dropna()
    return pairs.groupBy("sym").agg(F.max_by("value", "line_no").alias("value"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): trimmed lines, blank ones left out and the others numbered without them."""
    trimmed = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines(spark, path, trimmed != "").select("line_no", trimmed.alias("value"))


def phrase_corpus(phrases: DataFrame) -> DataFrame:
    """(cand_id, text): normalized phrases (line_no, value) without repetitions, by first place."""
    named = phrases.select(F.col("line_no").cast("long").alias("line_no"), normalize_text(F.col("value")).alias("text")).filter("text <> ''")
    return named.groupBy("text").agg(F.min("line_no").alias("cand_id"))


def lexicon_map(rows: DataFrame, line_col: str = "line_no") -> DataFrame:
    """(key, words) from rows with some of seal_id, seg_key and words, word, tamil; the last line wins."""

    def first(*names: str) -> Column:
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
        return normalize_text(F.coalesce(*there, F.lit("")))

    named = rows.select(F.col(line_col).alias("line_no"), first("seal_id", "seg_key").alias("key"), first("words", "word", "tamil").alias("words"))
    return named.filter("key <> '' AND words <> ''").groupBy("key").agg(F.max_by("words", "line_no").alias("words"))


_REPRESENTATIVE = "struct<seg_key:string,seg_id:string,freq:bigint,assigned_label:string,label_sequence:array<string>,post_commodity:double,post_title:double,post_proper_name:double>"
SUMMARY_SCHEMA = f"n_segments bigint, n_sequences bigint, class_counts map<string,bigint>, avg_posteriors map<string,double>, representatives map<string,array<{_REPRESENTATIVE}>>"


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon summary, one row."""
    return spark.read.schema(SUMMARY_SCHEMA).json(path, multiLine=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A comma file with a header, with line_no in the order of the input; its column names are trimmed."""
    header = spark.read.option("header", True).csv(path).columns
    rows = spark.read.option("header", True).csv(path).select("*", F.monotonically_increasing_id().alias("line_no"))
    return rows.select(*[F.col(f"`{c}`").alias(c.strip("\u00a0 \ufeff")) for c in header], "line_no")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """seg_key, label and posteriors of JSON files: one object each or a list of them, or of files of objects by line.

    An object names its segment seg_key or seal_key and its class assigned_label or label; what is no
    object, or names no segment, gives no row.
    """
    schema = T.StructType.fromDDL("seg_key string, seal_key string, label string, assigned_label string, post_commodity double, post_title double, post_proper_name double")
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    objects = lambda texts: F.transform(F.filter(texts, lambda x: F.trim(x).startswith("{")), lambda x: F.from_json(x, schema))
    by_line, listed = objects(F.split("value", r"\r?\n")), objects(F.from_json("value", T.ArrayType(T.StringType())))
    one = F.array(F.from_json("value", schema))
    found = F.when(F.col("value").startswith("["), listed).when(F.col("value").rlike(r"(?s)\}\s*\n\s*\{"), by_line).when(F.col("value").startswith("{"), one)
    rows = text.select(F.explode(found).alias("o")).select("o.*")
    named = rows.select(F.coalesce("seg_key", "seal_key").alias("seg_key"), F.coalesce("assigned_label", "label").alias("label"), "post_commodity", "post_title", "post_proper_name")
    return named.filter("seg_key IS NOT NULL")
