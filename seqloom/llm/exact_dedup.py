"""Operator 10: exact deduplication over streaming state.

The rows go through a Structured Streaming aggregation whose state lives in RocksDB, keyed by the
SHA-256 of the text and without expiry. For each digest the state retains the stable identifier of
the row that stays (the largest id), the locator of its content (file and row in it) and a count.
Every hit is then checked on full bytes: rows whose digest occurs more than once are grouped by
digest *and* text, and a digest that stands for more than one text is split by text.

Only digests, ids and locators are shuffled for the decision; the full texts that move are one
per task of each text that has copies, since the grouping combines before it shuffles.

The state outlives a call where it is given a folder (``state_dir``): rows that come later meet what came
before, and the rows that stay are decided over both. The rows of earlier calls are then given too, as the
content that locators point to. What a call brings has a name, and the state takes each name once.

Defined cases: a null text counts as the empty text; an empty table gives an empty result; rows
that repeat both id and text are copies of each other and one of them stays (the last by locator);
a null id is smaller than every id; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists
from .common import free_names, has_rows_of_files, of_files, settled, shared_dir, stored, table

#: State on disk; many small stores need no space set aside in advance.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests of repeated texts (32 bytes each) are broadcast up to this count, beyond it they are joined by shuffle.
BROADCAST_DIGESTS = 200_000
#: Files that a micro-batch takes.
FILES_PER_BATCH = 1_000


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest, file, row): file and row are the locator of the content. Rows that come from no file
    are written first, for their place to be the same whenever it is asked for."""
    if not has_rows_of_files(docs):
        docs = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "dedup-rows")
        id_col, text_col = "id", "text"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("body"), F.unhex(F.sha2(text, 256)).alias("digest"),
        file.alias("file"), row.alias("row"),
    )


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful step, for a stream or a static frame of (digest, id, file, row)."""
    return stream.groupBy("digest").agg(
        F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n")
    )


def stream_groups(spark: SparkSession, staged: str, schema, state: str, out: str) -> DataFrame:
    """Runs the files of ``staged`` that are new through the keyed state; one row per digest with keep and n.

    state holds the keyed state and which files it has seen, out its updates.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(staged)
        query = (
            keyed_state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    updates = keyed_state(spark.createDataFrame([], schema)).withColumn("batch", F.lit(0))
    try:
        found = spark.read.schema(updates.schema).parquet(out)
    except AnalysisException as e:  # no micro-batch ran: there was no row
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = updates
    # counts only grow, so a digest's last update is the one with the largest count
    return found.groupBy("digest").agg(F.max_by("keep", "n").alias("keep"), F.max("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_digests: int = BROADCAST_DIGESTS, state_dir: str | None = None, earlier: DataFrame | None = None, arrival: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, file, row.

    state_dir: a shared folder in which the state is kept between calls; earlier: the rows of the calls
    before, with the columns of docs, whose texts are compared in full where digests meet. arrival: a name of what
    comes in this call, by default a digest of the names, sizes and times of its files. An arrival whose name the state has
    seen isn't counted again, so a call that failed at any point can be repeated.
    """
    spark = docs.sparkSession
    return settled(spark, "dedup", lambda: _exact_dedup(spark, docs, id_col, text_col, broadcast_digests, state_dir, earlier, arrival))


def _arrival(docs: DataFrame) -> str:
    """A digest of the files that rows come from; a new name each time where they come from none."""
    if not has_rows_of_files(docs):
        return uuid.uuid4().hex
    each = F.sha2(F.concat_ws(":", "_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time")), 256)
    files = docs.select(each.alias("f")).distinct().agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("all"))
    return files.select(F.sha2("all", 256)).first()[0]


def _exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, broadcast_digests: int, state_dir: str | None, earlier: DataFrame | None, arrival: str | None) -> DataFrame:
    own = _located(docs, id_col, text_col)
    located = own if earlier is None else own.unionByName(_located(earlier, id_col, text_col))
    place = state_dir.rstrip("/") if state_dir else shared_dir(spark, "dedup-state")
    narrow, arrived = own.drop("body"), f"{place}/digests/{(arrival or _arrival(docs)) if state_dir else 'all'}"
    if not exists(spark, f"{arrived}/_SUCCESS"):  # else an earlier call has written it, and the stream knows its files
        narrow.write.mode("overwrite").parquet(arrived)
    rows = spark.read.schema(narrow.schema).parquet(arrived)
    groups = stored(stream_groups(spark, f"{place}/digests/*", narrow.schema, f"{place}/state", f"{place}/groups"), "dedup-final")

    # full bytes of every hit
    multiple = groups.filter("n > 1").select("digest")
    n_multiple = multiple.count()
    hits = multiple if n_multiple > broadcast_digests else F.broadcast(multiple)
    texts = located.join(hits, "digest", "left_semi").groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    collided = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    if n_multiple and not collided.isEmpty():
        by_text = located.join(collided, "digest", "left_semi")
        kept = by_text.groupBy("digest", "body").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        split = own.join(collided, "digest", "left_semi").join(kept, ["digest", "body"]).drop("body")
        decided = rows.join(collided, "digest", "left_anti").join(groups, "digest").unionByName(split)
    else:
        decided = rows.join(groups, "digest")
    return decided.select(
        "id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "file", "row",
    )


def dropped_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are copies; all columns as they came. Null texts are copies of each other
    and of empty ones. Rows that come from no file, or have a column ``_metadata``, are written first."""
    docs, hidden = of_files(docs, "dedup-rows")
    columns = docs.columns
    file, row, own_file, own_row = free_names(docs, "gone_file", "gone_row", "own_file", "own_row")
    gone = exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("file").alias(file), F.col("row").alias(row))
    place = docs.select("*", F.col("_metadata.file_path").alias(own_file), F.col("_metadata.row_index").alias(own_row))
    held = place.join(gone, (F.col(own_file) == F.col(file)) & (F.col(own_row) == F.col(row)), "left_anti")
    return held.select(*columns).withColumnRenamed(hidden, "_metadata") if hidden else held.select(*columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
