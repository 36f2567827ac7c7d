"""Operator 13: line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, in lower case; keys of ``least_chars`` code
points found in ``least_docs`` documents lose all their lines but those of the document of largest id.

``LineRuns`` keeps what earlier lines were: runs of (key, n, top), a key's hash, the number of documents that
hold it and the largest of their ids. Each file of a run is sorted by key. A new batch is a run on level 0;
when a level has ``fanout`` runs they are merged into one of the next level, so a key is rewritten a number of
times that grows with the logarithm of the batches, and a reader meets few runs. A batch loses its lines by a
sort-merge anti-join with the runs, and adds its own run. Where documents arrive one batch after the other
(``arrived``), the join comes first, and the run holds the keys that it lets through. Where all lines of a table
are decided together (``deduplicated``), a later batch may take a line from an earlier one, so all batches add
their runs before they are joined; of that join the lines that go are taken, which are fewer than those that stay.

What is shuffled are hashes, ids and counts, a key once for each document that holds it; copies of a key fall
together inside a task before they are dealt, so a line that a third of all documents hold is a few rows a task
where it is counted. Where its documents are joined with it, both sides are dealt for that join alone, whose
large parts Spark splits. Texts are dealt once, by id, to meet the hashes that they lose.

Keys meet by 128-bit hashes (MD5), that of a key of valid UTF-8.

Defined cases: a null text is an empty one, which is one empty line; rows of equal id are one document that
holds the lines of all, and each loses its own; rows of null id are one document too, of a smaller id than all;
the lines of a key that repeat in the document that keeps it stay; an empty table gives an empty result;
further columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import removed
from .common import free_names, settled, shared_dir, stored, table

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Runs of a level that are merged, and how many batches a table that comes at once is taken in.
FANOUT, BATCHES = 3, 4
BLANKS = b" \t\n\v\f\r"
_RUN, _MANIFEST = "key binary, n long, top long", "level int, run long, written long"


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The hash of a line's key, or none if the key is short. Bytes are lowered as A-Z alone."""
    key = line.strip(BLANKS).lower()
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode()) < least_chars):
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _lines(value) -> list[bytes]:
    return (value.as_buffer().to_pybytes() if value.is_valid else b"").split(b"\n")


def document_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, key): each key of a row once."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                own = {line_key(x, least_chars) for x in _lines(text)} - {None}
                keys += own
                ids += [i.as_py()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, key binary")


class LineRuns:
    """Levelled runs of (key, n, top) in a shared folder. Runs are never changed.

    Where the runs are to outlive the driver (``durable``), each change ends with a manifest of the runs that count, and
    what it replaces is deleted only then: a folder is opened again at its last manifest, and what an ``add`` that failed
    has left counts for nothing. levels: per level the paths of its runs.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, durable: bool = True):
        self.spark, self.folder, self.fanout, self.durable = spark, folder.rstrip("/"), fanout, durable
        self.levels: list[list[str]] = []
        self.written = self.version = 0
        if durable:
            self._opened()

    def _opened(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest=*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place) or []
        self.version = max((int(f.getPath().getParent().getName().partition("=")[2]) for f in found), default=0)
        if self.version:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest={self.version}").orderBy("level", "run").collect()
            self.written = max(r["written"] for r in rows)
            for r in rows:
                self.levels += [[] for _ in range(r["level"] + 1 - len(self.levels))]
                self.levels[r["level"]].append(f"{self.folder}/level={r['level']}/run={r['run']}")

    def _write(self, level: int, rows: DataFrame) -> None:
        path = f"{self.folder}/level={level}/run={self.written}"
        self.written += 1
        rows.sortWithinPartitions("key").write.mode("overwrite").parquet(path)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(path)

    def _committed(self, replaced: list[str]) -> None:
        """The runs of now are those that count; the replaced ones go."""
        if self.durable:
            rows = [(level, int(p.rpartition("=")[2]), self.written) for level, paths in enumerate(self.levels) for p in paths]
            self.version += 1
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest={self.version}")
            replaced = [*replaced, f"{self.folder}/manifest={self.version - 1}"]
        removed(self.spark, replaced)

    def _merged(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_RUN).parquet(*paths)
        return rows if len(paths) == 1 else rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def add(self, keys: DataFrame) -> None:
        """The run of a batch of (id, key), and the merges that it causes."""
        once = keys.distinct()
        self._write(0, once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")))
        level, replaced = 0, []
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(level + 1, self._merged(full))
            replaced += full
            level += 1
        self._committed(replaced)

    def rows(self) -> DataFrame:
        """(key, n, top) over all runs."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths) if paths else self.spark.createDataFrame([], _RUN)

    def losses(self, keys: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
        """The (id, key) that the anti-join with the runs takes away: keys of enough documents, of which ``id``
        isn't the largest. keys: distinct."""
        common = stored(self.rows().filter(F.col("n") >= least_docs).select("key", "top"), "line-common")
        return keys.join(common.hint("merge"), "key").filter(~F.col("id").eqNullSafe(F.col("top"))).select("id", "key")


def _without(docs: DataFrame, losses: DataFrame, id_col: str, text_col: str, least_chars: int, make, schema: T.StructType) -> DataFrame:
    """docs joined by id with the keys that it loses, through make(batch, kept lines, numbers of lines before)."""
    own, lost = free_names(docs, "of", "lost")
    per = losses.groupBy(F.col("id").alias(own)).agg(F.collect_list("key").alias(lost))
    joined = docs.withColumn(text_col, F.col(text_col).cast("string")).join(per, F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left").drop(own)
    t = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept, before = [], []
            for text, gone in zip(batch.column(t), batch.column(batch.num_columns - 1), strict=True):
                lines = _lines(text)
                before.append(len(lines))
                if gone.is_valid:
                    keys = set(gone.as_py())
                    lines = [x for x in lines if line_key(x, least_chars) not in keys]
                kept.append(lines)
            yield make(pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]), kept, before)

    return joined.mapInArrow(run, schema)


def _decided(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """(id, key) of the lines that a table loses which comes at once, in batches of whole documents."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch")
    keys = stored(document_keys(docs, id_col, text_col, least_chars).select("id", "key", batch), "line-keys")
    runs = LineRuns(spark, shared_dir(spark, "line-runs"), fanout, durable=False)
    for k in range(batches):
        runs.add(keys.filter(F.col("batch") == k).select("id", "key"))
    return runs.losses(keys.select("id", "key").distinct(), least_docs)


def _with_texts(batch, at: int, lines: list[list[bytes]]):
    """The batch with lines as its texts; null ones stay null."""
    texts = [b"\n".join(x).decode() if was.is_valid else None for x, was in zip(lines, batch.column(at), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with the texts that are left; all rows and other columns stay. Null texts without losses stay null."""
    kept = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = kept.columns.index(text_col)

    def make(batch, lines, _):
        return _with_texts(batch, at, lines)

    def whole():
        return _without(kept, _decided(docs, id_col, text_col, least_chars, least_docs, batches, fanout), id_col, text_col, least_chars, make, kept.schema)

    return settled(docs.sparkSession, "line-dedup", whole)


def arrived(docs: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """One batch of a growing corpus: its texts without the lines whose keys the runs hold, after which the keys
    that they lacked are a run of their own. The first batch that brings a line keeps it, and may hold it several
    times. A key is then in one run only."""
    kept = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = kept.columns.index(text_col)

    def make(batch, lines, _):
        return _with_texts(batch, at, lines)

    def whole():
        keys = stored(document_keys(docs, id_col, text_col, least_chars).distinct(), "line-keys")
        seen = runs.rows().select("key").hint("merge")
        fresh = stored(keys.join(seen, "key", "left_anti"), "line-fresh")
        known = keys.join(seen, "key", "left_semi").select("id", "key")
        found = stored(_without(kept, known, id_col, text_col, least_chars, make, kept.schema), "line-batch")
        runs.add(fresh.select("id", "key"))
        return found

    return settled(docs.sparkSession, "line-arrived", whole)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, kept_sha256."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType.fromDDL("id long, n_lines long, n_dropped long, kept_sha256 string")

    def make(batch, lines, before):
        n = [b - len(x) for b, x in zip(before, lines, strict=True)]
        hashes = [hashlib.sha256(b"\n".join(x)).hexdigest() for x in lines]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, pa.string())], schema.names)

    def whole():
        return _without(texts, _decided(docs, id_col, text_col, least_chars, least_docs, batches, fanout), "id", "text", least_chars, make, schema)

    return settled(docs.sparkSession, "line-digests", whole)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.line, k.place, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
