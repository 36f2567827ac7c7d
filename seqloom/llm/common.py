"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settled, shared_dir, stored

__all__ = ["WORD", "checkpointed", "free_names", "has_rows_of_files", "of_files", "settled", "shared_dir", "stored", "table", "with_row_number"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, as a table in the shared folder."""
    return stored(df, "step")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def has_rows_of_files(docs: DataFrame) -> bool:
    """Whether the rows of docs can be told apart by file and row in it."""
    if "_metadata" in docs.columns:
        return False
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def of_files(docs: DataFrame, purpose: str) -> tuple[DataFrame, str | None]:
    """docs, written first if its rows come from no file or it has a column ``_metadata``, and the name that such a column has then."""
    if has_rows_of_files(docs):
        return docs, None
    (hidden,) = free_names(docs, "metadata")
    own = "_metadata" in docs.columns
    return stored(docs.withColumnRenamed("_metadata", hidden) if own else docs, purpose), hidden if own else None


def with_row_number(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of each row, the same whenever it is asked for: of its file, and of the row in it.

    docs must come from files; their names, which a scan's driver holds anyway, go to all tasks with a number each.
    """
    path, row, own, number = free_names(docs, "path", "row", "own_path", "number")
    named = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    files = sorted(r[0] for r in docs.select(F.col("_metadata.file_path")).distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], f"{own} string, {number} long")
    joined = named.join(F.broadcast(numbers), F.col(path) == F.col(own))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(number) * (1 << 38) + F.col(row)).alias(name))
