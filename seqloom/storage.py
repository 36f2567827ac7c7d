"""Where steps keep what they write on the way: the shared folder that the cluster names.

The folder is the one in ``spark.checkpoint.dir``. Only where that is unset and the master is local, as
in tests, a temporary one is set: driver and executors are one process then. Elsewhere that is an error,
for other machines would not see the files.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()

#: Texts may be megabytes long, so the writer looks at the size of a page after each few rows, not after 100:
#: codecs hold whole pages outside the heap.
_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "100", "parquet.block.size.row.check.min": "10"}


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: steps need a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder; deleted at the end of the enclosing ``settled``."""
    path = f"{checkpoint_root(spark)}/seqloom/{purpose}-{uuid.uuid4().hex}"
    open_scopes = getattr(_scopes, "open", [])
    if open_scopes:
        open_scopes[-1].append(path)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again with the same schema."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.options(**_PAGES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at the end what is stored inside, whose paths the list gets."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield _scopes.open[-1]
    finally:
        removed(spark, _scopes.open.pop())


def settled(spark: SparkSession, purpose: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` gives, stored; all that make stored on the way is deleted."""
    return settled_all(spark, purpose, lambda: (make(),))[0]


def settled_all(spark: SparkSession, purpose: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The frames that ``make`` gives, each stored; all that make stored on the way is deleted."""
    outer, out = [], []
    try:
        with clearing(spark):
            for df in make():
                outer.append(f"{checkpoint_root(spark)}/seqloom/{purpose}-{uuid.uuid4().hex}")
                df.write.options(**_PAGES).parquet(outer[-1])
                out.append(spark.read.schema(df.schema).parquet(outer[-1]))
    except BaseException:
        removed(spark, outer)
        raise
    if getattr(_scopes, "open", []):
        _scopes.open[-1] += outer
    return tuple(out)


def tidy(spark: SparkSession, purpose: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` gives: as it is if nothing was stored on the way, else ``settled``."""
    path = f"{checkpoint_root(spark)}/seqloom/{purpose}-{uuid.uuid4().hex}"
    with clearing(spark) as stored_paths:
        df = make()
        if stored_paths:
            df.write.options(**_PAGES).parquet(path)
            df = spark.read.schema(df.schema).parquet(path)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that were made here."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
