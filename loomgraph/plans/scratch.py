"""Tables that an operator writes on its way, in the folder that all executors share.

An operator drops what its result no longer reads. What a lazy result does read stays, and goes by ``clear`` once the
results are written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders that were named and not yet removed; of them those of the innermost ``within`` of this thread.
_standing: set[str] = set()
_own: ContextVar[set[str] | None] = ContextVar("own", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    _standing.add(folder)
    if (own := _own.get()) is not None:
        own.add(folder)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialize`` or ``scratch_path`` named, with the folder that was made for it."""
    folder = path.rpartition("/")[0]
    _standing.discard(folder)
    _delete(spark, folder if "/loomgraph-" in folder else path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._scratch_path)


@contextmanager
def within(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is written within goes at the end, but for the tables that are put into the list."""
    outer, kept = _own.get(), []
    own: set[str] = set()
    _own.set(own)
    try:
        yield kept
    finally:
        _own.set(outer)
        stay = {t._scratch_path.rpartition("/")[0] for t in kept}
        for folder in own & _standing:
            if folder not in stay:
                _standing.discard(folder)
                _delete(spark, folder)
            elif outer is not None:
                outer.add(folder)


def clear(spark: SparkSession) -> int:
    """Delete all tables that still stand; how many. No result that was not written may be read afterwards."""
    count = len(_standing)
    while _standing:
        _delete(spark, _standing.pop())
    return count
