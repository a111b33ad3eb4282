"""The shared folder, and tables settled there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    folder of its own; a cluster has no safe default, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that this process has settled tables in and not deleted, oldest first.
_settled: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from those files.

    Cuts lineage in a way that outlives executors, and lets several consumers
    share one computation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _settled.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}


def forget(*settled: DataFrame) -> None:
    """Delete the folders of settled tables that no plan reads any more."""
    for df in settled:
        _clear(df.sparkSession, lambda name, gone=_folders(df): name in gone)


def settled_so_far() -> int:
    """A mark for ``clean``."""
    return len(_settled)


def clean(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what was settled after a mark, but for the tables that are still read."""
    kept = set().union(*map(_folders, keep))
    later = {p.rpartition("/")[2] for p in _settled[since:]}
    _clear(spark, lambda name: name in later - kept)


def _clear(spark: SparkSession, gone: Callable[[str], bool]) -> None:
    for path in [p for p in _settled if gone(p.rpartition("/")[2])]:
        _delete(spark, path)
        _settled.remove(path)
