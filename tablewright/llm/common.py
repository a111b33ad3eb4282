"""What several operators need: joins by size and skew, text batches, settled tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.scratch import forget, new_path, settle, shared_dir

__all__ = ["by_ids", "fold_case", "forget", "join_skewed", "let", "new_path", "read", "settle", "shared_dir", "small", "text_batches"]

#: The six ASCII white-space characters between words.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of whole texts that one Arrow batch may hold; keeps Python workers' memory flat.
TEXT_ROWS = 512
#: Ids that may be broadcast.
BROADCAST_IDS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, which are counted, are few; else marked to be hashed after a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df.hint("shuffle_hash")


def by_ids(df: DataFrame, ids: DataFrame, how: str, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Semi or anti join on ids, which are broadcast only when few."""
    return df.join(small(ids), list(on), how)


#: Keys that hold more than one in so many rows, and at least so many rows, are hot.
HOT_SHARE, HOT_ROWS = 10_000, 200


def join_skewed(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    count: str,
    n: int,
    how: str = "inner",
    narrow: bool = False,
) -> DataFrame:
    """Inner or left join of ``n`` rows with a table of one row a key, on keys that aren't null.

    ``count`` names the table's column with the number of rows that have the key.
    A ``narrow`` table of few rows, which are counted, is sent to all tasks. Else a
    hot key's table row is copied once for so many rows as aren't hot, and its rows
    are dealt over the copies; all meet in one shuffle on key and copy. There are at
    most ``HOT_SHARE`` hot keys, whose numbers are sent to all tasks.
    """
    if narrow and table.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(table), key, how)
    most = max(n // HOT_SHARE, HOT_ROWS)
    if n <= most:
        return rows.join(table, key, how)
    copies = F.ceil(F.col(count) / F.lit(most)).cast("int")
    hot = F.broadcast(table.filter(F.col(count) > most).select(key, copies.alias("__copies")))
    deal = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__copies")).cast("int"), F.lit(0))
    dealt = rows.join(hot, key, "left").withColumn("__copy", deal).drop("__copies")
    copied = table.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(copied, [key, "__copy"], how).drop("__copy")


_shipped: set[str] = set()


def text_batches(spark: SparkSession) -> None:
    """Before whole texts go to Python: bound the rows of an Arrow batch, ship this package once.

    The bound is a setting of the session, read when plans run, and stays set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tablewright.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((top / "tablewright").rglob("*.py")):
                z.write(f, f.relative_to(top))
        spark.sparkContext.addPyFile(str(archive))  # Spark hands it to the executors
        _shipped.add(app)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def fold_case(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
