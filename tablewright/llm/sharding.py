"""Proportional stratified interleaving into shards, in DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional
rank is (rank + the source's seeded start in [0, 1)) / rows of the source. All
rows sorted by fractional rank are cut into runs whose counts differ by one at
most, so each shard holds every source in proportion.

Both rankings are done in buckets with prefix sums of bucket counts, so no task
ever holds a whole source or the whole table. At most 65,536 bucket counts meet
in one place, however many rows there are.

Defined cases: a null text has size 1 and CRC 0; null sources form one source;
rows without an id, or with a repeated one, are told apart by their texts, which
the shuffling hash covers too; rows that are equal in doc_id and text are
interchangeable; texts of any length count whole; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SEED = "interleave-1"


def _unit(hex_digits: Column) -> Column:
    """The first eight hex digits as a double in [0, 1)."""
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def interleave(docs: DataFrame, shards: int = 8, stratum: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, stratum, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), crc.cast("string"))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.md5(name.cast("binary")).alias("h"),
    )
    rows = settle(rows, "shard-rows")
    n = rows.count()
    buckets = 256
    while buckets < 65536 and n > buckets * 4096:
        buckets *= 2

    rows = rows.withColumn("bucket", F.floor(_unit(F.col("h")) * buckets).cast("int"))
    whole = Window.partitionBy("stratum")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    starts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("stratum", "bucket", before, F.sum("n").over(whole).alias("total"))
    place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size"))
    start = _unit(F.md5(F.concat(F.lit(seed + "/"), F.col("stratum"))))
    share = (F.col("before") + F.col("place") - 1 + start) / F.col("total")
    ranked = rows.withColumn("place", place).join(starts, ["stratum", "bucket"])
    ranked = settle(ranked.select("doc_id", "size", "text_crc32", "stratum", "h", share.alias("share")), "shard-ranks")

    ranked = ranked.withColumn("bucket", F.floor(F.col("share") * buckets).cast("int"))
    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("share", "h", "stratum", "doc_id", "text_crc32", "size"))
    at = ranked.withColumn("place", place).join(counts.select("bucket", before.alias("before")), "bucket")
    at = at.withColumn("at", F.col("before") + F.col("place") - 1)
    shard = F.expr(f"CAST(at * {shards} DIV {max(n, 1)} AS INT)")
    first = F.expr(f"(shard * {n}L + {shards - 1}) DIV {shards}")
    return at.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "stratum", "shard", (F.col("at") - first).cast("long").alias("slot"))
