"""Grouped aggregation by one column; null is a group."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import NUMBERS
from ..schema import TableDef, TableError


def function(definition: TableDef, name: str, func: str) -> SparkColumn:
    """sum and avg are doubles that skip nulls and non-numbers; count counts rows; max is null if any value is."""
    kind, c = definition.column(name).kind, F.col(f"`{name}`")
    if func == "count":
        return F.count(F.lit(1))
    if func == "min":
        return F.min(c)
    if func == "max":
        return F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.max(c))
    if func in ("sum", "avg"):
        of = F.sum if func == "sum" else F.avg
        return F.coalesce(of(c.cast("double")), F.lit(0.0)) if kind in NUMBERS else F.coalesce(F.max(F.lit(0.0)), F.lit(0.0))
    raise TableError(f"Unknown aggregation function: {func}")


def aggregate_group(df: DataFrame, definition: TableDef, key: str, functions: list[tuple[str, str]], where: SparkColumn | None = None) -> DataFrame:
    """The key and a column ``func_name`` for each (name, func), over rows that pass the filter."""
    definition.column(key)
    columns = [function(definition, name, func).alias(f"{func}_{name}") for name, func in functions]
    rows = df if where is None else df.filter(where)
    return rows.groupBy(F.col(f"`{key}`")).agg(*columns)


def group_by(df: DataFrame, definition: TableDef, key: str, where: SparkColumn | None = None) -> DataFrame:
    """Each key with its number of rows; ``Table.group`` gives one group's rows, so none is gathered in one place."""
    definition.column(key)
    rows = df if where is None else df.filter(where)
    return rows.groupBy(F.col(f"`{key}`")).agg(F.count(F.lit(1)).alias("n_rows"))


def group_rows(df: DataFrame, definition: TableDef, key: str, where: SparkColumn | None = None) -> DataFrame:
    """All rows in order of the key, null first; ranges are cut within a key too, so no group is gathered in one task."""
    definition.column(key)
    rows = df if where is None else df.filter(where)
    k = F.col(f"`{key}`")
    return rows.repartitionByRange(k, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).sortWithinPartitions(k)
