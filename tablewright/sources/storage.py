"""Tables and views as CSV or Parquet folders.

CSV keeps values exactly: ``\\N`` is null, quotes are doubled, padding and line
breaks stay. Columns that CSV has no type for go as text and are parsed by the
declared type on the way back. A folder is written whole and never read and
replaced in one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Kind, displayed, parsed
from ..operators.constraints import ORDINAL
from ..schema import TableDef, TableError
from ..table import Table

#: How text cells are written and read.
COMMON = {"header": True, "escape": '"', "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def table_path(folder: str, db: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{db}.{name}.csv"


def view_path(folder: str, db: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{db}.{name}.view.csv"


def _text(table: Table) -> DataFrame:
    columns = []
    for c in table.definition.columns:
        x = F.col(f"`{c.name}`")
        if c.kind is Kind.DATETIME:
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(displayed(x, c.kind, null=None).alias(c.name))
    return table.df.select(*columns)


def save_csv(table: Table, path: str) -> None:
    _text(table).write.mode("overwrite").options(quoteAll=True, **COMMON).csv(path)


def load_csv(spark: SparkSession, path: str, definition: TableDef, validate: bool = False) -> Table:
    """The saved rows; cells that aren't of the declared type, or rows of another width, stop the job."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in definition.names])
    raw = spark.read.schema(schema).options(multiLine=True, mode="FAILFAST", enforceSchema=False, **COMMON).csv(path)
    table = Table(raw.select(*(parsed(F.col(f"`{c.name}`"), c.kind).alias(c.name) for c in definition.columns)), definition)
    if validate:
        empty = Table.create(spark, definition.name, definition.columns, definition.primary_key)
        broken = empty.violations(table.df.withColumn(ORDINAL, F.monotonically_increasing_id())).orderBy(ORDINAL, "rule").limit(1).collect()
        if broken:
            raise TableError(broken[0]["message"])
    return table


def save_table(table: Table, folder: str, db: str) -> str:
    save_csv(table, path := table_path(folder, db, table.name))
    return path


def load_table(spark: SparkSession, folder: str, db: str, definition: TableDef, validate: bool = False) -> Table:
    return load_csv(spark, table_path(folder, db, definition.name), definition, validate)


def save_view(table: Table, folder: str, db: str, view: str, aliases: tuple[str, str] | None = None) -> str:
    """A view's rows as they are now; a join's view may carry the aliases of its sides."""
    name = f"{aliases[0]}.{aliases[1]}.{view}" if aliases else view
    save_csv(table, path := view_path(folder, db, name))
    return path


def load_view(spark: SparkSession, folder: str, db: str, view: str, definition: TableDef) -> Table:
    return load_csv(spark, view_path(folder, db, view), TableDef(view, definition.columns))


def save_parquet(table: Table, path: str) -> None:
    table.df.write.mode("overwrite").parquet(path)


def load_parquet(spark: SparkSession, path: str, definition: TableDef) -> Table:
    return Table(spark.read.parquet(path), definition)


def save_bucketed(table: Table, name: str, buckets: int) -> None:
    """A catalog table clustered by the first index, so that joins on it need no shuffle."""
    if not table.definition.indexes:
        raise TableError(f"Table '{table.name}' has no index")
    key = next(iter(table.definition.indexes))
    table.df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
