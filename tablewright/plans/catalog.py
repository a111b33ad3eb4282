"""Tables by name: foreign keys, views, and snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TableError
from ..table import Table


class Database:
    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}
        self.views: dict[str, Callable[[Database], DataFrame]] = {}
        self._open: dict[str, Table] = {}

    def put(self, table: Table, name: str | None = None) -> Table:
        self.tables[name or table.name] = table
        return table

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise TableError(f"Table '{name}' not found")
        return self.tables[name]

    def validate_foreign_keys(self) -> None:
        """Every foreign key must name a table."""
        for table in self.tables.values():
            for c in table.definition.columns:
                if c.foreign_key is not None and c.foreign_key not in self.tables:
                    raise TableError(f"Table '{table.name}' has a foreign key to missing table '{c.foreign_key}'.")

    def orphans(self, name: str, column: str, referenced: str) -> DataFrame:
        """Rows whose value is in no row of the table that the column refers to."""
        table = self[name]
        target = table.definition.column(column).foreign_key
        if target is None:
            raise TableError(f"Column '{column}' has no foreign key")
        keys = self[target].df.select(F.col(f"`{referenced}`").alias("__key"))
        return table.df.filter(F.col(f"`{column}`").isNotNull()).join(keys, F.col(f"`{column}`") == F.col("__key"), "left_anti")

    def view(self, name: str, build: Callable[[Database], DataFrame]) -> None:
        """A named builder; nothing is built before the view is read."""
        self.views[name] = build

    def read_view(self, name: str) -> DataFrame:
        """The view over the tables as they are now, also as a temporary view of Spark for SQL."""
        if name not in self.views:
            raise TableError(f"View '{name}' not found")
        df = self.views[name](self)
        df.createOrReplaceTempView(name)
        return df

    def begin(self, name: str) -> None:
        """Remember a table as it is, data and definition; plans are immutable, so nothing is copied."""
        if name in self._open:
            raise TableError("Transaction already in progress")
        self._open[name] = self[name]

    def rollback(self, name: str) -> Table:
        if name not in self._open:
            raise TableError("No transaction to rollback")
        return self.put(self._open.pop(name), name)

    def commit(self, name: str) -> None:
        if self._open.pop(name, None) is None:
            raise TableError("No transaction to commit")
