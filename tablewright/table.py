"""A table: a DataFrame with its definition. Every change gives a new table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.predicates import Predicate
from .functions.values import SPARK_TYPES, displayed, fits, literal, shown
from .operators import aggregates, console, constraints, joins
from .operators.constraints import ORDINAL
from .schema import NO_DEFAULT, Column, TableDef, TableError
from .scratch import settle

Condition = Predicate | SparkColumn
#: Runs of ordinals in which generated ids are counted, at most and besides one a partition.
RUNS = 65_536


@dataclass(frozen=True)
class Table:
    df: DataFrame
    definition: TableDef

    @property
    def name(self) -> str:
        return self.definition.name

    @classmethod
    def create(cls, spark: SparkSession, name: str, columns: Sequence[Column], primary_key: Sequence[str] = ()) -> Table:
        spark.conf.set("spark.sql.timeType.enabled", "true")
        definition = TableDef(name, tuple(columns), tuple(primary_key)).validate()
        return cls(spark.createDataFrame([], definition.spark_schema()), definition)

    @classmethod
    def of(cls, name: str, df: DataFrame, primary_key: Sequence[str] = ()) -> Table:
        """Existing data, its types taken from the DataFrame and not checked."""
        return cls(df, TableDef.of(name, df.schema, tuple(primary_key)).validate())

    # Queries

    def condition(self, where: Condition) -> SparkColumn:
        return where.expression(self.definition) if isinstance(where, Predicate) else where

    def select_all(self) -> DataFrame:
        return self.df

    def select_where(self, where: Condition) -> DataFrame:
        return self.df.filter(self.condition(where))

    def group_by(self, key: str, where: Condition | None = None) -> DataFrame:
        return aggregates.group_by(self.df, self.definition, key, None if where is None else self.condition(where))

    def group_rows(self, key: str, where: Condition | None = None) -> DataFrame:
        """All rows, sorted by the key and dealt so that a large group reaches over several partitions."""
        return aggregates.group_rows(self.df, self.definition, key, None if where is None else self.condition(where))

    def group(self, key: str, value: Any) -> DataFrame:
        """The rows of one group."""
        return self.select_where(Predicate(key, "==", value))

    def aggregate(self, key: str, column: str, func: str) -> DataFrame:
        return self.aggregate_group(key, [(column, func)])

    def aggregate_group(self, key: str, functions: list[tuple[str, str]], where: Condition | None = None) -> DataFrame:
        return aggregates.aggregate_group(self.df, self.definition, key, functions, None if where is None else self.condition(where))

    def join(self, other: Table, on: list[tuple[str, str]], how: str = "inner", **options: Any) -> Table:
        return joins.join(self, other, on, how, **options)

    def with_alias(self, alias: str) -> Table:
        columns = [replace(c, name=f"{alias}.{c.name}") for c in self.definition.columns]
        return Table(self.df.toDF(*(c.name for c in columns)), TableDef(f"{self.name}_alias", tuple(columns)))

    # Data changes

    def _checked_rows(self, rows: Sequence[Sequence[Any]]) -> None:
        for row in rows:
            if len(row) != len(self.definition.columns):
                raise TableError(f"Column count mismatch: expected {len(self.definition.columns)}, got {len(row)}")
            for c, value in zip(self.definition.columns, row, strict=True):
                if not fits(value, c.kind):
                    raise TableError(f"Type mismatch at column {c.name}: expected {c.kind.value}, got {shown(value)}")

    def _numbered(self, rows: Sequence[Sequence[Any]]) -> DataFrame:
        schema = T.StructType([*self.definition.spark_schema().fields, T.StructField(ORDINAL, T.LongType())])
        data = [(*(list(x) if isinstance(x, tuple) else x for x in row), i) for i, row in enumerate(rows)]
        return self.df.sparkSession.createDataFrame(data, schema)

    def filled(self, new: DataFrame) -> DataFrame:
        """Defaults in place of nulls, then generated ids, for rows numbered by the ordinal column.

        A generated id is one more than the largest value before it, as if rows
        came one by one: nulls so far + the largest of (earlier explicit value -
        nulls up to it) and of the table's maximum. Nulls and values are first
        counted in runs of ordinals: no window holds more than one run, or the
        sums of all runs, of which there are at most ``RUNS`` and one a partition.
        """
        for c in self.definition.columns:
            x = F.col(f"`{c.name}`")
            if c.default is not NO_DEFAULT:
                new = new.withColumn(c.name, F.coalesce(x, literal(c.default, c.kind)))
            elif c.autoincrement:
                base = self.df.agg(F.greatest(F.lit(0), F.coalesce(F.max(x), F.lit(0)))).first()[0]
                run = F.floor(F.col(ORDINAL) / max(10_000, -(-new.count() // RUNS)))
                before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
                within = Window.partitionBy("__run").orderBy(ORDINAL)
                least = F.lit(base).cast("long")
                rows = new.withColumn("__run", run).withColumn("__k", F.count_if(x.isNull()).over(within))
                rows = rows.withColumn("__m", F.max(x.cast("long") - F.col("__k")).over(within))
                runs = rows.groupBy("__run").agg(F.max("__k").alias("__kn"), F.max("__m").alias("__mn"))
                runs = runs.withColumn("__k0", F.coalesce(F.sum("__kn").over(before), F.lit(0)))
                earlier = F.max(F.col("__mn") - F.col("__k0")).over(before)
                runs = runs.withColumn("__m0", F.coalesce(earlier, least)).select("__run", "__k0", "__m0")
                rows = rows.join(runs, "__run")
                own = F.coalesce(F.col("__m") - F.col("__k0"), least)
                value = F.col("__k0") + F.col("__k") + F.greatest(least, F.col("__m0"), own)
                new = rows.withColumn(c.name, F.coalesce(x, value.cast(SPARK_TYPES[c.kind]))).select(new.columns)
        return new

    def violations(self, new: DataFrame, small: bool = False) -> DataFrame:
        return constraints.violations(self.df, new, self.definition, small)

    def _raise_first(self, found: DataFrame) -> None:
        first = found.orderBy(ORDINAL, "rule").limit(1).collect()
        if first:
            raise TableError(first[0]["message"])

    def insert(self, *rows: Sequence[Any]) -> Table:
        """The table with the rows, all or none of them."""
        self._checked_rows(rows)
        new = self.filled(self._numbered(rows))
        self._raise_first(self.violations(new, small=True))
        return Table(self.df.unionByName(new.drop(ORDINAL)), self.definition)

    def insert_from(self, new: DataFrame, validate: bool = True) -> Table:
        """The table with a DataFrame's rows; its columns must be the table's, its types too."""
        want = {c.name: SPARK_TYPES[c.kind].simpleString() for c in self.definition.columns}
        if dict(new.dtypes) != want:
            raise TableError(f"Row does not match declared type: expected {want}, got {dict(new.dtypes)}")
        numbered = new.select(*(F.col(f"`{n}`") for n in want)).withColumn(ORDINAL, F.monotonically_increasing_id())
        new = self.filled(settle(numbered, "insert"))  # settled, so that checks and result see the same numbers
        if validate:
            self._raise_first(self.violations(new))
        return Table(self.df.unionByName(new.drop(ORDINAL)), self.definition)

    def validate_row(self, row: Sequence[Any]) -> None:
        """Check one complete row against types and constraints."""
        for c, value in zip(self.definition.columns, row, strict=True):
            if not fits(value, c.kind):
                raise TableError(f"Value {shown(value)} does not match declared type {c.kind.value} of column '{c.name}'")
        self._raise_first(self.violations(self._numbered([row]), small=True))

    def update_where(self, where: Condition, values: dict[str, Any]) -> Table:
        """Rows that pass get the values; None is null. The rows as changed must keep the constraints."""
        for name, value in values.items():
            kind = self.definition.column(name).kind
            if not fits(value, kind):
                raise TableError(f"Type mismatch at column {name}: expected {kind.value}, got {shown(value)}")
        hit = F.coalesce(self.condition(where), F.lit(False))
        marked = self.df.withColumn("__hit", hit)

        def changed_column(c: Column) -> SparkColumn:
            old = F.col(f"`{c.name}`")
            return F.when(F.col("__hit"), literal(values[c.name], c.kind)).otherwise(old).alias(c.name) if c.name in values else old

        changed = marked.select(*map(changed_column, self.definition.columns), "__hit")
        rules = constraints.row_rules(self.definition.with_columns([c for c in self.definition.columns if c.name in values]))
        if rules:  # all of them in one pass
            some = [F.max(F.col("__hit") & broken).alias(f"r{i}") for i, (broken, _) in enumerate(rules)]
            for broken, (_, message) in zip(changed.agg(*some).first(), rules, strict=True):
                if broken:
                    raise TableError(message)
        found = []
        keys = [k for k in constraints.unique_keys(self.definition) if set(k[0]) & set(values)]
        for i, (names, _) in enumerate(keys):
            sums = [F.count(F.lit(1)).alias("__n"), F.max("__hit").alias("__any")]
            groups = changed.groupBy(*(F.col(f"`{n}`") for n in names)).agg(*sums)
            found.append(groups.filter((F.col("__n") > 1) & F.col("__any")).select(F.lit(i).alias("key")).limit(1))
        if found:  # all keys in one job
            broken = reduce(DataFrame.unionAll, found).agg(F.min("key")).first()[0]
            if broken is not None:
                raise TableError(keys[broken][1])
        return Table(changed.drop("__hit"), self.definition)

    def delete_where(self, where: Condition) -> Table:
        return Table(self.df.filter(~F.coalesce(self.condition(where), F.lit(False))), self.definition)

    # Schema changes

    def add_column(self, column: Column) -> Table:
        if column.name in self.definition.names:
            raise TableError(f"Column '{column.name}' already exists")
        column.validate()
        value = None if column.default is NO_DEFAULT else column.default
        if column.not_null and value is None:
            raise TableError(f"Column '{column.name}' is NOT NULL and needs a default")
        return Table(self.df.withColumn(column.name, literal(value, column.kind)), self.definition.with_columns([*self.definition.columns, column]))

    def rename_column(self, old: str, new: str) -> Table:
        self.definition.column(old)
        if new in self.definition.names:
            raise TableError(f"Column '{new}' already exists")

        def moved(c: Column) -> Column:
            value = c.checked_value()
            return replace(c, name=new, check=f"{new} = {value}" if value is not None else c.check) if c.name == old else c

        names = [new if n == old else n for n in self.definition.names]
        keys = tuple(new if n == old else n for n in self.definition.primary_key)
        indexes = {new if n == old else n: k for n, k in self.definition.indexes.items()}
        return Table(self.df.toDF(*names), self.definition.with_columns([moved(c) for c in self.definition.columns], primary_key=keys, indexes=indexes))

    def drop_column(self, name: str) -> Table:
        self.definition.column(name)
        if name in self.definition.primary_key:
            raise TableError(f"Cannot drop primary key column '{name}'")
        kept = [c for c in self.definition.columns if c.name != name]
        indexes = {n: k for n, k in self.definition.indexes.items() if n != name}
        return Table(self.df.select(*(F.col(f"`{c.name}`") for c in kept)), self.definition.with_columns(kept, indexes=indexes))

    def create_index(self, name: str, ordered: bool = False) -> Table:
        """Note the intent; saving as a bucketed table clusters by it. Queries need no index."""
        self.definition.column(name)
        return Table(self.df, replace(self.definition, indexes={**self.definition.indexes, name: "ordered" if ordered else "hash"}))

    def checkpoint(self) -> Table:
        """The same table read from the session's checkpoint folder, for after many changes."""
        return Table(self.df.checkpoint(), self.definition)

    def show(self, n: int = 20) -> None:
        """Name, header and at most n rows in columns of 15 characters or more."""
        print("\n".join(console.table_lines(self.name, *self._shown(n))))

    def show_joined(self, n: int = 20) -> None:
        """Header and at most n rows, cells parted by bars."""
        print("\n".join(console.joined_lines(*self._shown(n))))

    def _shown(self, n: int) -> tuple[list[str], list[list[str]]]:
        columns = self.definition.columns
        cells = self.df.select(*(displayed(F.col(f"`{c.name}`"), c.kind).alias(f"c{i}") for i, c in enumerate(columns)))
        return self.definition.names, [list(r) for r in cells.limit(n).collect()]
