"""Broken rules of new rows, as a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TableDef

# Fixed values, in this module and in ``Table``: the messages of broken rules, which callers match.

#: Name of the column that numbers new rows.
ORDINAL = "__ordinal"


def row_rules(definition: TableDef) -> list[tuple[SparkColumn, str]]:
    """(broken, message) of each rule that one row can break, in the order in which they count."""
    rules = []
    for c in definition.columns:
        x = F.col(f"`{c.name}`")
        if c.not_null:
            rules.append((x.isNull(), f"Column '{c.name}' is NOT NULL"))
        if c.kind.name == "ENUM":
            rules.append((x.isNotNull() & ~x.isin(*c.allowed), f"Invalid enum value for column '{c.name}'"))
        if c.kind.name == "SET":
            others = F.array_except(x, F.array(*map(F.lit, c.allowed)).cast("array<string>"))
            rules.append((x.isNotNull() & (F.size(others) > 0), f"Invalid set value for column '{c.name}'"))
        if (value := c.checked_value()) is not None:
            rules.append((x.isNotNull() & (x != F.lit(value)), f"CHECK failed for column '{c.name}': {c.check}"))
    return rules


def unique_keys(definition: TableDef) -> list[tuple[tuple[str, ...], str]]:
    keys = [((c.name,), f"Unique constraint violated: duplicate value in column '{c.name}'") for c in definition.columns if c.unique]
    return keys + ([(definition.primary_key, "Primary key constraint violated: duplicate entry")] if definition.primary_key else [])


def same(left: str, right: str, names: tuple[str, ...]) -> SparkColumn:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`")) for n in names))


def repeated(new: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Ordinals of new rows whose key an earlier new row has.

    Keys are counted before the shuffle, so a key of any number of rows, null
    included, costs one row a task; only rows of keys that repeat are joined back.
    """
    keys = new.select(ORDINAL, *(F.col(f"`{n}`") for n in names))
    first = F.min(ORDINAL).alias("__first")
    twice = keys.groupBy(*(F.col(f"`{n}`") for n in names)).agg(first, F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    again = keys.alias("new").join(twice.alias("twice"), same("new", "twice", names))
    return again.filter(F.col(f"new.{ORDINAL}") > F.col("__first")).select(f"new.{ORDINAL}")


def taken(old: DataFrame, new: DataFrame, names: tuple[str, ...], small: bool) -> DataFrame:
    """Ordinals of new rows whose key an old row has, each once, however many old rows have it."""
    keys = new.select(ORDINAL, *(F.col(f"`{n}`") for n in names)).alias("new")
    held = old.select(*(F.col(f"`{n}`") for n in names)).alias("old")
    if small:  # the new keys go to the old rows, of which only matches come back
        held = held.join(F.broadcast(keys), same("old", "new", names), "left_semi").distinct().alias("old")
    return keys.join(held, same("old", "new", names), "left_semi").select(ORDINAL)


def violations(old: DataFrame, new: DataFrame, definition: TableDef, small: bool = False) -> DataFrame:
    """(ordinal, rule, message) of every rule that new rows, numbered by the ordinal column, break.

    ``small``: the new rows came from the driver and can be sent to all tasks.
    """
    out = []
    rules = row_rules(definition)
    if rules:
        broken = [F.when(c, F.struct(F.lit(i).alias("rule"), F.lit(m).alias("message"))) for i, (c, m) in enumerate(rules)]
        found = new.select(ORDINAL, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("x"))
        out.append(found.select(ORDINAL, "x.rule", "x.message"))
    for k, (names, message) in enumerate(unique_keys(definition), len(rules)):
        both = repeated(new, names).unionAll(taken(old, new, names, small)).distinct()
        out.append(both.select(ORDINAL, F.lit(k).alias("rule"), F.lit(message).alias("message")))
    if not out:
        return new.select(ORDINAL, F.lit(0).alias("rule"), F.lit("").alias("message")).limit(0)
    return reduce(DataFrame.unionAll, out)


def duplicate_keys(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Keys that several rows share, with their number."""
    return df.groupBy(*(F.col(f"`{n}`") for n in names)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
