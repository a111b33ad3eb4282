"""Equi-joins on one or several columns, null matching null, and the naming of their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Column, TableDef, TableError

if TYPE_CHECKING:
    from ..table import Table

#: Gives a condition on a joined pair from two functions that look a column up by name.
PairFilter = Callable[[Callable[[str], SparkColumn], Callable[[str], SparkColumn]], SparkColumn]


def renamed(left: list[str], right: list[str], left_alias: str, right_alias: str) -> tuple[list[str], list[str]]:
    """``alias.name`` for each column; a name that is taken gets underscores until it is free."""
    seen: set[str] = set()

    def free(name: str) -> str:
        while name in seen:
            name += "_"
        seen.add(name)
        return name

    return [free(f"{left_alias}.{c}") for c in left], [free(f"{right_alias}.{c}") for c in right]


def join(
    left: Table,
    right: Table,
    on: list[tuple[str, str]],
    how: str = "inner",
    where: PairFilter | None = None,
    aliases: tuple[str, str] | None = None,
    name: str | None = None,
    matched: bool = False,
) -> Table:
    """The joined table; no pairs of keys: every pair of rows. ``matched`` adds whether the optional side was there."""
    if how not in ("inner", "left", "right"):
        raise TableError(f"Unknown join: {how}")
    for a, b in on:
        ka, kb = left.definition.column(a).kind, right.definition.column(b).kind
        if ka is not kb:
            raise TableError(f"Type mismatch in join: {left.name}.{a} is {ka.value}, {right.name}.{b} is {kb.value}")
    l_alias, r_alias = aliases or (left.name, right.name)
    l_names, r_names = renamed(left.definition.names, right.definition.names, l_alias, r_alias)
    l_map, r_map = dict(zip(left.definition.names, l_names, strict=True)), dict(zip(right.definition.names, r_names, strict=True))
    ldf, rdf = left.df.toDF(*l_names), right.df.toDF(*r_names)
    if matched and how == "left":
        rdf = rdf.withColumn("__matched", F.lit(True))
    if matched and how == "right":
        ldf = ldf.withColumn("__matched", F.lit(True))
    pairs = [F.col(f"`{l_map[a]}`").eqNullSafe(F.col(f"`{r_map[b]}`")) for a, b in on]
    if pairs:
        out = ldf.join(rdf, reduce(lambda x, y: x & y, pairs), how)
    else:
        out = ldf.crossJoin(rdf) if how == "inner" else ldf.join(rdf, F.lit(True), how)
    if where is not None:
        out = out.filter(where(lambda c: F.col(f"`{l_map[c]}`"), lambda c: F.col(f"`{r_map[c]}`")))
    names = l_names + r_names
    columns = [Column(n, c.kind, allowed=c.allowed) for n, c in zip(names, left.definition.columns + right.definition.columns, strict=True)]
    selected: list[SparkColumn] = [F.col(f"`{n}`") for n in names]
    if matched and how != "inner":
        selected.append(F.coalesce("__matched", F.lit(False)).alias("__matched"))
    return type(left)(out.select(*selected), TableDef(name or f"{l_alias}.{r_alias}", tuple(columns)))


def underscored(df: DataFrame) -> DataFrame:
    """Column names with dots as underscores."""
    return df.toDF(*(c.replace(".", "_") for c in df.columns))
