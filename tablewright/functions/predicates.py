"""One column, one comparison, one literal; null equals null and exceeds all values."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..schema import TableDef, TableError
from .values import Kind, fits, literal, shown

OPERATORS = ("==", "!=", ">", "<", ">=", "<=")


@dataclass(frozen=True, eq=False)
class Predicate:
    column: str
    operator: str
    value: Any

    def expression(self, definition: TableDef, prefix: str = "") -> SparkColumn:
        """A boolean that is never null; the literal must be of the column's type."""
        kind = definition.column(self.column).kind
        if not fits(self.value, kind):
            raise TableError(f"Type mismatch at column {self.column}: expected {kind.value}, got {shown(self.value)}")
        c, op = F.col(f"`{prefix}{self.column}`"), self.operator
        if self.value is None:
            return {"==": c.isNull(), "!=": c.isNotNull(), ">": F.lit(False), ">=": c.isNull(), "<": c.isNotNull(), "<=": F.lit(True)}[op]
        v = literal(self.value, kind)
        if op == "==":
            return c.eqNullSafe(v)
        if op == "!=":
            return ~c.eqNullSafe(v)
        compared = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
        if kind in (Kind.FLOAT, Kind.DOUBLE):  # no order with NaN
            compared = F.lit(False) if math.isnan(self.value) else compared & ~F.isnan(c)
        return compared | c.isNull() if op in (">", ">=") else F.coalesce(compared, F.lit(False))


class col:
    """``col("x") >= 3`` is the predicate of that comparison."""

    def __init__(self, name: str) -> None:
        self.name = name

    __hash__ = None

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Predicate(self.name, "==", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Predicate(self.name, "!=", value)

    def __gt__(self, value: Any) -> Predicate:
        return Predicate(self.name, ">", value)

    def __lt__(self, value: Any) -> Predicate:
        return Predicate(self.name, "<", value)

    def __ge__(self, value: Any) -> Predicate:
        return Predicate(self.name, ">=", value)

    def __le__(self, value: Any) -> Predicate:
        return Predicate(self.name, "<=", value)
