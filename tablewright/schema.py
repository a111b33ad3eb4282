"""Column and table definitions and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .functions.values import SPARK_TYPES, Kind, kind_of


class TableError(ValueError):
    """A rule of the schema or of the data is broken."""


#: No default, as against a default of None.
NO_DEFAULT = object()


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    unique: bool = False
    not_null: bool = False
    foreign_key: str | None = None
    check: str | None = None
    default: Any = NO_DEFAULT
    autoincrement: bool = False
    allowed: tuple[str, ...] = ()

    def validate(self) -> None:
        has_default = self.default is not NO_DEFAULT
        if has_default and self.default is None and self.not_null:
            raise TableError(f"Column '{self.name}' is NOT NULL but has a default of NULL")
        if self.autoincrement and self.kind not in (Kind.INT, Kind.BIGINT):
            raise TableError(f"AUTOINCREMENT column '{self.name}' must be INT or BIGINT")
        if self.autoincrement and not self.not_null:
            raise TableError(f"AUTOINCREMENT column '{self.name}' must be NOT NULL")
        if has_default and self.default is not None and self.kind is Kind.ENUM and self.default not in self.allowed:
            raise TableError(f"Default '{self.default}' of ENUM column '{self.name}' is not allowed")
        if has_default and self.default is not None and self.kind is Kind.SET and not set(self.default) <= set(self.allowed):
            raise TableError(f"Default of SET column '{self.name}' has members that are not allowed")

    def checked_value(self) -> str | None:
        """The value that a CHECK of the form ``name = value`` asks for; other forms and types check nothing."""
        name, equals, value = (self.check or "").partition(" = ")
        return value.strip() if equals and name.strip() == self.name and self.kind is Kind.VARCHAR else None


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    indexes: dict[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise TableError(f"Column '{name}' not found in table '{self.name}'")

    def validate(self) -> TableDef:
        for i, name in enumerate(self.names):
            if name in self.names[:i]:
                raise TableError(f"Duplicate column name: {name}")
        for name in self.primary_key:
            if name not in self.names:
                raise TableError(f"Primary key column '{name}' does not exist in table '{self.name}'")
        for c in self.columns:
            c.validate()
        return self

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK_TYPES[c.kind], True, {"kind": c.kind.name, "allowed": list(c.allowed)}) for c in self.columns])

    def with_columns(self, columns: list[Column], **changes: Any) -> TableDef:
        return replace(self, columns=tuple(columns), **changes)

    @classmethod
    def of(cls, name: str, schema: T.StructType, primary_key: tuple[str, ...] = ()) -> TableDef:
        """The definition of undeclared data."""
        return cls(name, tuple(Column(f.name, kind_of(f.dataType)) for f in schema.fields), primary_key)
