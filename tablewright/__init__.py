"""Relational tables with declared schemas and constraints, as lazy Spark plans.

    from tablewright import Column, Table, TableDef, col

A ``Table`` is an immutable pair of a DataFrame and its definition; every
operation gives a new one. ``Database`` holds tables by name, with snapshots.
"""

from .functions.predicates import Predicate, col
from .functions.values import Kind
from .plans.catalog import Database
from .schema import Column, TableDef, TableError
from .table import Table

__all__ = ["Column", "Database", "Kind", "Predicate", "Table", "TableDef", "TableError", "col"]
