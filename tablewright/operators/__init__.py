"""Joins, aggregates, constraints, data changes and schema changes."""
