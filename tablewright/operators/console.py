"""Tables as lines of text, for the console."""

from __future__ import annotations

#: Fixed value: the least width of a column.
WIDTH = 15


def table_lines(name: str, header: list[str], rows: list[list[str]]) -> list[str]:
    """The name, then header and rows with cells filled up to the width."""
    return [name, *("".join(f"{x:<{WIDTH}}" for x in cells).rstrip() for cells in [header, *rows])]


def joined_lines(header: list[str], rows: list[list[str]]) -> list[str]:
    return [" | ".join(cells) for cells in [header, *rows]]
