"""Cells of delimited lines where they stand: every byte of the other cells, quotes and line ends stay as they are.

A quote opens or closes a quoted stretch wherever it stands, two inside one are a quote, and a comma parts cells outside
of one. A quoted stretch that isn't closed goes to the line's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell. Java, RE2 and Python read it alike.
CELL = '(?:[^",]|"(?:[^"]|"")*(?:"|$))*'


def cell(line: Column, n: int) -> Column:
    """The n-th cell, from 0, as it is written; null where the line has fewer."""
    return F.when(line.rlike(f"^(?:{CELL},){{{n}}}"), F.regexp_extract(line, f"^(?:{CELL},){{{n}}}({CELL})", 1))


def with_cell(line: Column, n: int, text: Column) -> Column:
    """The line with its n-th cell replaced; unchanged where the line has fewer, or text is null."""
    head = F.regexp_extract(line, f"^((?:{CELL},){{{n}}})({CELL})", 1)
    tail = F.substring(line, F.length(head) + F.length(cell(line, n)) + 1, F.length(line))
    return F.coalesce(F.concat(head, text, tail), line)


def without_cells(line: Column, drop: list[int]) -> Column:
    """The line without the cells at these places, and without their commas."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({CELL})"), F.lit(1))
    return F.array_join(F.filter(cells, lambda x, k: ~k.isin(*drop)), ",") if drop else line


def unquoted(text: Column) -> tuple[Column, Column]:
    """What a cell says, and the quote (or nothing) that goes around it."""
    quoted = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text), F.when(quoted, F.lit('"')).otherwise(F.lit(""))
