"""Tables inside stored web pages, as grids of cell texts.

A page is read once from its start to its end: only the tags of tables, rows and cells are looked at, with a stack of
the tables that are open. The time is linear in the page and in what it returns. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import ship_package

# fixed values: markup that holds no table text, white space, the largest span that browsers honour
NOT_CONTENT = re.compile(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>")
ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});")
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
TAG = re.compile(r"<[^>]*>")
MOST_SPAN = 1000


def _character(found: re.Match) -> str:
    """The text of an entity such as ``&amp;``, ``&#233;`` or ``&#xe9;``; one that stands for nothing stays."""
    name = found[1]
    if name[0] == "#":
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        valid = 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
    else:
        code = name2codepoint.get(name, 0)
        valid = code > 0
    return (" " if code == 160 else chr(code)) if valid else found[0]


def cell_text(markup: str) -> str:
    text = TAG.sub(" ", markup)
    if "&" in text:
        text = ENTITY.sub(_character, text)
    return SPACE.sub(" ", text).strip(" ")


def _span(attributes: str, name: str) -> int:
    found = re.search(rf"(?i)\b{name}\s*=\s*[\"']?([0-9]+)", attributes, re.A)
    return max(1, min(MOST_SPAN, int(found[1][:9]))) if found else 1


class _Open:
    """A table that is being read: its rows of [text parts, columns, rows below] cells, what is open, all its text."""

    def __init__(self, number: int):
        self.number, self.rows, self.row, self.cell, self.text = number, [], None, None, []

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.cell is not None:
            self.cell[0].append(text)

    def grid(self) -> list[list[str | None]]:
        """Cells laid out in columns: one that reaches down keeps its columns in the next rows; short rows end in None."""
        grid, held = [], {}
        for row in self.rows:
            line, below = {c: text for c, (text, _) in held.items()}, {c: (text, n - 1) for c, (text, n) in held.items() if n > 1}
            at = 0
            for parts, columns, down in row:
                text = cell_text("".join(parts))
                for _ in range(columns):
                    while at in line:
                        at += 1
                    line[at] = text
                    if down > 1:
                        below[at] = (text, down - 1)
            grid.append(line)
            held = below
        width = max((max(line, default=-1) + 1 for line in grid), default=0)
        return [[line.get(c) for c in range(width)] for line in grid]


def page_tables(page: str | None, token: re.Pattern) -> list[list[list[str | None]]]:
    """The grids of all closed tables of a page, in the order of their opening tags."""
    page = NOT_CONTENT.sub("", page or "")
    stack: list[_Open] = []
    closed: dict[int, _Open] = {}
    at = opened = 0
    for tag in token.finditer(page):
        if stack:
            stack[-1].add(page[at:tag.start()])
        at = tag.end()
        ends = tag["end"]
        kind = "table" if tag["table"] else "row" if tag["row"] else "cell"
        if kind == "table" and not ends:
            stack.append(_Open(opened))
            opened += 1
        elif not stack:
            continue
        elif kind == "table":
            done = stack.pop()
            closed[done.number] = done
            if stack:  # the text of a table inside a cell belongs to the cell as well
                stack[-1].add(" " + " ".join(done.text) + " ")
        elif kind == "row":
            top = stack[-1]
            top.text.append(" ")
            top.row = top.cell = None
            if not ends:
                top.row = []
                top.rows.append(top.row)
        else:
            top = stack[-1]
            top.text.append(" ")
            top.cell = None
            if not ends and top.row is not None:
                top.cell = [[], _span(tag["attributes"], "colspan"), _span(tag["attributes"], "rowspan")]
                top.row.append(top.cell)
    return [closed[n].grid() for n in sorted(closed)]


def html_tables(pages: DataFrame, html: str = "html", table: str = "table", row: str = "tr",
                cell: str = "td|th", ids: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per table: ids, ``table_no`` from 1, ``grid`` (rows of cell texts).

    Cells that span columns or rows are repeated, up to ``MOST_SPAN``; short rows are filled with NULL. A table inside
    another is a table of its own, and its text belongs to the outer cell. Tables that are never closed are left out.
    """
    ship_package(pages.sparkSession)
    ids = list(ids)
    token = (rf"(?is)<(?P<end>/?)(?:(?P<table>{table})|(?P<row>{row})|(?P<cell>{cell}))\b(?P<attributes>[^>]*)>")
    fields = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(token, re.A)
        for batch in batches:
            for i, page in enumerate(batch.column("page_html")):
                grids = page_tables(page.as_py(), pattern)
                for first in range(0, len(grids), 1000):
                    some = grids[first:first + 1000]
                    keys = [pa.array([batch.column(c)[i].as_py()] * len(some), batch.schema.field(c).type) for c in ids]
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.array(range(first + 1, first + 1 + len(some)), pa.int32()),
                         pa.array(some, pa.list_(pa.list_(pa.string())))], [*ids, "table_no", "grid"])

    return pages.select(*ids, F.col(html).alias("page_html")).mapInArrow(run, f"{fields}, table_no int, grid array<array<string>>")


def nth_table(tables: DataFrame, number: int) -> DataFrame:
    return tables.filter(F.col("table_no") == number)


def grid_cells(tables: DataFrame, ids: Sequence[str] = ("page_id",)) -> DataFrame:
    """Long form: (ids, table_no, row_no, col_no, cell), counting from 1."""
    rows = tables.select(*ids, "table_no", F.posexplode("grid").alias("row_no", "cells"))
    return rows.select(
        *ids, "table_no", (F.col("row_no") + 1).alias("row_no"), F.posexplode("cells").alias("col_no", "cell")
    ).withColumn("col_no", F.col("col_no") + 1)


def header_column_filter(tables: DataFrame, names: Sequence[str], unwanted: str = "Number",
                         header_rows: int = 2, ids: Sequence[str] = ("page_id",)) -> DataFrame:
    """Drop columns whose last header cell matches ``unwanted``; name the rest; drop header rows.

    More columns to keep than ``names`` are an error.
    """
    header = F.element_at("grid", header_rows)
    kept = F.filter(F.sequence(F.lit(1), F.size(header)),
                    lambda c: ~F.coalesce(F.element_at(header, c).rlike(unwanted), F.lit(False)))
    message = F.format_string(f"%d columns to keep, {len(names)} names", F.size(kept))
    kept = F.when(F.size(kept) <= len(names), kept).otherwise(F.raise_error(message))
    body = F.filter("grid", lambda r, i: i >= header_rows)
    rows = tables.filter(F.size("grid") > header_rows).select(
        *ids, kept.alias("kept"), F.explode(body).alias("cells"))
    return rows.select(*ids, *[
        F.try_element_at("cells", F.get("kept", F.lit(i))).alias(n) for i, n in enumerate(names)])
