"""Cells of HTML tables: nested tables, spans, character references, cells and rows that nobody closed.

Pages are read where they lie, a batch of rows at a time; tags go over a stack of open tables. A cell ends with its row, its table
or the next cell, as browsers have it; a nested table is a table of its own and leaves no text in the cell around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A span beyond this counts as this, as browsers limit it.
MAX_SPAN = 1000
_SILENT = {"script", "style", "template"}


class _Table:
    def __init__(self, number: int, depth: int):
        self.number, self.depth, self.row = number, depth, -1
        self.cell: list | None = None
        #: Columns that cells of rows above cover in this row, with the rows left, and those that this row's cells will cover.
        self.covered: dict[int, int] = {}
        self.below: dict[int, int] = {}
        self.column = 0


class _Cells(HTMLParser):
    """rows: (table, depth, row, column, columns, is_header, text) in the order in which cells end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.rows: list[tuple] = []
        self.tables = 0
        self.silent = 0

    @staticmethod
    def _span(attrs: list, name: str) -> int:
        value = next((v for k, v in attrs if k == name), None)
        return min(int(value), MAX_SPAN) if value and value.strip().isascii() and value.strip().isdigit() and int(value) else 1

    def _end_cell(self, table: _Table) -> None:
        if table.cell is not None:
            column, columns, header, parts = table.cell
            self.rows.append((table.number, table.depth, table.row, column, columns, header, " ".join("".join(parts).split())))
            table.cell = None

    def _begin_row(self, table: _Table) -> None:
        self._end_cell(table)
        table.row += 1
        table.column = 0
        table.covered = {c: n - 1 for c, n in table.covered.items() if n > 1} | table.below
        table.below = {}

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            self.open.append(_Table(self.tables, len(self.open)))
            self.tables += 1
        elif self.open:
            table = self.open[-1]
            if tag == "tr":
                self._begin_row(table)
            elif tag in ("td", "th"):
                if table.row < 0:
                    self._begin_row(table)
                self._end_cell(table)
                while table.column in table.covered:
                    table.column += 1
                columns, rows = self._span(attrs, "colspan"), self._span(attrs, "rowspan")
                table.cell = [table.column, columns, tag == "th", []]
                if rows > 1:
                    table.below |= {c: rows - 1 for c in range(table.column, table.column + columns)}
                table.column += columns
            elif tag in ("br", "p", "div", "li") and table.cell is not None:
                table.cell[3].append(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.open:
            table = self.open[-1]
            if tag == "table":
                self._end_cell(table)
                self.open.pop()
            elif tag in ("tr", "td", "th", "thead", "tbody", "tfoot"):
                self._end_cell(table)

    def handle_data(self, data):
        if self.open and self.open[-1].cell is not None and not self.silent:
            self.open[-1].cell[3].append(data)

    def finished(self) -> list[tuple]:
        self.close()
        while self.open:
            self._end_cell(self.open.pop())
        return sorted(self.rows, key=lambda r: (r[0], r[2], r[3]))


def cells_of(html: str) -> list[tuple]:
    parser = _Cells()
    parser.feed(html)
    return parser.finished()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["table_no", "depth", "row_no", "column_no", "columns", "is_header", "text"]
    kinds = [pa.int32()] * 5 + [pa.bool_(), pa.string()]
    for batch in batches:
        found = [cells_of(x.as_py() or "") for x in batch.column("html")]
        own = [r for rows in found for r in rows]
        at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
        columns = [pa.array([r[k] for r in own], kinds[k]) for k in range(7)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").take(at), *columns], ["page_id", *names])


def table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, depth, row_no, column_no, columns, is_header, text) of each cell in pages (page_id, html).

    Tables count from 0 in page order, nested ones too; columns is how many a cell spans, and a cell that spans rows moves those
    below it to the right. White space in a text is one space. A null page has no tables; other columns are left out.
    """
    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, table_no int, depth int, row_no int, column_no int, columns int, is_header boolean, text string"
    return pages.select("page_id", "html").mapInArrow(_read, schema)


def symbols_from_tables(pages: DataFrame, suffix: str = ".NS") -> DataFrame:
    """(page_id, symbol, ticker): the column headed symbol or ticker of each page's first table that has one, in pages (page_id, html).

    The heads are a table's first row. A symbol without an exchange's ending gets suffix.
    """
    cells = table_cells(pages)
    named = (F.col("row_no") == 0) & F.lower("text").rlike("symbol|ticker")
    heads = cells.where(named).groupBy("page_id").agg(F.min(F.struct("table_no", "column_no")).alias("h")).select("page_id", "h.*")
    own = cells.where("row_no > 0 AND text <> ''").join(heads, ["page_id", "table_no", "column_no"]).select("page_id", "row_no", F.col("text").alias("symbol"))
    return own.select("page_id", "symbol", F.when(F.col("symbol").rlike(r"\.(NS|BO)$"), F.col("symbol")).otherwise(F.concat("symbol", F.lit(suffix))).alias("ticker"))
