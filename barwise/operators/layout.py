"""Words on a page to labelled rows with figures in columns.

Words of one page form one array: rows are gathered greedily around the first word of each, which needs their order, in one sweep
down the page. The work spreads by documents and pages; clustering of column edges, column choice and indents are window
functions over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions import numbers as num

#: Points between words of one line, between parts of one figure, and between the right edges of two columns.
ROW_TOLERANCE, MERGE_GAP, COLUMN_GAP = 3.0, 7.0, 18.0
_PAGE = ["doc_id", "page_index"]


_WORD = "struct<y:double,x0:double,x1:double,top:double,bottom:double,text:string>"


def page_rows(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """(doc_id, page_index, row_no, ws): each page's rows of words, in the order in which they begin, the words of a row by place.

    Words come by rounded top and x0, and each joins the first row whose first word is near enough. First words are further apart
    than the tolerance, and later ones lie lower, so at most the last two rows can take a word; all before them are complete.
    """
    w = F.struct(F.rint("top").alias("y"), *(F.col(c) for c in ("x0", "x1", "top", "bottom", "text")))
    pages = words.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(w)).alias("ws"))
    none = F.array().cast(f"array<{_WORD}>")
    start = F.struct(F.array().cast(f"array<array<{_WORD}>>").alias("done"), none.alias("upper"), none.alias("lower"))

    def step(acc: Column, x: Column) -> Column:
        takes = lambda row: (F.size(row) > 0) & (F.abs(F.try_element_at(row, F.lit(1))["top"] - x["top"]) <= tolerance)
        state = lambda done, upper, lower: F.struct(done.alias("done"), upper.alias("upper"), lower.alias("lower"))
        upper, lower, one = acc["upper"], acc["lower"], F.array(x)
        done = F.when(F.size(upper) > 0, F.concat(acc["done"], F.array(upper))).otherwise(acc["done"])
        return F.when(takes(upper), state(acc["done"], F.concat(upper, one), lower)).when(takes(lower), state(acc["done"], upper, F.concat(lower, one))).otherwise(state(done, lower, one))

    rows = F.aggregate("ws", start, step, lambda acc: F.concat(acc["done"], F.filter(F.array(acc["upper"], acc["lower"]), lambda r: F.size(r) > 0)))
    plain = F.transform("ws", lambda x: F.struct(*(x[c].alias(c) for c in ("x0", "x1", "top", "bottom", "text"))))
    return pages.select(*_PAGE, F.posexplode(rows).alias("row_no", "ws")).withColumn("ws", F.array_sort(plain))


def merged_words(rows: DataFrame, merge_all: bool = False) -> DataFrame:
    """The words of page_rows() after joining neighbours that are parts of one figure, one row each, numbered by position.

    A merged text holds a space and so takes no third part, unless merge_all.
    """

    def joinable(text: Column) -> Column:
        return num.is_numberish(F.regexp_replace(text, " ", "") if merge_all else text)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & num.is_numberish(x["text"]) & joinable(last["text"]) & (x["x0"] - last["x1"] <= MERGE_GAP) & ~num.is_year(x["text"])
        both = F.struct(last["x0"].alias("x0"), x["x1"].alias("x1"), F.least(last["top"], x["top"]).alias("top"), F.greatest(last["bottom"], x["bottom"]).alias("bottom"), F.concat_ws(" ", last["text"], x["text"]).alias("text"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<x0:double,x1:double,top:double,bottom:double,text:string>>")
    line = rows.withColumn("ws", F.aggregate("ws", empty, step))
    return line.select(*_PAGE, "row_no", F.posexplode("ws").alias("position", "w")).select(*_PAGE, "row_no", "position", "w.*")


def column_edges(figures: DataFrame, keys: list[str], gap: float = COLUMN_GAP) -> DataFrame:
    """(keys, column, edge): right edges x1 in clusters that a wider gap divides, each named by its mean."""
    order = W.partitionBy(*keys).orderBy("x1")
    starts = F.when(F.col("x1") - F.lag("x1").over(order) > gap, 1).otherwise(0)
    rows = figures.select(*keys, "x1").withColumn("_s", starts).withColumn("column", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return rows.groupBy(*keys, "column").agg(F.avg("x1").alias("edge"))


def nearest_edge(x1: Column, edges: Column) -> Column:
    """Index of the nearest of edges (array in column order), the lower one of two as near."""
    return F.array_min(F.transform(edges, lambda e, i: F.struct(F.abs(e - x1).alias("d"), i.alias("i"))))["i"]


def indent_levels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with indent: the dense rank of their label's rounded start among labelled rows; 0 without a label of that start."""
    start = F.rint("label_x0")
    labelled = F.coalesce(F.col("label") != "", F.lit(False))
    levels = rows.where(labelled).select(*keys, start.alias("_x")).distinct()
    levels = levels.withColumn("_level", F.row_number().over(W.partitionBy(*keys).orderBy("_x")) - 1)
    return rows.withColumn("_x", start).join(levels, [*keys, "_x"], "left").withColumn("indent", F.coalesce("_level", F.lit(0))).drop("_x", "_level")


def table_rows(words: DataFrame, merge_all: bool = False) -> DataFrame:
    """Rows (doc_id, page_index, row_no, top, bottom, label, label_x0, is_header, indent, cells) of words; cells map columns to figures.

    Columns are learned from rows that are not headers; of two figures in one column the left one stays.
    """
    parts = merged_words(page_rows(words), merge_all).withColumn("value", num.parse_number(F.col("text")))
    part = F.struct("position", "text", "value", "x0", "x1", "top", "bottom")
    rows = parts.groupBy(*_PAGE, "row_no").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    label_of = lambda ps: F.trim(F.array_join(F.transform(ps, lambda p: p["text"]), " "))
    rows = rows.withColumn("figures", F.filter("parts", lambda p: p["value"].isNotNull())).withColumn("others", F.filter("parts", lambda p: p["value"].isNull()))
    rows = rows.withColumn("is_header", num.is_header(label_of(F.col("others")), F.transform("figures", lambda p: p["text"])))
    figures = rows.where(~F.col("is_header")).select(*_PAGE, F.explode("figures").alias("p")).select(*_PAGE, F.col("p.x1").alias("x1"))
    edges = column_edges(figures, _PAGE).groupBy(*_PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "edge"))), lambda e: e["edge"]).alias("edges"))
    rows = rows.join(edges, _PAGE, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    has = F.size("edges") > 0
    placed = F.transform("figures", lambda p: F.struct(nearest_edge(p["x1"], F.col("edges")).alias("column"), p["value"].alias("value"), F.trim(p["text"]).alias("text"), p["x0"].alias("x0"), p["x1"].alias("x1"), p["top"].alias("top"), p["bottom"].alias("bottom")))
    first = F.filter(placed, lambda c, i: ~F.exists(F.slice(placed, 1, i), lambda e: e["column"] == c["column"]))
    rows = rows.withColumn("cells", F.when(has, F.map_from_entries(F.transform(first, lambda c: F.struct(c["column"], c)))))
    rows = rows.withColumn("label", label_of(F.when(has, F.col("others")).otherwise(F.col("parts"))))
    rows = rows.withColumn("label_x0", F.element_at("parts", 1)["x0"])
    return indent_levels(rows, _PAGE).select(*_PAGE, "row_no", "top", "bottom", "label", "label_x0", "is_header", "indent", "cells")


def cells(rows: DataFrame) -> DataFrame:
    """One row a figure of table_rows(): page, column, row_no, label and the figure's place; headers are left out."""
    own = rows.where(~F.col("is_header") & F.col("cells").isNotNull())
    return own.select(*_PAGE, "row_no", "label", F.explode("cells").alias("column", "c")).select(*_PAGE, "row_no", "label", "column", "c.value", "c.x0", "c.x1", "c.top", "c.bottom")
