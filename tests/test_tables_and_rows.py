import random

import pytest
from pyspark.sql import functions as F

from barwise.operators import layout
from barwise.sources import html_tables
from barwise.sources.html_tables import cells_of


def rows_of_words(words, tolerance):
    """The first row whose first word is near enough, word by word."""
    rows = []
    for w in sorted(words, key=lambda w: (round(w[0]), w[1])):
        row = next((r for r in rows if abs(r[0][0] - w[0]) <= tolerance), None)
        if row is None:
            rows.append([w])
        else:
            row.append(w)
    return [[w[2] for w in sorted(r, key=lambda w: w[1])] for r in rows]


@pytest.mark.parametrize("tolerance", [3.0, 5.5])
def test_rows_of_words(spark, tolerance):
    r = random.Random(4)
    pages = {p: [(round(r.uniform(0, 60 if p % 2 else 400), 2), float(x), f"w{x}") for x in range(80)] for p in range(12)}
    rows = [(1, p, t, x, x + 1.0, top, top + 8) for p, words in pages.items() for top, x, t in words]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, text string, x0 double, x1 double, top double, bottom double")
    got = {}
    for x in layout.page_rows(df, tolerance).collect():
        got.setdefault(x.page_index, {})[x.row_no] = [w.text for w in x.ws]
    assert {p: [rs[i] for i in range(len(rs))] for p, rs in got.items()} == {p: rows_of_words(words, tolerance) for p, words in pages.items()}
    assert "Python" not in layout.table_rows(df)._jdf.queryExecution().executedPlan().toString()


def texts(html):
    out = {}
    for t, _, r, c, n, _, text in cells_of(html):
        out.setdefault(t, {})[r, c] = (text, n)
    return out


def test_tables_nobody_closed():
    assert texts("<table><tr><td>a<td>b<tr><td>c") == {0: {(0, 0): ("a", 1), (0, 1): ("b", 1), (1, 0): ("c", 1)}}
    assert texts("<table><td>lone</table>text<td>outside") == {0: {(0, 0): ("lone", 1)}}


def test_spans():
    html = "<table><tr><th colspan=2>wide<th rowspan='2'>tall</tr><tr><td>1</td><td>2</td></tr><tr><td>3<td>4<td colspan='x'>5</table>"
    assert texts(html)[0] == {(0, 0): ("wide", 2), (0, 2): ("tall", 1), (1, 0): ("1", 1), (1, 1): ("2", 1), (2, 0): ("3", 1), (2, 1): ("4", 1), (2, 2): ("5", 1)}
    assert texts("<table><tr><td rowspan=3>a<td>b<tr><td>c<tr><td>d<tr><td>e</table>")[0] == {(0, 0): ("a", 1), (0, 1): ("b", 1), (1, 1): ("c", 1), (2, 1): ("d", 1), (3, 0): ("e", 1)}


def test_nested_tables_and_references():
    html = "<table><tr><td>M&amp;M &#8377;5 <table><tr><td>in<script>no()</script>ner</td></tr></table> more<br>text</td><td>&lt;b&gt;</td></tr></table>"
    assert texts(html) == {0: {(0, 0): ("M&M ₹5 more text", 1), (0, 1): ("<b>", 1)}, 1: {(0, 0): ("inner", 1)}}
    assert [c[1] for c in cells_of(html)] == [0, 0, 1]


def test_symbols_from_the_first_table_that_has_them(spark):
    one = "<table><tr><td>Symbol of fame<td>x<tr><td>no</table>"
    two = "<table><tr><th>Company<th>Ticker &amp; more<tr><td>A<td><a href=x>AB</a><tr><td colspan=2>note<tr><td>B<td>C.BO<tr><td>D<td> </table><table><tr><th>Symbol<tr><td>late</table>"
    pages = spark.createDataFrame([("p", two), ("q", None), ("r", "<p>none"), ("s", one)], "page_id string, html string").withColumn("text", F.lit("own")).withColumn("row_no", F.lit(1))
    got = sorted(map(tuple, html_tables.symbols_from_tables(pages).collect()))
    assert got == [("p", "AB", "AB.NS"), ("p", "C.BO", "C.BO"), ("s", "no", "no.NS")]
    assert html_tables.table_cells(pages.limit(0)).count() == 0
