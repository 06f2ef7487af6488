import pytest
from pyspark.sql import functions as F

from barwise.functions import numbers as num
from barwise.operators import footing, layout


@pytest.mark.parametrize("token,value", [("1234", 1234), ("1,234,567", 1234567), ("1 234 567", 1234567), ("(1,200)", -1200), ("-500", -500), ("–500", -500), ("INR 8,750", 8750), ("₹12,450", 12450), ("Rs. 100", 100), ("-", 0), ("nil", 0), ("", None), ("Total", None), ("12.5%", None), ("1,234.50", 1234.5), ("INR -500", -500), (None, None)])
def test_parse_number(spark, token, value):
    assert spark.createDataFrame([(token,)], "t string").select(num.parse_number(F.col("t"))).first()[0] == value


def test_labels(spark):
    rows = spark.createDataFrame([("Sub-total",), ("Total assets",), ("totally",), ("Net profit",), ("Cash flow hedge",)], "l string")
    assert [tuple(r) for r in rows.select(num.is_total(F.col("l")), num.is_derived(F.col("l"))).collect()] == [(True, False), (True, False), (False, False), (False, True), (False, False)]
    assert [r[0] for r in spark.createDataFrame([(1234.0,), (1234.5,)], "v double").select(num.format_number(F.col("v"))).collect()] == ["1,234", "1,234.50"]


def cells(spark, rows, doc=0):
    out = []
    for i, (label, values) in enumerate(rows):
        for c, v in (values if isinstance(values, dict) else {0: values}).items():
            out.append((doc, 0, i, label, c, float(v), 100.0 + 40 * c, 130.0 + 40 * c, 12.0 * i, 12.0 * i + 10))
    return spark.createDataFrame(out, "doc_id long, page_index int, row_no int, label string, column int, value double, x0 double, x1 double, top double, bottom double")


def issues(spark, rows):
    return [(r.label, r.stated, r.expected) for r in footing.analyze(cells(spark, rows)).where("status = 'error'").orderBy("row_no").collect()]


def test_footing(spark):
    assert issues(spark, [("Sales", 100), ("Services", 50), ("Total revenue", 160)]) == [("Total revenue", 160, 150)]
    assert issues(spark, [("Inventories", 100), ("Cash", 50), ("Total current assets", 150), ("PPE", 200), ("Total non-current assets", 200), ("Total assets", 350)]) == []
    assert issues(spark, [("a", 33.3), ("b", 33.3), ("c", 33.4), ("Total", 100.0)]) == []
    assert issues(spark, [("Net profit", 8509), ("a", 100), ("b", 200), ("Total OCI", 300), ("Total comprehensive income", 8809)]) == []
    assert issues(spark, [("a", -236), ("b", 374), ("", 138), ("c", -11), ("d", 1021), ("e", -93), ("", 917), ("Total OCI", 1055)]) == []
    assert issues(spark, [("Cash", {0: 10, 1: 10}), ("Receivables", {0: 20}), ("Total", {0: 30, 1: 30})]) == []
    assert issues(spark, [("a", 100), ("b", 50), ("Total current assets", 999)]) == [("Total current assets", 999, 150)]


def test_sample_statement(spark):
    sheet = [("Property, plant and equipment", 12450), ("Goodwill", 1200), ("Intangible assets", 800), ("Total non-current assets", 14450), ("Inventories", 6800), ("Trade receivables", 3400), ("Cash and cash equivalents", 8750), ("Total current assets", 19050), ("Total assets", 33400)]
    income = [("Revenue from operations", 24800), ("Other income", 450), ("Total income", 25250), ("Cost of materials consumed", 11200), ("Employee benefit expense", 2150), ("Finance costs", 600), ("Depreciation", 1300), ("Other expenses", 3000), ("Total expenses", 18000), ("Profit for the year", 7000)]
    both = cells(spark, sheet, 0).unionByName(cells(spark, income, 1))
    got = footing.analyze(both)
    assert sorted((r.label, r.difference) for r in got.where("status = 'error'").collect()) == [("Total current assets", 100.0), ("Total expenses", -250.0)]
    marks = {r.mark: r["count"] for r in footing.annotations(got).groupBy("mark").count().collect()}
    assert marks["error"] == 2
    assert {r.doc_id: r.consistent for r in footing.report(got).collect()} == {0: False, 1: False}


def words(spark, lines):
    out = []
    for i, line in enumerate(lines):
        for text, x0, x1 in line:
            out.append((1, 0, text, float(x0), float(x1), 20.0 * i + (0.5 if x0 > 100 else 0.0), 20.0 * i + 10))
    return spark.createDataFrame(out, "doc_id long, page_index int, text string, x0 double, x1 double, top double, bottom double")


def test_layout(spark):
    page = words(
        spark,
        [
            [("Particulars", 10, 60), ("2024", 200, 230), ("2023", 300, 330)],
            [("Trade", 20, 40), ("receivables", 42, 80), ("1", 190, 195), ("234", 198, 230), ("(50)", 305, 331)],
            [("Cash", 20, 40), ("100", 212, 229), ("7", 322, 330)],
            [("Total", 10, 30), ("1,334", 205, 230), ("-43", 310, 330)],
        ],
    )
    rows = layout.table_rows(page).orderBy("row_no").collect()
    assert [(r.label, r.is_header, r.indent) for r in rows] == [("Particulars", True, 0), ("Trade receivables", False, 1), ("Cash", False, 1), ("Total", False, 0)]
    got = [(r.label, r.column, r.value) for r in layout.cells(layout.table_rows(page)).orderBy("row_no", "column").collect()]
    assert got == [("Trade receivables", 0, 1234.0), ("Trade receivables", 1, -50.0), ("Cash", 0, 100.0), ("Cash", 1, 7.0), ("Total", 0, 1334.0), ("Total", 1, -43.0)]
    checks = footing.analyze(layout.cells(layout.table_rows(page))).collect()
    assert [c.status for c in checks] == ["ok", "ok"]
    assert layout.table_rows(page.limit(0)).count() == 0
