import random
import time

import pytest
from pyspark.sql import functions as F

from barwise.operators import footing

CELL = "doc_id long, page_index int, row_no int, label string, column int, value double, x0 double, x1 double, top double, bottom double"
LABELS = {"a": 0, "": 0, "Total": 2, "Net profit": 1}


def drawn(docs, rows, columns, seed=0):
    """Random statements: sums that are right, off, without a name, over groups, and over derived figures."""
    r, out, first = random.Random(seed), [], {}
    for doc in range(docs):
        for column in range(columns):
            run, groups = [], []
            for n in range(rows):
                label = r.choice(["a"] * 6 + ["", "Total", "Total", "Net profit"])
                value = float(r.randint(1, 9))
                if label == "Total":
                    value = float(r.choice([sum(run), sum(run[-3:]), sum(groups[-2:]), 4000 + n % 7]))
                    if (doc, n) in first and r.random() < 0.5:  # a split column's figure
                        value = first[doc, n]
                    first.setdefault((doc, n), value)
                    groups, run = groups + [value], []
                elif label == "" and r.random() < 0.7:
                    value, run = float(sum(run)), []
                else:
                    run.append(value)
                out.append((doc if doc else None, doc % 2, n, label, column, value * 20, 100.0 + 40 * column, 130.0, 12.0 * n if n % 50 else None, 0.0))
    return out


def plain(rows):
    """The table of operators.footing, with a whole list of entries at each step."""
    out, columns = [], {}
    for doc, page, n, label, column, value, x0, _, top, _ in rows:
        columns.setdefault((doc, page, column), []).append((n, label, value, x0, top))
    for key, figures in columns.items():
        entries = []  # (value, figure, name, kind)
        for f in sorted(figures, key=lambda f: f[0]):
            n, label, value, *_ = f
            fits = lambda xs: abs(sum(x[0] for x in xs) - value) <= 1 + 0.5 * len(xs) + 1e-9 * abs(value)  # noqa: B023, E731
            tail = next((i for i, e in enumerate(reversed(entries)) if e[3] != "open"), len(entries))
            own, kind, status, pos, stated = LABELS[label], None, "ok", [], value
            if own == 2:
                kind, end = "total", 0
                for q in range(1, min(80, len(entries)) + 1):
                    if fits(entries[-q:]):
                        end = q
                        break
                    if entries[-q][3] == "wall":
                        break
                groups = [i for i, e in enumerate(entries) if e[3] == "closed"]
                if end:
                    pos = range(len(entries) - end, len(entries))
                elif tail >= 2:
                    pos, status = range(len(entries) - tail, len(entries)), "error"
                elif not tail and len(groups) >= 2:
                    pos, status = groups[-2:], "error"
                else:
                    status = "unverified"
            elif own == 0 and tail >= 2 and fits(entries[-tail:]):
                kind, pos = "implicit", range(len(entries) - tail, len(entries))
            parts = [entries[i] for i in pos]
            expected = sum(p[0] for p in parts) if parts else value
            name = footing.IMPLICIT if kind == "implicit" and label == "" else label
            if kind:
                out.append((*key, n, name, kind, status, stated, expected, f[4], [(p[1][0], p[2], p[0], p[1][4]) for p in parts]))
            entries = [e for i, e in enumerate(entries) if i not in pos] + [(expected if status == "error" else value, f, name, "closed" if kind else "wall" if own else "open")]
    return out


def plain_split(checks):
    good = {(c[0], c[1], round(c[9]), c[7]) for c in checks if c[5] == "total" and c[6] == "ok" and None not in (c[0], c[9])}
    return [c for c in checks if c[6] != "error" or c[9] is None or (c[0], c[1], round(c[9]), c[7]) not in good]


def got(df):
    rows = df.select("doc_id", "page_index", "column", "row_no", "label", "kind", "status", "stated", "expected", "top", "components").collect()
    return sorted(map(repr, ((*r[:-1], [(c.row_no, c.label, c.value, c.top) for c in r.components]) for r in rows)))


@pytest.mark.parametrize("batch", [17, 10_000])
def test_fold_agrees_with_whole_lists_whatever_the_batches(spark, batch):
    rows = drawn(6, 300, 3)
    cells = spark.createDataFrame(rows, CELL).repartition(5)
    want = plain(rows)
    assert {(c[5], c[6]) for c in want} == {("total", "ok"), ("total", "error"), ("total", "unverified"), ("implicit", "ok")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert got(footing.column_checks(cells)) == sorted(map(repr, want))
        split = plain_split(want)
        assert 0 < len(want) - len(split) and got(footing.analyze(cells)) == sorted(map(repr, split)) == got(footing.without_split_columns(footing.column_checks(cells)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_are_folded_once(spark):
    plan = footing.analyze(spark.createDataFrame(drawn(2, 20, 2), CELL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "aggregate(" not in plan


def test_a_row_costs_the_same_in_a_long_column(spark):
    def seconds(columns, rows):
        n = spark.range(columns * rows)
        cells = n.select((F.col("id") / rows).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("id") % rows).cast("int").alias("row_no"), F.when(F.col("id") % 11 == 10, "Total").otherwise("a").alias("label"), F.lit(0).alias("column"), F.when(F.col("id") % 11 == 10, 1e6).otherwise(7.0).alias("value"), F.lit(0.0).alias("x0"), F.col("id").cast("double").alias("top"))
        start = time.time()
        assert footing.column_checks(cells.repartition(1)).where("status = 'error'").count() > 0
        return time.time() - start

    seconds(4, 1000)
    assert seconds(1, 40_000) < 3 * seconds(40, 1000) + 10
