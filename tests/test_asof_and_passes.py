import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barwise.functions import calendar as cal
from barwise.operators import actions as act
from barwise.operators import integrity
from barwise.operators.asof import as_of

D = dt.date


@pytest.mark.parametrize(("forward", "strict", "block"), [(False, True, "year"), (False, False, "month"), (True, True, "month"), (True, False, "day")])
def test_as_of_agrees_with_brute_force(spark, forward, strict, block):
    r = random.Random(3)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(500), hours=r.randrange(3))
    left = [(i, r.choice(["a", "b", None, "only left"]), None if i % 23 == 0 else day()) for i in range(120)]
    right = [(r.choice(["a", "b", None, "only right"]), None if i % 19 == 0 else day(), None if i % 7 == 0 else i) for i in range(80)]
    right += right[:5]
    got = as_of(spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, v int"), ["k"], F.col("t"), F.col("t"), F.col("v"), "v", forward, strict, block)
    assert got.columns == ["i", "k", "t", "v"]

    def best(k, t):
        if t is None:
            return None
        ok = [(u, v) for kk, u, v in right if kk == k and u is not None and ((u > t or not strict and u == t) if forward else (u < t or not strict and u == t))]
        if not ok:
            return None
        at = (min if forward else max)(u for u, _ in ok)
        return max((v for u, v in ok if u == at and v is not None), default=None)

    assert sorted(map(str, got.collect())) == sorted(str(tuple_row) for tuple_row in [got_row(i, k, t, best(k, t)) for i, k, t in left])


def got_row(i, k, t, v):
    from pyspark.sql import Row

    return Row(i=i, k=k, t=t, v=v)


def test_rows_through_an_as_of_join_follow_both_sides(spark):
    """A bar meets one value however many actions its symbol has."""
    left = spark.range(300).selectExpr("'s' AS k", "timestamp_seconds(id * 86400) AS t")
    right = spark.range(300).selectExpr("'s' AS k", "timestamp_seconds(id * 86400 + 5) AS t", "id AS v")
    got = as_of(left, right, ["k"], F.col("t"), F.col("t"), F.col("v"), "v")
    assert got.count() == 300 and got.agg(F.sum("v")).first()[0] == sum(range(299))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_factors_of_zero_and_below_multiply_as_they_are(spark):
    rows = [("A", D(2020, 3, 1), -2.0, 3.0), ("A", D(2021, 3, 1), 0.0, 1.0), ("A", D(2022, 3, 1), 0.5, 2.0), ("A", D(2022, 3, 1), 0.5, 2.0), ("B", D(2022, 3, 1), 4.0, 0.25)]
    actions = spark.createDataFrame(rows, "symbol string, ex_date date, price_factor double, volume_factor double").withColumn("status", F.lit("applied"))
    days = [D(2020, 1, 1), D(2020, 3, 1), D(2021, 2, 28), D(2021, 3, 1), D(2022, 2, 28), D(2022, 3, 1)]
    bars = spark.createDataFrame([(s, d, 100.0, 8) for s in ("A", "B", "C") for d in days], "symbol string, ts date, close double, volume long")
    bars = bars.selectExpr("symbol", "CAST(ts AS timestamp) AS ts", "close AS open", "close AS high", "close AS low", "close", "volume")

    def factor(s, d, at):
        p = 1.0
        for row in rows:
            if row[0] == s and row[1] > d:
                p *= row[at]
        return p

    got = {(r.symbol, r.ts.date()): (r.price_factor, r.volume_factor, r.close, r.raw_close) for r in act.adjust(bars, actions).collect()}
    assert got == {(s, d): (factor(s, d, 2), factor(s, d, 3), 100.0 * factor(s, d, 2), 100.0) for s in ("A", "B", "C") for d in days}


def test_actions_of_one_symbol(spark):
    rows = spark.createDataFrame([("A", D(2020, 1, d)) for d in (1, 2, 3)] + [("B", D(2020, 1, 2))], "symbol string, ex_date date")
    assert [tuple(r) for r in act.between(rows, "2020-01-01", "2020-01-03", " a ").collect()] == [("A", D(2020, 1, 2)), ("A", D(2020, 1, 3))]
    assert act.between(rows, "2020-01-01", "2020-01-03").count() == 3


def test_one_pass_report_equals_the_single_checks(spark):
    """Every count, and the first ten days, of the checks made one by one."""
    r = random.Random(8)
    days = cal.calendar_days(spark, "2025-08-04", "2025-08-29").cache()
    grid, special = cal.bar_grid(days, "1h").cache(), cal.bar_grid(days, "1h", True).cache()
    slots = [(x.day, x.bar) for x in grid.collect()]
    rows = []
    for s in ("A", "B", "C", None):
        for n, (day, bar) in enumerate(slots):
            if r.random() < 0.1 and s != "C":
                continue
            close = r.choice([100.0, 101.0, 150.0, -1.0, float("nan")]) if r.random() < 0.2 and s != "C" else 100.0
            at = n if s == "C" or r.random() > 0.05 else n - 5
            for _ in range(1 if s == "C" else r.choice([1] * 12 + [2, 3])):
                rows.append((s, day, bar, at * 10 + len(rows) % 7, close if s != "B" else 100.0 + n % 5, 5))
        rows.append((s, D(2025, 8, 9), 40000, 10**6, 100.0, 5))
    bars = spark.createDataFrame(rows, "symbol string, day date, bar int, seq long, close double, volume long").where("symbol is not null")
    bars = bars.selectExpr("*", "close AS open", "close AS high", "close AS low").withColumn("ts", cal.at_second(F.col("day"), F.col("bar"), "timestamp")).withColumn("seq", F.col("seq") + F.unix_seconds("ts")).cache()
    known = spark.createDataFrame([("A", D(2025, 8, 5))], "symbol string, day date")
    got = {(x.symbol, x.check): (x.n, x.places, x.severity) for x in integrity.check_bars(bars, ["symbol"], grid, special, days, threshold=0.3, known=known).collect()}
    single = {
        "missing_bars": integrity.missing_bars(bars, grid, ["symbol"], ["day", "bar"]),
        "unexpected_bars": integrity.unexpected_bars(bars, special, ["day", "bar"]),
        "duplicate_bars": integrity.duplicate_keys(bars, ["symbol", "ts", "day"]),
        "out_of_order": integrity.out_of_order(bars, ["symbol"]),
        "invalid_ohlc": integrity.invalid_bars(bars),
    }
    want = {}
    for check, found in single.items():
        for x in found.groupBy("symbol").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("day")).alias("d")).collect():
            want[x.symbol, check] = (x.n, x.d[:10])
    assert {k: v[:2] for k, v in got.items() if k[1] != "suspected_unadjusted_action"} == want and len(want) >= 11
    assert got["A", "suspected_unadjusted_action"][0] > 0 and ("C", "missing_bars") not in got
    assert D(2025, 8, 5) not in got["A", "suspected_unadjusted_action"][1]


def test_a_report_reads_its_bars_once(spark):
    days = cal.calendar_days(spark, "2025-08-04", "2025-08-29")
    grid = cal.bar_grid(days, "1d")
    bars = spark.range(100).selectExpr("'A' AS symbol", "DATE'2025-08-04' AS day", "33300 AS bar", "id AS seq", "1.0D AS open", "1.0D AS high", "1.0D AS low", "1.0D AS close", "1L AS volume").withColumn("ts", F.col("day").cast("timestamp"))
    plan = integrity.check_bars(bars, ["symbol"], grid, grid, days)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 100") == 1


def test_no_grid_and_no_bars(spark):
    days = cal.calendar_days(spark, "2025-08-04", "2025-08-29")
    grid = cal.bar_grid(days, "1d")
    empty = spark.createDataFrame([], "symbol string, day date, bar int, seq long, open double, high double, low double, close double, volume long, ts timestamp")
    assert integrity.check_bars(empty, ["symbol"], grid, grid, days).count() == 0
    one = spark.createDataFrame([("A", D(2025, 8, 4), 33300, 1, 1.0, 1.0, 1.0, 1.0, 1, dt.datetime(2025, 8, 4, 9, 15))], empty.schema)
    got = integrity.check_bars(one, ["symbol"], grid.where("false"), grid.where("false"), days).collect()
    assert [(x.check, x.n) for x in got] == [("unexpected_bars", 1)]
