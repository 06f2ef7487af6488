import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barwise.functions import calendar as cal
from barwise.operators import actions as act
from barwise.operators import ingest, integrity

D = dt.date


@pytest.fixture(scope="module")
def week(spark):
    days = cal.calendar_days(spark, "2025-08-04", "2025-08-08").cache()
    grid = cal.bar_grid(days, "15m")
    bars = grid.selectExpr("'A' AS symbol", "day", "bar", "100.0D AS open", "101.0D AS high", "99.0D AS low", "100.5D AS close", "10L AS volume")
    bars = bars.withColumn("ts", cal.at_second(F.col("day"), F.col("bar"), "timestamp")).withColumn("seq", F.unix_seconds("ts"))
    return days, grid.cache(), bars.cache()


def test_grid_checks(week):
    days, grid, bars = week
    assert bars.count() == 125
    gone = bars.where("not (day = '2025-08-06' and bar < 36000)")
    assert integrity.missing_bars(gone, grid, ["symbol"], ["day", "bar"]).count() == 3
    stray = bars.unionByName(bars.limit(1).withColumn("bar", F.lit(56820)))
    assert integrity.unexpected_bars(stray, grid, ["day", "bar"]).count() == 1
    assert integrity.duplicate_keys(bars.unionByName(bars.where("day = '2025-08-04' and bar < 35000")), ["symbol", "ts"]).count() == 2
    gaps = integrity.session_gaps(bars.where("day <> '2025-08-06'"), ["symbol"], days).collect()
    assert [tuple(r) for r in gaps] == [("A", D(2025, 8, 5), D(2025, 8, 7), 1)]


def test_full_report(week):
    days, grid, bars = week
    assert integrity.check_bars(bars, ["symbol"], grid, grid, days).count() == 0
    bad = bars.withColumn("volume", F.when(F.col("bar") == 33300, -5).otherwise(F.col("volume"))).where("day <> '2025-08-05'")
    got = {r.check: r for r in integrity.check_bars(bad, ["symbol"], grid, grid, days).collect()}
    assert got["missing_bars"].n == 25 and got["missing_bars"].severity == "error" and got["missing_bars"].places == [D(2025, 8, 5)]
    assert got["invalid_ohlc"].n == 4
    assert integrity.report_totals(integrity.check_bars(bad, ["symbol"], grid, grid, days), ["symbol"]).first().is_clean is False


def test_invalid_reasons(spark):
    rows = [(1.0, 2.0, 1.0, 2.0, 5), (1.0, 0.5, 1.0, 1.0, 5), (float("nan"), 2.0, 1.0, 1.5, -1), (None, 2.0, 1.0, 1.5, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "open double, high double, low double, close double, volume long").select(integrity.invalid_reasons()).collect()]
    assert got == ["", "high<low, open outside range, close outside range", "open outside range, negative volume", "open outside range"]


def test_reconcile_and_holidays(week):
    days, grid, bars = week
    changed = bars.withColumn("close", F.col("close") * F.when(F.col("bar") == 33300, 1.01).otherwise(1.0))
    assert [r.field for r in integrity.reconcile(changed, bars, ["symbol", "ts"]).collect()] == ["close"] * 5
    zero = integrity.reconcile(bars, bars.withColumn("volume", F.lit(0)), ["symbol", "ts"]).first()
    assert math.isinf(zero.relative_error)
    series = [bars.withColumn("symbol", F.lit(f"S{i}")) for i in range(6)]
    panel = series[0]
    for s in series[1:]:
        panel = panel.unionByName(s)
    panel = panel.where("day <> '2025-08-06'")
    assert [r.day for r in integrity.missing_holidays(panel, days).collect()] == [D(2025, 8, 6)]
    assert integrity.missing_holidays(panel.where("symbol < 'S3'"), days).count() == 0


def actions(spark, *rows):
    names = "symbol string, ex_date date, action_type string, ratio_new double, ratio_old double, value_per_share_inr double, rights_issue_price_inr double, price_factor_override double, cum_close double"
    return spark.createDataFrame([("A", D(2020, 1, 1), *r) for r in rows], names)


def test_factors(spark):
    got = act.with_factors(
        actions(spark, ("SPLIT", 2.0, 1.0, None, None, None, None), ("BONUS", 4.0, 3.0, None, None, None, None), ("DIVIDEND", None, None, 10.0, None, None, 500.0), ("DEMERGER", None, None, 261.85, None, None, 2841.85), ("RIGHTS", 1.0, 4.0, None, 100.0, None, 200.0), ("MERGER", None, None, None, None, 0.42, None), ("MERGER", None, None, None, None, None, None), ("DEMERGER", None, None, 5.0, None, None, None), ("SPLIT", None, 1.0, None, None, None, None)),
        adjust_dividends=True,
    ).collect()
    assert [(r.price_factor and round(r.price_factor, 9), r.volume_factor and round(r.volume_factor, 9)) for r in got] == [(0.5, 2.0), (0.75, round(4 / 3, 9)), (0.98, 1.0), (round(2580 / 2841.85, 9), 1.0), (0.9, 1.25), (0.42, 1.0), (None, None), (None, None), (None, None)]
    assert [r.status for r in got][-3:] == ["skipped"] * 3


def series(spark, rows):
    return spark.createDataFrame([("A", t, v, v * 1.01, v * 0.99, v, 1_000_000) for t, v in rows], "symbol string, t string, open double, high double, low double, close double, volume long").select("symbol", F.col("t").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")


def split(spark, *days):
    rows = [("A", D(*d), "SPLIT", 2.0, 1.0, None, None, None, None) for d in days]
    return spark.createDataFrame(rows, "symbol string, ex_date date, action_type string, ratio_new double, ratio_old double, value_per_share_inr double, rights_issue_price_inr double, price_factor_override double, note string")


def test_adjustment(spark):
    bars = series(spark, [("2019-09-17 09:15", 2200.0), ("2019-09-18 09:15", 2210.0), ("2019-09-19 09:15", 1105.0), ("2019-09-20 09:15", 1110.0)])
    done = act.with_factors(act.with_cum_close(split(spark, (2019, 9, 19)), bars))
    assert done.first().cum_close == 2210.0
    assert [r.close for r in act.adjust(bars, done).orderBy("ts").collect()] == [1100.0, 1105.0, 1105.0, 1110.0]
    two = series(spark, [("2020-01-01", 400.0), ("2021-01-04", 200.0), ("2022-01-03", 100.0)])
    both = act.with_factors(act.with_cum_close(split(spark, (2020, 6, 1), (2021, 6, 1)), two))
    assert [r.close for r in act.adjust(two, both).orderBy("ts").collect()] == [100.0] * 3
    clean = series(spark, [(f"2019-09-{d:02d}", 100.0 + d) for d in range(10, 28)])
    raw = act.deadjust(clean, "2019-09-19", 2, 1)
    back = act.adjust(raw, act.with_factors(act.with_cum_close(split(spark, (2019, 9, 19)), raw)))
    assert all(abs(a.close / b.close - 1) < 1e-9 for a, b in zip(back.orderBy("ts").collect(), clean.orderBy("ts").collect(), strict=True))
    found = integrity.suspected_actions(raw.withColumn("day", F.to_date("ts")), ["symbol"], 0.2).collect()
    assert [r.day for r in found] == [D(2019, 9, 19)]


def test_ingest(spark):
    days = cal.calendar_days(spark, "2024-01-01", "2025-12-31")
    plan = lambda a, b, cap: ingest.chunk_plan(spark.createDataFrame([("A", a, b)], "symbol string, start date, end date"), days, cap, ["symbol"]).orderBy("chunk").collect()
    got = plan(D(2025, 8, 2), D(2025, 8, 31), 30)
    assert len(got) == 1 and (got[0].first_day, got[0].last_day) == (D(2025, 8, 4), D(2025, 8, 29))
    assert plan(D(2025, 8, 9), D(2025, 8, 10), 30) == []
    assert all((r.last_day - r.first_day).days < 60 for r in plan(D(2024, 1, 1), D(2024, 12, 31), 60))
    assert spark.range(8).select(ingest.backoff(F.col("id"))).collect()[5:] == [(32.0,), (60.0,), (60.0,)]
