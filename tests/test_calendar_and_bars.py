import datetime as dt

import pytest

from barwise.functions import calendar as cal
from barwise.operators import bars as ops
from barwise.schemas import BAR, ContractError, require, require_zoned
from pyspark.sql import functions as F

D = dt.date


@pytest.fixture(scope="module")
def days(spark):
    return cal.calendar_days(spark, "2025-08-01", "2025-10-31").cache()


def test_bars_a_session(spark, days):
    day = days.where("day = '2025-08-04'")
    assert [cal.bar_grid(day, t).count() for t in ("1m", "5m", "15m", "1h", "1d")] == [375, 75, 25, 7, 1]
    last = cal.bar_grid(day, "1h").agg(F.max("bar").alias("bar")).join(day).select(cal.is_partial(F.col("bar"), "1h"), cal.bar_end_second(F.col("bar"), "1h")).first()
    assert tuple(last) == (True, 15 * 3600 + 1800)


def test_special_session_and_holidays(days):
    assert days.where("day = '2025-10-21'").select("status", "is_trading_day", "tradeable").first() == ("special", False, False)
    assert cal.bar_grid(days.where("day = '2025-10-21'"), "15m", include_special=True).count() == 4
    assert cal.bar_grid(days.where("day = '2025-10-21'"), "15m").count() == 0
    assert [r.status for r in days.where("day between '2025-08-14' and '2025-08-18'").orderBy("day").collect()] == ["open", "holiday", "weekend", "weekend", "open"]


def test_phases_and_floors(spark, days):
    times = "08:30 09:05 09:15 12:00 15:29 15:30 15:45 16:30".split()
    rows = spark.createDataFrame([(i, f"2025-08-04 {t}:00") for i, t in enumerate(times)], "i int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = cal.with_calendar(rows, days).orderBy("i").select(cal.phase(), cal.bar_second("15m"), cal.session_date()).collect()
    assert [r[0] for r in got] == ["closed", "pre_open", "continuous", "continuous", "continuous", "closed", "post_close", "closed"]
    assert [r[1] for r in got] == [None, None, 33300, 43200, 54900, None, None, None]
    assert [r[2] is not None for r in got] == [False, True, True, True, True, True, True, False]


def test_nth_day_and_sessions(spark, days):
    rows = spark.createDataFrame([(D(2025, 8, 14),), (D(2025, 8, 16),), (D(2025, 8, 4),)], "day date")
    assert {r.day: r.target for r in cal.nth_trading_day(rows, days, 1).collect()} == {D(2025, 8, 14): D(2025, 8, 18), D(2025, 8, 16): D(2025, 8, 18), D(2025, 8, 4): D(2025, 8, 5)}
    assert {r.day: r.target for r in cal.nth_trading_day(rows, days, -1).collect()} == {D(2025, 8, 14): D(2025, 8, 13), D(2025, 8, 16): D(2025, 8, 14), D(2025, 8, 4): D(2025, 8, 1)}
    span = spark.createDataFrame([(D(2025, 8, 14), D(2025, 8, 19))], "start date, end date")
    assert cal.sessions_between(span, days).first().sessions == 2


def fold(spark, days, rows, timeframe="15m", **kw):
    data = [("NSE:RELIANCE", f"2025-08-{t}", i, p, q, c) for i, (t, p, q, c) in enumerate(rows)]
    t = spark.createDataFrame(data, "key string, t string, seq long, price double, qty long, cum long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    t = cal.with_calendar(t, days)
    return ops.bars_from_ticks(t, timeframe, **kw).orderBy("run", "bar").collect(), {r.outcome: r.n for r in ops.rejections(ops.judged(t, timeframe)).collect()}


def test_tick_fold(spark, days):
    got, _ = fold(spark, days, [("04 09:15:00", 100.0, None, None), ("04 09:18:00", 105.0, None, None), ("04 09:22:00", 95.0, None, None), ("04 09:29:00", 102.0, None, None), ("04 09:31:00", 101.0, None, None)])
    assert [(r.open, r.high, r.low, r.close) for r in got] == [(100, 105, 95, 102), (101, 101, 101, 101)]
    got, _ = fold(spark, days, [("04 09:16:00", 1.0, None, 1000), ("04 09:25:00", 1.0, None, 3000), ("04 09:31:00", 1.0, None, 3500), ("04 09:46:00", 1.0, None, 5000)])
    assert [r.volume for r in got] == [3000, 500, 1500]
    got, _ = fold(spark, days, [("04 11:05:00", 1.0, None, 9_000_000), ("04 11:20:00", 1.0, None, 9_010_000)])
    assert (got[0].volume, got[0].volume_estimated, got[1].volume) == (0, True, 10_000)
    got, _ = fold(spark, days, [("04 09:16:00", 1.0, 10, None), ("04 09:20:00", 1.0, 10, None), ("04 09:25:00", 1.0, 10, None)])
    assert got[0].volume == 30
    got, _ = fold(spark, days, [("04 15:20:00", 1.0, None, 9_000_000), ("05 09:16:00", 1.0, None, 1000), ("05 09:31:00", 1.0, None, 4000)])
    assert [(r.day, r.volume) for r in got] == [(D(2025, 8, 4), 0), (D(2025, 8, 5), 1000), (D(2025, 8, 5), 3000)]


def test_rejections(spark, days):
    got, out = fold(spark, days, [("04 09:20:00", 100.0, None, None), ("04 09:35:00", 101.0, None, None), ("04 09:25:00", 999.0, None, None), ("04 09:05:00", 1.0, None, None), ("04 15:47:00", 1.0, None, None), ("15 11:00:00", 1.0, None, None)])
    assert out == {"accepted": 2, "late_tick": 1, "outside_session": 2, "non_trading_day": 1} and got[-1].high == 101
    got, out = fold(spark, days, [("04 09:20:30", 100.0, None, None), ("04 09:20:10", 90.0, None, None)])
    assert got[0].close == 100 and out == {"accepted": 1, "late_tick": 1}
    back = [("05 09:20:00", 1.0, None, None), ("04 09:20:00", 2.0, None, None)]
    assert len(fold(spark, days, back)[0]) == 2
    assert len(fold(spark, days, back, strict_sessions=True)[0]) == 1


def test_rollup_leaves_closed_days(spark, days):
    rows = spark.createDataFrame([("A", f"2025-08-{d} {h}:15:00", o, o + 1, o - 1, o, 10) for d, h, o in (("04", "09", 5.0), ("04", "10", 7.0), ("15", "10", 9.0))], "symbol string, t string, open double, high double, low double, close double, volume long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got, closed = ops.rollup_to_days(rows, ["symbol"], days)
    assert [tuple(r)[2:7] for r in got.select("symbol", "ts", "open", "high", "low", "close", "volume").collect()] == [(5.0, 8.0, 4.0, 7.0, 20)]
    assert closed.count() == 1


def test_contracts(spark):
    with pytest.raises(ContractError):
        require(spark.range(1), ["ts"])
    with pytest.raises(ContractError):
        require_zoned(spark.sql("SELECT timestamp_ntz'2024-01-01' AS ts"))
    assert require_zoned(spark.createDataFrame([], BAR)).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_a_very_active_key_is_folded_in_blocks(spark, days, strict):
    """Blocks of a few ticks give what one block gives: steps back in time and to earlier days, ticks outside sessions, closed days."""
    import random

    r = random.Random(6)
    rows, at = [], 0
    for i in range(400):
        at += r.choice([60, 200, 1500, -90, -300])
        day = 4 + (i // 60) % 6 - (r.random() < 0.08)
        rows.append(("HOT" if i % 7 else "NSE:B" if i % 2 else None, f"2025-08-{day:02d}", (9 * 3600 + at % 25000), i * 3 if i < 300 else i * 50, float(i % 17), 1, 5 * i if i % 5 else None))
    t = spark.createDataFrame(rows, "key string, d string, s int, seq long, price double, qty long, cum long")
    t = cal.with_calendar(t.withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.col("d").cast("timestamp")) + F.col("s"))).drop("d", "s"), days).cache()
    want, got = (ops.judged(t, "15m", strict, n).select("key", "seq", "bar", "run", "reason").orderBy("seq").collect() for n in (10**9, 5))
    assert got == want and {x.reason for x in want} >= {None, "late_tick", "outside_session"}
    one, many = (sorted(map(str, ops.bars_from_ticks(t, "15m", strict, n).collect())) for n in (10**9, 5))
    assert one == many and len(one) > 50
    blocks = ops._blocked(t, 5).where("key = 'HOT'").groupBy("_block").count().collect()
    assert len(blocks) > 20
