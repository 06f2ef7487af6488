import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from barwise.functions import calendar as cal
from barwise.operators import bars as ops
from barwise.sources import replay, vendor
from barwise.sources.store import BarStore
from barwise.streaming import candles


def some_bars(spark, day, close=1.0, symbol="M&M"):
    rows = [("NSE", symbol, "15m", f"{day} {9 + i // 4:02d}:{i % 4 * 15:02d}:00", close, close, close, close, 10 + i, None) for i in range(1, 5)]
    names = "exchange string, symbol string, timeframe string, t string, open double, high double, low double, close double, volume long, oi long"
    return spark.createDataFrame(rows, names).withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_store(spark, tmp_path):
    store = BarStore(spark, f"{tmp_path}/bars")
    assert store.read("NSE", "X", "15m").count() == 0 and store.symbols("NSE") == []
    assert store.write(some_bars(spark, "2025-08-04")) == 4
    assert store.write(some_bars(spark, "2025-09-04").unionByName(some_bars(spark, "2025-09-04", 3.0)), None) == 4
    assert store.write(some_bars(spark, "2025-08-04", 2.0).limit(2)) == 2
    got = store.read("NSE", "M&M", "15m").collect()
    assert [r.close for r in got[:4]].count(2.0) == 2 and len(got) == 8
    assert [r.ts for r in got] == sorted(r.ts for r in got)
    ranged = store.read("NSE", "M&M", "15m", "2025-09-01", "2025-09-30")
    assert ranged.count() == 4
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ym" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.symbols("NSE") == ["M&M"] and store.timeframes("NSE", "M&M") == ["15m"] and store.coverage().first().n == 8
    assert store.write(some_bars(spark, "2025-08-04").limit(0)) == 0


def test_replay_faults_and_guard(spark, tmp_path):
    bars = some_bars(spark, "2025-08-04", symbol="A")
    t = replay.ticks_from_bars(bars).orderBy("seq").collect()
    assert [r.volume_traded_today for r in t] == [11, 23, 36, 50] and t[0].bids[0].price == 0.95 and t[0].asks[4].quantity == 500
    assert replay.ticks_from_bars(bars, drop_after=2).count() == 2
    assert replay.ticks_from_bars(bars, duplicate_every=2).count() == 6
    swapped = replay.ticks_from_bars(bars, swap_at=2).orderBy("seq").collect()
    assert swapped[1].ts > swapped[2].ts
    with pytest.raises(replay.ReadOnlyError):
        replay.read_only(type("Bad", (), {"place_order": lambda self: None}))
    with pytest.raises(KeyError):
        replay.source("nothing")
    bars.write.parquet(f"{tmp_path}/NSE_A_15m.parquet")
    assert replay.source("replay", spark, str(tmp_path)).candles("NSE", "A", "15m").count() == 4
    assert replay.source("replay", spark, str(tmp_path)).candles("NSE", "B", "15m").count() == 0


def test_csv_times_are_utc(spark, tmp_path):
    (tmp_path / "NSE_A_15m.csv").write_text("ts,open,high,low,close,volume\n2025-08-04 03:45:00,1,1,1,1,5\n2025-08-04T09:30:00+05:30,1,1,1,1,5\n2025-08-04 09:45:00+0530,1,1,1,1,5\n2025-08-04T04:30:00Z,1,1,1,1,5\n")
    rows = replay.source("replay", spark, str(tmp_path))
    assert [r.s for r in rows.candles("NSE", "A", "15m").selectExpr("unix_seconds(ts) AS s").orderBy("s").collect()] == [1754279100 + 900 * k for k in range(4)]
    (tmp_path / "NSE_M_M_1d.csv").write_text("ts\n")
    assert [tuple(r)[:4] for r in rows.instruments().orderBy("token").collect()] == [("A", "NSE", "equity", 1), ("M_M", "NSE", "equity", 2)]


def test_subscriptions(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "instrument_key string")
    both = vendor.subscribe(keys("a", "b"), keys("b", "c", "c"), 3)
    assert sorted(r[0] for r in both.collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        vendor.subscribe(both, keys("d"), 3)
    assert sorted(r[0] for r in vendor.unsubscribe(both, keys("a", "x")).collect()) == ["b", "c"]


def _run(spark, tmp_path, days, ticks, timeframes, name, **options):
    """ticks (seq first) go through the stream one file, and so one batch, each list."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key string, t string, seq long, price double, qty long, cum long, oi long, attach boolean"
    for i, part in enumerate(ticks):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        stamp = time.time() - 1000 + i
        for f in glob.glob(f"{tmp_path}/in/{i:03d}/*.parquet"):
            os.utime(f, (stamp, stamp))
    plain = spark.read.parquet(f"{tmp_path}/in/*")
    stream = candles.candle_stream(spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), days, timeframes, **options)
    return plain, stream


def test_one_batch_a_tick_over_days(spark, tmp_path):
    days = cal.calendar_days(spark, "2025-08-01", "2025-08-31")
    at = [("04 15:20:00", 100.0, 10), ("05 09:15:10", 101.0, 20), ("05 09:16:00", 105.0, 30), ("05 09:17:00", 99.0, 45), ("05 10:20:00", 98.0, 60), ("06 09:40:00", 97.0, 5), ("06 09:55:00", 96.0, 9), ("07 17:00:00", 1.0, 9)]
    ticks = [[("A", f"2025-08-{t}", n, p, 5, c, 7 * n, False)] for n, (t, p, c) in enumerate(at)]
    plain, stream = _run(spark, tmp_path, days, ticks, ["15m", "1h"], "daily")
    store = BarStore(spark, f"{tmp_path}/bars")
    candles.store_candles(stream, store, "NSE", f"{tmp_path}/ck").awaitTermination(400)
    for frame in ("15m", "1h"):
        want = ops.bars_from_ticks(cal.with_calendar(plain.drop("attach"), days), frame)
        want = sorted(tuple(r) for r in want.select(cal.at_second(F.col("day"), F.col("bar"), "timestamp").alias("ts"), "open", "high", "low", "close", "volume", "open_interest").collect())
        got = [tuple(r) for r in store.read("NSE", "A", frame).select("ts", "open", "high", "low", "close", "volume", "oi").collect()]
        assert got == want


def test_attach_and_peek(spark, tmp_path):
    days = cal.calendar_days(spark, "2025-08-01", "2025-08-31")
    ticks = [[("A", "2025-08-05 09:15:10", 0, 10.0, 5, None, None, False)], [("A", "2025-08-05 09:20:00", 1, None, None, None, None, True), ("A", "2025-08-05 09:31:00", 2, 11.0, 5, 500, 3, False)]]
    ticks.append([("A", "2025-08-05 15:25:00", 3, 12.0, 1, 520, None, False)])
    _, stream = _run(spark, tmp_path, days, ticks, "1h", "attach", peek=True)
    stream.writeStream.format("memory").queryName("peeked").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).outputMode("append").start().awaitTermination(240)
    got = [(r.kind, r.bar, r.close, r.volume, r.volume_estimated, r.partial) for r in spark.table("peeked").where("kind <> 'reject'").collect()]
    assert ("open", 33300, 10.0, 5, False, False) in got and ("open", 54900, 12.0, 20, False, True) in got
    assert ("candle", 33300, 11.0, 500, False, False) in got


def test_stream_agrees_with_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    days = cal.calendar_days(spark, "2025-08-01", "2025-08-31")
    rows, n = [], 0
    for day in (4, 5):
        for minute in range(555, 930, 7):
            for key in ("A", "B"):
                n += 1
                at = minute - (20 if n % 11 == 0 else 0)
                rows.append((key, f"2025-08-{day:02d} {at // 60:02d}:{at % 60:02d}:00", n, 100.0 + (n * 37 % 50), 5, None if n % 5 == 0 else n * 10))
    rows.append(("A", "2025-08-06 17:00:00", n + 1, 1.0, 1, None))
    rows.append(("B", "2025-08-06 17:00:00", n + 2, 1.0, 1, None))
    t = spark.createDataFrame(rows, "key string, t string, seq long, price double, qty long, cum long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    for i, part in enumerate((t.where("seq <= 60"), t.where("seq > 60 and seq <= 150"), t.where("seq > 150"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = candles.candle_stream(stream, days, "15m").writeStream.format("memory").queryName("candles").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(240)
    columns = ["key", "day", "bar", "open", "high", "low", "close", "volume", "volume_estimated"]
    live = sorted(tuple(r) for r in spark.table("candles").where("kind = 'candle'").select(*columns).collect())
    batch = sorted(tuple(r) for r in ops.bars_from_ticks(cal.with_calendar(t, days), "15m").select(*columns).collect())
    assert live == batch
    reasons = {r.reason: r["count"] for r in spark.table("candles").where("kind = 'reject'").groupBy("reason").count().collect()}
    told = {r.outcome: r.n for r in ops.rejections(ops.judged(cal.with_calendar(t, days), "15m")).collect()}
    assert reasons == {k: v for k, v in told.items() if k != "accepted"}


def test_feed_state(spark):
    rows = [("continuous", True, 1.0, 0.0, 0, "live"), ("continuous", True, 11.0, 0.0, 0, "stale"), ("continuous", True, 30.0, 0.0, 0, "rest_fallback"), ("continuous", False, None, 1.0, 0, "connecting"), ("continuous", False, None, 31.0, 0, "rest_fallback"), ("continuous", False, None, 1.0, 21, "halted"), ("pre_open", False, None, None, 0, "pre_open"), ("closed", True, 1.0, None, 0, "idle")]
    df = spark.createDataFrame(rows, "phase string, connected boolean, age double, gone double, attempts int, want string")
    got = df.select(candles.feed_state(F.col("phase"), F.col("connected"), F.col("age"), F.col("gone"), F.col("attempts")).alias("s"), "want").collect()
    assert all(r.s == r.want for r in got)
