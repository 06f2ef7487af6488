import glob
import os
import time

from pyspark.sql import functions as F

from barwise.functions import calendar as cal
from barwise.sources.store import BarStore
from barwise.streaming import candles, feed

T = feed.FeedTimes(stale_s=10, rest_s=30, initial_s=1, multiplier=2, maximum_s=5, max_attempts=4)


def test_state_follows_events_and_silence():
    s = feed.moved(dict(feed._NEW), "phase", "pre_open", 0, T)
    assert feed.state_of(s, 0, T) == "pre_open" and feed.due(s, 0, T) is None
    s = feed.moved(s, "phase", "continuous", 1000, T)
    assert feed.state_of(s, 1000, T) == "connecting" and s["retry_ms"] == 1000
    s = feed.moved(s, "connected", None, 2000, T)
    assert [feed.state_of(s, 2000 + k, T) for k in (0, 10_000, 10_001, 29_999, 30_000)] == ["live", "live", "stale", "stale", "rest_fallback"]
    assert feed.due(s, 2000, T) == 12_001 and feed.due(s, 12_001, T) == 32_000 and feed.due(s, 32_000, T) is None
    s = feed.moved(s, "tick", None, 40_000, T)
    assert feed.state_of(s, 40_000, T) == "live"
    s = feed.moved(s, "closed", None, 41_000, T)
    waits = []
    for k in range(4):
        now = 50_000 + 10_000 * k
        s = feed.moved(s, "failed", None, now, T)
        waits.append((s["retry_ms"] - now) / 1000)
    assert waits == [1, 2, 4, 5] and feed.state_of(s, 90_000, T) == "halted" and s["since_ms"] == 41_000
    s = feed.moved(s, "phase", "post_close", 99_000, T)
    assert feed.state_of(s, 99_000, T) == "idle" and s["attempts"] == 0


def _files(spark, path, n, rows):
    spark.createDataFrame(rows, "feed string, seq long, kind string, phase string").coalesce(1).write.parquet(f"{path}/{n:03d}")
    for f in glob.glob(f"{path}/{n:03d}/*.parquet"):
        os.utime(f, (time.time() - 1000 + n,) * 2)


def test_timers_alone_move_the_state(spark, tmp_path):
    """After the last event of each feed nothing arrives any more: stale, fallback, reconnections and halt come by timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    times = feed.FeedTimes(stale_s=2, rest_s=15, initial_s=0.5, multiplier=2, maximum_s=60, max_attempts=2)
    _files(spark, f"{tmp_path}/in", 0, [("a", 1, "phase", "continuous"), ("a", 2, "connected", None), ("a", 3, "tick", None), ("b", 1, "phase", "continuous"), ("b", 2, "failed", None), ("c", 1, "phase", "pre_open")])
    stream = spark.readStream.schema("feed string, seq long, kind string, phase string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = feed.feed_states(stream, times).writeStream.format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(processingTime="200 milliseconds").start()

    def told(name):
        return [(r.state, r.action) for r in spark.table("states").where(F.col("feed") == name).orderBy("at_ms", F.col("action").desc_nulls_first()).collect()]

    try:
        end = time.time() + 100
        while time.time() < end and len(told("a")) < 3:
            time.sleep(0.5)
        assert [x for x, _ in told("a")] == ["live", "stale", "rest_fallback"]
        assert ("connecting", None) in told("b") and any(x == "connect" for _, x in told("b")) and told("c") == [("pre_open", None)]
        _files(spark, f"{tmp_path}/in", 1, [("b", 3, "failed", None), ("a", 4, "tick", None)])
        end = time.time() + 100
        while time.time() < end and ("halted", None) not in told("b"):
            time.sleep(0.5)
        assert told("b")[-1] == ("halted", None)
    finally:
        q.stop()


def test_flush_of_all_open_bars(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    days = cal.calendar_days(spark, "2025-08-01", "2025-08-31")
    rows = [(k, f"2025-08-05 {t}", n, p, 5, c) for n, (k, t, p, c) in enumerate([("A", "09:20:00", 10.0, 100), ("A", "09:21:00", 12.0, 150), ("B", "10:01:00", 7.0, None), ("A", "09:31:00", 11.0, 160)])]
    ticks = spark.createDataFrame(rows, "key string, t string, seq long, price double, qty long, cum long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = candles.candle_stream(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"), days, ["15m", "1h"])
    store = BarStore(spark, f"{tmp_path}/bars")
    candles.store_candles(stream, store, "NSE", f"{tmp_path}/ck").awaitTermination(240)
    assert store.read("NSE", "A", "15m").count() == 1
    assert candles.flush_to_store(spark, f"{tmp_path}/ck", store, "NSE") == 4
    got = {(s, f): [(r.open, r.high, r.close, r.volume) for r in store.read("NSE", s, f).collect()] for s in "AB" for f in ("15m", "1h")}
    assert got == {("A", "15m"): [(10.0, 12.0, 12.0, 150), (11.0, 11.0, 11.0, 10)], ("A", "1h"): [(10.0, 12.0, 11.0, 160)], ("B", "15m"): [(7.0, 7.0, 7.0, 5)], ("B", "1h"): [(7.0, 7.0, 7.0, 5)]}
