import datetime as dt
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barwise.sources import feeds, vendor
from barwise.sources.feeds import Journal, Polls

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # this module is not on the workers' path


class Replay:
    """A vendor's history from a rule; it writes down what it was asked for."""

    def __init__(self, log, fail_first=0):
        self.log, self.fail_first = log, fail_first

    def __call__(self, request):
        name = f"{self.log}/{request['symbol']}-{request['first_day']}-{request['last_day']}"
        n = len([x for x in os.listdir(self.log) if x.startswith(os.path.basename(name))])
        open(f"{name}.{n}", "w").close()
        if n < self.fail_first:
            raise RuntimeError("busy")
        a, b = (dt.date.fromisoformat(request[k]) for k in ("first_day", "last_day"))
        days = [a + dt.timedelta(i) for i in range((b - a).days + 1)]
        return [{"ts": f"{d} 09:15:00", "open": 1, "high": 2.5, "low": 1, "close": d.day, "volume": 7} for d in days if d.weekday() < 5]


def asked(log):
    return sorted({x.rsplit(".", 1)[0] for x in os.listdir(log)})


def test_history_plans_chunks_and_filters_reach_them(spark, tmp_path):
    df = feeds.history(spark, Replay(str(tmp_path)), ["A", "B"], "1m", "2025-08-01", "2025-08-31", chunk_days=10, holidays="2025-08-15", per_second=1000)
    assert df.rdd.getNumPartitions() == 6
    assert df.count() == 2 * 20 + 2 and len(asked(tmp_path)) == 6
    for f in os.listdir(tmp_path):
        os.remove(tmp_path / f)
    own = df.where("symbol = 'B' AND ts >= timestamp'2025-08-12 00:00:00' AND ts < timestamp'2025-08-20 12:00:00'")
    rows = own.orderBy("ts").collect()
    assert [r.close for r in rows] == [12, 13, 14, 15, 18, 19, 20][: len(rows)] and len(rows) == 7
    assert asked(tmp_path) == ["B-2025-08-11-2025-08-20"]


def test_a_chunk_of_no_trading_day_is_not_asked_for(spark, tmp_path):
    df = feeds.history(spark, Replay(str(tmp_path)), ["A"], "1m", "2025-08-08", "2025-08-11", chunk_days=1, per_second=1000)
    assert df.count() == 2 and asked(tmp_path) == ["A-2025-08-08-2025-08-08", "A-2025-08-11-2025-08-11"]
    assert feeds.history(spark, Replay(str(tmp_path)), ["A"], "1m", "2025-08-09", "2025-08-10").count() == 0


def test_a_chunk_over_the_span_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="61 days from"):
        feeds.history(spark, Replay(str(tmp_path)), ["A"], "1m", "2025-08-01", "2025-10-30", chunk_days=61).count()
    plan = spark.createDataFrame([(0, "NSE", "A", "1m", dt.date(2025, 1, 1), dt.date(2025, 3, 5))], "chunk int, exchange string, symbol string, timeframe string, first_day date, last_day date")
    with pytest.raises(Exception, match="64 days from 2025-01-01, 60 at most"):
        vendor.fetch(plan, Replay(str(tmp_path))).count()
    assert asked(tmp_path) == []
    wider = feeds.history(spark, Replay(str(tmp_path)), ["A"], "1m", "2025-08-01", "2025-10-30", chunk_days=91, caps=json.dumps({"1m": 91}))
    assert wider.count() == 65


def test_a_failed_chunk_is_asked_again_or_fails_its_task(spark, tmp_path):
    options = {"client": feeds.packed(Replay(str(tmp_path), 1)), "symbols": "A", "timeframe": "1d", "start": "2025-08-04", "end": "2025-08-08", "per_second": "1000"}
    reader = feeds.HistoryReader(options)
    (part,) = reader.partitions()
    with pytest.raises(RuntimeError, match="busy"):
        list(reader.read(part))
    assert len(list(reader.read(part))) == 5  # as Spark repeats the task
    other = tmp_path / "x"
    other.mkdir()
    again = feeds.HistoryReader(options | {"client": feeds.packed(Replay(str(other), 2)), "attempts": "3"})
    assert len(list(again.read(part))) == 5 and len(os.listdir(other)) == 3


def tick(token, price, cum):
    return json.dumps({"instrument_token": token, "exchange_timestamp": "2025-08-04 09:16:00", "last_price": price, "volume_traded": cum})


def run(df, out, checkpoint):
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_restarted_feed_neither_loses_nor_repeats_a_tick(spark, tmp_path):
    known = spark.createDataFrame([(1, "NSE", "A")], "token long, exchange string, symbol string")
    journal = Journal(f"file://{tmp_path}/feed")
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/cp"
    made = 0
    for n in (25, 0, 7, 40):
        journal.append([("2025-08-04T03:46:00+00:00", tick(1 if i % 5 else 9, float(i), i)) for i in range(made, made + n)])
        made += n
        run(vendor.feed_ticks(spark, journal, known, entries_per_partition=6), out, checkpoint)
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert [r.seq for r in rows] == [i + 1 for i in range(made) if i % 5] and {r.instrument_key for r in rows} == {"NSE:A"}
    assert journal.latest() == made and list(journal.read(24, 27))[0][0] == 25


def test_a_batch_that_was_not_finished_is_read_again(spark, tmp_path):
    """The sink dies in the first batch; after the restart the same entries come once more, and newer ones behind them."""
    journal = Journal(f"file://{tmp_path}/feed")
    journal.append([(None, str(i)) for i in range(5)])
    seen, broken = [], [True]

    def put(batch, number):
        rows = [r.payload for r in batch.orderBy("seq").collect()]
        if broken[0]:
            broken[0] = False
            raise OSError("the sink is gone")
        seen.append((number, rows))

    def once():
        q = feeds.feed(spark, journal).writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="sink is gone"):
        once()
    journal.append([(None, "new")])
    once()
    assert [x for _, rows in seen for x in rows] == ["0", "1", "2", "3", "4", "new"] and seen[0] == (0, ["0", "1", "2", "3", "4"])


def test_polled_quotes_are_kept_before_they_are_told(spark, tmp_path):
    now, calls = [100.0], []

    def quotes():
        calls.append(now[0])
        return [json.dumps({"instrument_key": "NSE:A", "timestamp": "2025-08-04 10:00:00", "last_price": 5.0 + len(calls), "volume": len(calls)})]

    polls = Polls(quotes, Journal(f"file://{tmp_path}/polls"), 5.0, lambda: now[0])
    assert [polls.latest(), polls.latest()] == [1, 1] and calls == [100.0]
    now[0] = 106.0
    assert polls.latest() == 2 and [s for s, _, _ in polls.read(0, 2)] == [1, 2]
    run(vendor.polled_ticks(spark, Journal(f"file://{tmp_path}/polls")), f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [(r.instrument_key, r.last_price, r.volume_traded_today) for r in rows] == [("NSE:A", 6.0, 1), ("NSE:A", 7.0, 2)]
    # a new process over the same journal goes on counting
    assert Polls(quotes, Journal(f"file://{tmp_path}/polls"), 5.0, lambda: now[0]).latest() == 3


def test_folder_stream_with_polls(spark, tmp_path):
    known = spark.createDataFrame([(1, "NSE", "A")], "token long, exchange string, symbol string")
    os.makedirs(f"{tmp_path}/in")
    for i in range(3):
        with open(f"{tmp_path}/in/{i}.json", "w") as f:
            f.write(json.dumps(json.loads(tick(1 if i else 9, float(i), i)) | {"seq": i}))
    os.makedirs(f"{tmp_path}/q")
    with open(f"{tmp_path}/q/0.json", "w") as f:
        f.write(json.dumps({"timestamp": "2025-08-04 10:00:00", "last_price": 8.0, "volume": 3}))
    quotes = spark.readStream.text(f"{tmp_path}/q").select(F.lit("NSE:A").alias("instrument_key"), F.col("value").alias("payload"), F.lit(9).cast("long").alias("seq"), F.current_timestamp().alias("received_at"))
    run(vendor.with_polls(vendor.tick_stream(spark, f"{tmp_path}/in", known), quotes), f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    assert [(r.seq, r.last_price) for r in rows] == [(1, 1.0), (2, 2.0), (9, 8.0)]
