import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barwise import cli, config
from barwise.sources import feeds, html_tables, vendor
from barwise.sources.store import BarStore


def test_payloads(spark):
    raw = [
        {"instrument_token": 1, "exchange_timestamp": "2025-08-04 09:16:00", "last_price": 5.5, "volume_traded": 10, "depth": {"buy": [{"price": 5.4, "quantity": 3}], "sell": []}},
        {"instrument_token": 9, "last_price": 1.0},
        {"instrument_token": 1, "last_price": 6.0},
    ]
    rows = spark.createDataFrame([(json.dumps(x), i, dt.datetime(2025, 8, 4, 10)) for i, x in enumerate(raw)], "payload string, seq long, received_at timestamp")
    known = spark.createDataFrame([(1, "NSE", "A")], "token long, exchange string, symbol string")
    got = vendor.ticks_from_payload(rows, known).orderBy("seq").collect()
    assert [r.instrument_key for r in got] == ["NSE:A"] * 2
    assert got[0].ts == dt.datetime(2025, 8, 4, 9, 16) and got[1].ts == dt.datetime(2025, 8, 4, 10)
    assert got[0].bids[0].orders == 0 and got[0].asks == [] and got[1].bids == []
    master = spark.createDataFrame([(1, "A", "NSE", "EQ", "NSE", "", 0, 0.05), (2, "I", "NSE", "EQ", "INDICES", "x", 1, 0.0), (3, "O", "NFO", "CE", "NFO-OPT", "y", 50, 0.05)], "instrument_token long, tradingsymbol string, exchange string, instrument_type string, segment string, name string, lot_size int, tick_size double")
    assert [(r.kind, r.lot_size, r.tick_size) for r in vendor.instruments_from_master(master).orderBy("token").collect()] == [("equity", None, 0.05), ("index", 1, None), ("option", 50, 0.05)]


def test_fetch_isolates_failures(spark):
    plan = spark.createDataFrame([(i, "NSE", "A", "1d", dt.date(2025, 8, 4 + i), dt.date(2025, 8, 4 + i)) for i in range(3)], "chunk int, exchange string, symbol string, timeframe string, first_day date, last_day date")

    def client(request):
        if request["chunk"] == 1:
            raise RuntimeError("down")
        return [{"ts": f"{request['first_day']} 09:15:00", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5}]

    log = {r.chunk: r for r in vendor.ingest_log(vendor.fetch(plan, client, per_second=1000)).collect()}
    assert [log[i].rows for i in range(3)] == [1, 0, 1] and log[1].error == "RuntimeError: down" and log[0].error is None


def test_rate_limiter():
    now, slept = [0.0], []
    limiter = feeds.RateLimiter(2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limiter.acquire()
    assert slept == [0.5, 0.5]


def test_symbols(spark):
    html = "<table><tr><th>x</th></tr></table><table><tr><th>Name</th><th>Symbol</th></tr><tr><td>a</td><td><a>AB</a></td></tr><tr><td>b</td><td>C.BO</td></tr></table>"
    got = html_tables.symbols_from_tables(spark.createDataFrame([(1, html), (2, "<p>none")], "page_id long, html string")).collect()
    assert sorted((r.page_id, r.ticker) for r in got) == [(1, "AB.NS"), (1, "C.BO")]


def test_config():
    assert config.from_mapping({"base_timeframe": "1h", "store": {"root": "x"}}).store.root == "x"
    for bad in ({"zone": 1}, {"time_zone": "UTC"}, {"base_timeframe": "2h"}, {"store": {"nope": 1}}):
        with pytest.raises(config.ConfigError):
            config.from_mapping(bad)


def test_cli(spark, tmp_path):
    assert cli.main(["bars", "--store", f"{tmp_path}/s", "--start", "2025-08-04", "--end", "2025-08-08", "--symbol", "S0"], spark) == 2
    rows = [("NSE", f"S{i}", "1d", f"2025-08-{d:02d} 09:15:00", 1.0, 1.0, 1.0, 1.0, 1, None) for i in range(6) for d in (4, 5, 7, 8)]
    bars = spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, t string, open double, high double, low double, close double, volume long, oi long").withColumn("ts", F.col("t").cast("timestamp"))
    BarStore(spark, f"{tmp_path}/s").write(bars)
    window = ["--store", f"{tmp_path}/s", "--start", "2025-08-04", "--end", "2025-08-08"]
    assert cli.main(["bars", *window, "--symbol", "S0"], spark) == 1
    assert cli.main(["calendar", *window], spark) == 1
    assert cli.main(["bars", "--store", f"{tmp_path}/s", "--start", "2025-08-07", "--end", "2025-08-08", "--symbol", "S0"], spark) == 0
    lines = [("Sales", 10, 40, 0), ("100", 100, 130, 0), ("Fees", 10, 40, 20), ("50", 105, 130, 20), ("Total", 10, 40, 40), ("160", 100, 130, 40)]
    words = spark.createDataFrame([(1, 0, t, float(a), float(b), float(y), float(y + 10)) for t, a, b, y in lines], "doc_id long, page_index int, text string, x0 double, x1 double, top double, bottom double")
    words.write.parquet(f"{tmp_path}/w")
    assert cli.main(["statements", f"{tmp_path}/w", "--json", f"{tmp_path}/j", "--marks", f"{tmp_path}/m"], spark) == 1
    assert spark.read.parquet(f"{tmp_path}/m").where("mark = 'error'").count() == 1
