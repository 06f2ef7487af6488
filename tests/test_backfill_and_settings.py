import datetime as dt
import glob
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barwise import cli, config
from barwise.functions import calendar as cal
from barwise.operators import footing, ingest
from barwise.sources import csv_sink, feeds
from barwise.sources.store import BarStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])
D = dt.date


class Vendor:
    """15-minute bars of every weekday; fails from a day on, if there is one; writes down the days asked for."""

    def __init__(self, log, down_from=None):
        self.log, self.down_from = log, down_from

    def __call__(self, request):
        open(f"{self.log}/{request['symbol']}_{request['first_day']}_{request['last_day']}", "w").close()
        if self.down_from and request["last_day"] >= self.down_from:
            raise ConnectionError("down")
        a, b = (D.fromisoformat(request[k]) for k in ("first_day", "last_day"))
        days = [a + dt.timedelta(i) for i in range((b - a).days + 1) if (a + dt.timedelta(i)).weekday() < 5]
        return [{"ts": f"{d} {9 + (15 + 15 * k) // 60:02d}:{(15 + 15 * k) % 60:02d}:00", "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1} for d in days for k in range(25)]


def test_backfill_stores_and_resumes(spark, tmp_path):
    """A week of 15-minute bars is 125; a second run asks for the last stored day again and for what is missing."""
    log = tmp_path / "log"
    log.mkdir()
    options = ["backfill", "--store", f"{tmp_path}/bars", "--symbols", "A,B", "--timeframes", "15m", "--per-second", "1000"]
    client = lambda **k: ["--client", feeds.packed(Vendor(str(log), **k))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    assert cli.main([*options, *client(), "--start", "2025-08-04", "--end", "2025-08-08", "--csv", f"{tmp_path}/csv"], spark) == 0
    store = BarStore(spark, f"{tmp_path}/bars")
    assert [store.read("NSE", s, "15m").count() for s in "AB"] == [125, 125] and zone == spark.conf.get("spark.sql.session.timeZone")
    assert len(glob.glob(f"{tmp_path}/csv/wave-00000/symbol=A/*.csv")) == 1
    for f in os.listdir(log):
        os.remove(log / f)
    assert cli.main([*options, *client(), "--start", "2025-08-01", "--end", "2025-08-13"], spark) == 0
    assert sorted(os.listdir(log)) == ["A_2025-08-08_2025-08-13", "B_2025-08-08_2025-08-13"]
    assert store.read("NSE", "A", "15m").count() == 125 + 75
    assert cli.main([*options, *client(), "--start", "2025-08-01", "--end", "2025-08-07"], spark) == 0


def test_a_failed_wave_ends_the_run_and_the_next_goes_on(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    options = ["backfill", "--store", f"{tmp_path}/bars", "--symbols", "A", "--timeframes", "15m", "--per-second", "1000", "--start", "2024-01-01", "--end", "2025-08-29", "--wave", "1"]
    assert cli.main([*options, "--client", feeds.packed(Vendor(str(log), "2024-10-01"))], spark) == 1
    store = BarStore(spark, f"{tmp_path}/bars")
    last = store.coverage().first().last_ts
    assert last.date() < D(2024, 10, 1) and len(os.listdir(log)) == 2
    assert cli.main([*options, "--client", feeds.packed(Vendor(str(log)))], spark) == 0
    assert store.coverage().first().last_ts.date() == D(2025, 8, 29)


def test_default_window(spark):
    wanted = spark.createDataFrame([("A", D(2025, 8, 29)), ("B", D(2025, 8, 29)), ("C", D(2025, 1, 1))], "symbol string, end date")
    stored = spark.createDataFrame([("B", dt.datetime(2025, 8, 20, 15)), ("C", dt.datetime(2025, 8, 20, 15))], "symbol string, last_ts timestamp")
    got = {r.symbol: r.start for r in ingest.resume_points(wanted, stored, ["symbol"], 2).collect()}
    assert got == {"A": D(2025, 8, 29) - dt.timedelta(days=730), "B": D(2025, 8, 20)}


def test_settings_from_file_and_environment(tmp_path):
    (tmp_path / "c.json").write_text('{"history_years": 3, "store": {"root": "from file"}}')
    env = {"BARWISE_CONFIG": str(tmp_path / "c.json"), "BARWISE_STORE__ROOT": "from env", "BARWISE_INTEGRITY__MAX_MISSING": "0.5", "BARWISE_ADJUST_DIVIDENDS": "false", "OTHER": "x"}
    got = config.load(environ=env)
    assert (got.history_years, got.store.root, got.integrity.max_missing, got.adjust_dividends) == (3, "from env", 0.5, False)
    assert config.load(environ={}).history_years == 7 and config.load(tmp_path / "c.json", {}).store.root == "from file"
    for bad in ({"BARWISE_NOTHING": "1"}, {"BARWISE_HISTORY_YEARS__X": "1", "BARWISE_HISTORY_YEARS": "2"}, {"BARWISE_TIME_ZONE": "UTC"}):
        with pytest.raises(config.ConfigError):
            config.load(environ=bad)


def test_csv_of_each_key(spark, tmp_path):
    rows = spark.createDataFrame([("A", 2, None), ("A", 1, "x"), ("B", 3, "y,z")], "symbol string, n int, t string")
    csv_sink.write_csv(rows, f"{tmp_path}/by", ["symbol"], ["n"])
    (path,) = glob.glob(f"{tmp_path}/by/symbol=A/*.csv")
    assert open(path).read().split() == ["n,t", "1,x", "2,"]
    csv_sink.write_csv(rows, f"{tmp_path}/all", order=["n"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/all").count() == 3


def test_grid_from_midnight(spark):
    days = cal.calendar_days(spark, "2025-08-04", "2025-08-04")
    bars = lambda t, a: [r.bar for r in cal.bar_grid(days, t, anchor=a).orderBy("bar").collect()]
    assert bars("1h", "midnight") == [3600 * h for h in range(10, 16)] and bars("1h", "open")[0] == 33300
    assert bars("15m", "midnight") == bars("15m", "open") and bars("1d", "midnight") == [33300]
    with pytest.raises(ValueError):
        cal.bar_grid(days, "1h", anchor="noon")


def test_expiry_and_ages(spark):
    row = spark.sql("SELECT timestamp'2025-08-04 05:59:59' AS a, timestamp'2025-08-04 06:00:00' AS b, timestamp'2025-08-04 06:00:01.5' AS c, CAST(NULL AS timestamp) AS d")
    got = row.select(cal.next_expiry(F.col("a")), cal.next_expiry(F.col("b")), cal.seconds_until(F.col("c"), F.col("b")), cal.seconds_until(F.col("a"), F.col("b")), cal.data_age(F.col("b"), F.col("c")), cal.data_age(F.col("d"), F.col("c"))).first()
    assert got[0] == dt.datetime(2025, 8, 4, 6) and got[1] == dt.datetime(2025, 8, 5, 6) and tuple(got[2:]) == (1.5, 0.0, 1.5, None)


def test_notes_outlines_and_summary(spark):
    cells = [("Sales", 100.0), ("Fees", 50.0), ("Total revenue", 160.0), ("Rent", 7.0), ("Total costs", 9.0)]
    df = spark.createDataFrame([("d1", 1, 0, i, label, v, 10.0, 12.0 * i) for i, (label, v) in enumerate(cells)], "doc_id string, page_index int, column int, row_no int, label string, value double, x0 double, top double")
    checks = footing.analyze(df).cache()
    marks = {int(r.y): (r.mark, r.note, r.outlined) for r in footing.annotations(checks).collect()}
    assert marks[0] == ("component", None, False) and marks[24][0] == "error" and marks[24][1].startswith("Does not add up") and marks[24][2]
    assert marks[48][0] == "unverified" and not marks[48][2] and "could not be told apart" in marks[48][1]
    assert footing.annotations(checks, components=False).count() == 2
    assert [r.text for r in footing.summary_rows(checks).orderBy("line").collect()] == ["Checked 1 totals covering 2 figures.", "1 do not add up, 0 add up, 1 could not be verified.", "1. Page 2: Total revenue - stated 160, sum of figures 150 (off by 10)"]
