import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barwise.sources import store as stores
from barwise.sources.store import BarStore


def bars(spark, n, day="2025-08-04", close=1.0):
    rows = spark.range(n).select(F.lit("NSE").alias("exchange"), F.concat(F.lit("S&"), F.col("id")).alias("symbol"), F.lit("1d").alias("timeframe"), F.lit(f"{day} 09:15:00").cast("timestamp").alias("ts"))
    return rows.select("*", *(F.lit(close).alias(c) for c in ("open", "high", "low", "close")), F.lit(1).cast("long").alias("volume"))


def files(root):
    return [str(p.relative_to(root)) for p in Path(root).rglob("*.parquet") if p.is_file()]


def test_files_and_commit_lines_do_not_grow_with_symbols(spark, tmp_path):
    store, n = BarStore(spark, str(tmp_path)), 1000
    assert store.write(bars(spark, n)) == n
    assert len(files(tmp_path)) <= stores.BUCKETS < n
    assert len(next(tmp_path.glob("_commits/*.json")).read_text().splitlines()) <= stores.BUCKETS
    assert len(store.symbols("NSE")) == n and store.read("NSE", None, "1d").count() == n


def test_one_symbol_comes_from_its_bucket_and_an_upsert_leaves_its_neighbours(spark, tmp_path):
    store, n = BarStore(spark, str(tmp_path)), 400
    store.write(bars(spark, n))
    store.write(bars(spark, n, "2025-09-04"))
    before = set(files(tmp_path))
    assert store.write(bars(spark, 1, "2025-09-04", 7.0)) == 1
    new = set(files(tmp_path)) - before
    assert len(new) == 1 and "ym=202509" in new.pop()
    one = store.read("NSE", "S&0", "1d")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [(r.symbol, r.close) for r in one.collect()] == [("S&0", 1.0), ("S&0", 7.0)]
    rows = store.read("NSE", None, "1d").collect()
    assert len(rows) == 2 * n and sum(r.close for r in rows) == 2 * n + 6 and len({(r.symbol, r.ts) for r in rows}) == 2 * n
    assert store.timeframes("NSE", "S&3") == ["1d"] and store.timeframes("NSE", "S_3") == []


def test_a_store_with_a_folder_for_each_symbol_is_refused(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    store.write(bars(spark, 3))
    line = {"commit": 2, "version": "x", "exchange": "NSE", "symbol_key": "A", "timeframe": "1d", "ym": 202508, "writer": None, "batch": None}
    (tmp_path / "_commits" / f"{2:020d}.json").write_text(json.dumps(line))
    with pytest.raises(Exception, match="folder for each symbol"):
        store.read("NSE", None, "1d").collect()
