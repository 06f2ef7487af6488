import threading

import pytest
from pyspark.sql import functions as F

from barwise.sources.store import BarStore, ConflictError


def bars(spark, close, *days, symbol="A"):
    rows = [("NSE", symbol, "1d", f"{d} 09:15:00", float(close), float(close), float(close), float(close), 1, None) for d in days]
    names = "exchange string, symbol string, timeframe string, t string, open double, high double, low double, close double, volume long, oi long"
    return spark.createDataFrame(rows, names).withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def closes(store, symbol="A"):
    return [r.close for r in store.read("NSE", symbol, "1d").collect()]


def test_a_writer_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    store = BarStore(spark, str(tmp_path))
    store.write(bars(spark, 1, "2025-08-04", "2025-09-04"))

    def dies(self, number, lines):
        raise OSError("gone between two months")

    with monkeypatch.context() as m:
        m.setattr(BarStore, "_commit", dies)
        with pytest.raises(OSError):
            store.write(bars(spark, 2, "2025-08-04", "2025-09-04"))
    assert closes(store) == [1.0, 1.0]
    assert store.write(bars(spark, 3, "2025-09-04")) == 1
    assert closes(store) == [1.0, 3.0]


def test_two_writers_of_one_month_lose_no_row(spark, tmp_path, monkeypatch):
    one, two = BarStore(spark, str(tmp_path)), BarStore(spark, str(tmp_path))
    one.write(bars(spark, 1, "2025-08-04"))
    plain, once = BarStore._commit, []

    def late(self, number, lines):
        if self is one and not once:
            once.append(number)
            assert two.write(bars(spark, 5, "2025-08-05")) == 1
        return plain(self, number, lines)

    monkeypatch.setattr(BarStore, "_commit", late)
    assert one.write(bars(spark, 7, "2025-08-06")) == 1
    assert once == [2] and closes(one) == [1.0, 5.0, 7.0] and one._latest() == 3


def test_a_number_is_taken_once(spark, tmp_path, monkeypatch):
    store = BarStore(spark, str(tmp_path))
    store.write(bars(spark, 1, "2025-08-04"))
    line = {"commit": 2, "version": "x", "exchange": "NSE", "symbol_key": "A", "timeframe": "1d", "ym": None, "writer": None, "batch": None}
    took = []
    threads = [threading.Thread(target=lambda: took.append(store._commit(2, [line]))) for _ in range(1)]
    for t in threads:
        t.start()
        t.join()
    assert took == [True] and store._commit(2, [line]) is False
    monkeypatch.setattr(BarStore, "_commit", lambda *a: False)
    with pytest.raises(ConflictError):
        store.write(bars(spark, 2, "2025-08-05"))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    assert store.write(bars(spark, 1, "2025-08-04"), batch=("stream", 0)) == 1
    assert store.write(bars(spark, 2, "2025-08-04"), batch=("stream", 1)) == 1
    assert store.write(bars(spark, 9, "2025-08-04"), batch=("stream", 1)) == 0
    assert store.write(bars(spark, 9, "2025-08-04"), batch=("stream", 0)) == 0
    assert closes(store) == [2.0]
    assert store.write(bars(spark, 4, "2025-08-05"), batch=("other", 0)) == 1


def test_old_months_go_with_vacuum(spark, tmp_path):
    store = BarStore(spark, str(tmp_path))
    for n in range(4):
        store.write(bars(spark, n, "2025-08-04"))
    store.write(bars(spark, 8, "2025-09-04", symbol="B"))
    assert store.vacuum(keep=10) == 0 and store.vacuum(keep=0) == 3
    assert closes(store) == [3.0] and closes(store, "B") == [8.0] and store.vacuum(keep=0) == 0
    assert store.symbols("NSE") == ["A", "B"] and store._table(1).count() == 0
