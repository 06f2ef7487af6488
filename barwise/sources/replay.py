"""Replayed market data: bars as ticks with faults, instruments, and the guard against order-like sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.operators.bars import synthetic_ladder
from barwise.schemas import BAR, INSTRUMENT, conform

# Names that a read-only source must not have.
FORBIDDEN = ["^place_", "^modify_", "^cancel_", "^exit_", "^square_off", ".*_order$", "^orders?$", "^place$", "^gtt", "^basket"]


class ReadOnlyError(TypeError):
    """A source offers something that looks like placing orders."""


def read_only(source: type) -> type:
    """The class itself if none of its public names looks like an order; for use as a decorator."""
    bad = [n for n in dir(source) if not n.startswith("__") and any(re.match(p, n) for p in FORBIDDEN)]
    if bad:
        raise ReadOnlyError(f"{source.__name__} offers {', '.join(sorted(bad))}")
    return source


SOURCES: dict[str, type] = {}


def register(name: str):
    """Adds a read-only source class under a name."""

    def add(source: type) -> type:
        SOURCES[name] = read_only(source)
        return source

    return add


def source(name: str, *args, **options):
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[name](*args, **options)


def ticks_from_bars(bars: DataFrame, drop_after: int | None = None, duplicate_every: int | None = None, swap_at: int | None = None, legacy_volume: bool = False) -> DataFrame:
    """Ticks (instrument_key, ts, seq, last_price, volume_traded_today, bids, asks) of bars (exchange, symbol, ts, close, volume).

    Faults by position within an instrument, from 1: nothing after drop_after; each duplicate_every-th twice; the pair that
    begins at swap_at exchanged. The traded volume runs up over the day; with legacy_volume it is the bar's own.
    """
    own = bars.withColumn("instrument_key", F.concat_ws(":", "exchange", "symbol"))
    order = W.partitionBy("instrument_key").orderBy("ts")
    own = own.withColumn("n", F.row_number().over(order))
    day = W.partitionBy("instrument_key", F.to_date("ts")).orderBy("ts")
    traded = F.col("volume") if legacy_volume else F.sum("volume").over(day)
    own = own.withColumn("volume_traded_today", traded.cast("long"))
    if drop_after is not None:
        own = own.where(F.col("n") <= drop_after)
    place = F.col("n")
    if swap_at is not None:
        place = F.when(place == swap_at, swap_at + 1).when(place == swap_at + 1, swap_at).otherwise(place)
    copies = F.when(F.col("n") % duplicate_every == 0, 2).otherwise(1) if duplicate_every else F.lit(1)
    own = own.withColumn("place", place).select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    own = own.withColumn("seq", F.row_number().over(W.partitionBy("instrument_key").orderBy("place", "copy")).cast("long"))
    return own.select("instrument_key", "ts", "seq", F.col("close").alias("last_price"), "volume_traded_today", synthetic_ladder(F.col("close"), -1).alias("bids"), synthetic_ladder(F.col("close"), 1).alias("asks"))


@register("replay")
class Replay:
    """Bars and instruments from files under a folder: <exchange>_<symbol>_<timeframe> as Parquet, else CSV, else nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def candles(self, exchange: str, symbol: str, timeframe: str, start=None, end=None) -> DataFrame:
        name = f"{exchange}_{symbol}_{timeframe}"
        if self._there(f"{name}.parquet"):
            rows = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        elif self._there(f"{name}.csv"):
            rows = self.spark.read.schema("ts string, open double, high double, low double, close double, volume bigint").option("header", True).csv(f"{self.root}/{name}.csv")
            # times without an offset are UTC
            zoned = F.regexp_replace(F.trim("ts"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
            offset = zoned.rlike(r"[0-9]{2}:[0-9]{2}.*(Z|[+-][0-9]{2}:[0-9]{2})$")
            rows = rows.withColumn("ts", F.when(offset, zoned).otherwise(F.concat(zoned, F.lit("Z"))).cast("timestamp"))
        else:
            rows = self.spark.createDataFrame([], BAR)
        rows = conform(rows.withColumns({"exchange": F.lit(exchange), "symbol": F.lit(symbol), "timeframe": F.lit(timeframe)}), BAR)
        for bound, test in ((start, lambda b: F.col("ts") >= b), (end, lambda b: F.col("ts") <= b)):
            if bound is not None:
                rows = rows.where(test(F.lit(bound).cast("timestamp")))
        return rows

    def instruments(self) -> DataFrame:
        """instruments.csv; without it one instrument for each file of bars, tokens numbered in the order of their names."""
        if self._there("instruments.csv"):
            return self.spark.read.schema(INSTRUMENT).option("header", True).csv(f"{self.root}/instruments.csv")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted({m.groups() for f in (fs.listStatus(path) if fs.exists(path) else []) if (m := re.fullmatch(r"([^_]+)_(.+)_[0-9]+[mhd]\.(?:parquet|csv)", f.getPath().getName()))})
        rows = [(symbol, exchange, "equity", n, None, None) for n, (exchange, symbol) in enumerate(names, 1)]
        return self.spark.createDataFrame(rows, INSTRUMENT)
