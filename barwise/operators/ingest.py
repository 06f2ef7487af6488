"""What to fetch: request chunks within a vendor's span, only where there are trading days, and where to resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that one history request may span, by timeframe.
SPAN_DAYS = {"1m": 60, "5m": 100, "15m": 200, "1h": 400, "1d": 2000}


def chunk_plan(ranges: DataFrame, calendar: DataFrame, cap_days: int, keys: list[str]) -> DataFrame:
    """(keys, chunk, first_day, last_day, sessions) of ranges (keys, start, end): chunks of cap_days, less those without trading days."""
    stride = max(1, cap_days)
    chunks = ranges.select(*keys, "end", F.posexplode(F.sequence("start", "end", F.expr(f"interval {stride} day"))).alias("chunk", "a"))
    chunks = chunks.withColumn("b", F.least(F.date_add("a", stride - 1), F.col("end"))).drop("end")
    days = F.broadcast(calendar.where("is_trading_day").select(F.collect_list("day").alias("days")))
    own = chunks.join(days).withColumn("own", F.filter("days", lambda d: (d >= F.col("a")) & (d <= F.col("b")))).where(F.size("own") > 0)
    return own.select(*keys, "chunk", F.array_min("own").alias("first_day"), F.array_max("own").alias("last_day"), F.size("own").alias("sessions"))


#: Days of a year of history.
YEAR_DAYS = 365


def default_start(end: Column, years: int) -> Column:
    """Where a history of so many years begins."""
    return F.date_sub(end, YEAR_DAYS * years)


def resume_points(wanted: DataFrame, stored: DataFrame, keys: list[str], years: int | None = None) -> DataFrame:
    """wanted (keys, start, end) starting no earlier than the last stored day, which is fetched again; stored has (keys, last_ts).

    With years a missing start (or start column) is that long before the end.
    """
    if "start" not in wanted.columns:
        wanted = wanted.withColumn("start", F.lit(None).cast("date"))
    if years is not None:
        wanted = wanted.withColumn("start", F.coalesce("start", default_start(F.col("end"), years)))
    rows = wanted.join(stored.select(*keys, F.to_date("last_ts").alias("_last")), keys, "left")
    return rows.withColumn("start", F.greatest("start", "_last")).drop("_last").where("start <= end")


def cross(instruments: DataFrame, timeframes: DataFrame) -> DataFrame:
    """Each instrument with each timeframe; the timeframes are a handful and ride along as an array."""
    own = F.broadcast(timeframes.select(F.collect_list("timeframe").alias("_t")))
    return instruments.join(own).withColumn("timeframe", F.explode("_t")).drop("_t")


def ingest_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, rows, span and errors of an ingest log (keys, rows, first_ts, last_ts, error)."""
    return log.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.array_sort(F.collect_list("error")).alias("errors"))


def backoff(attempt: Column, initial: float = 1.0, multiplier: float = 2.0, maximum: float = 60.0) -> Column:
    """Seconds before the attempt, without jitter; attempts count from 0."""
    return F.when(attempt < 0, F.raise_error(F.lit("attempt must not be negative"))).otherwise(F.least(F.lit(initial) * F.pow(F.lit(multiplier), attempt), F.lit(maximum)))


def jittered(seconds: Column, fraction: float, uniform: Column) -> Column:
    """Seconds moved by up to the fraction either way, by a uniform value of 0 to 1; never below 0."""
    return F.greatest(F.lit(0.0), seconds * (1 + fraction * (2 * uniform - 1)))
