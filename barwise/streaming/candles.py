"""Candles from a tick stream: a stateful processor with the rules of operators.bars, and the health of the stream.

State is one open bar for each key and timeframe in RocksDB. A timer at the session's close emits what is open; the watermark
only bounds state, lateness follows the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barwise.functions import calendar as cal
from barwise.sources.store import BarStore

#: Columns that ticks need; close_ms is the session's close in epoch milliseconds.
INPUT = ["key", "timeframe", "ts", "seq", "price", "qty", "cum", "oi", "day", "bar", "cont_s", "close_ms", "partial", "attach", "has_any_session"]
OUTPUT = (
    "key string, timeframe string, day date, bar int, open double, high double, low double, close double, volume bigint, volume_estimated boolean, open_interest bigint, partial boolean, kind string, reason string"
)
_STATE = "day date, bar int, open double, high double, low double, close double, last_us bigint, printed bigint, last_cum bigint, base bigint, estimated boolean, known bigint, oi bigint, partial boolean, close_ms bigint"
_FIELDS = [f.split(" ")[0] for f in _STATE.split(", ")]


class CandleProcessor(StatefulProcessor):
    """Rows of kind 'candle' (closed bars), 'reject' (with the reason) and, with peek, 'open' (the bar so far, after each batch)."""

    def __init__(self, peek: bool = False):
        self._peek = peek

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("bar", _STATE)

    def _bar(self, key, s: dict, kind: str = "candle") -> Row:
        volume = s["printed"] if s["last_cum"] is None else max(0, s["last_cum"] - s["base"])
        values = {k: s[k] for k in ("day", "bar", "open", "high", "low", "close", "partial")}
        return Row(**_row(key, kind, volume=volume, volume_estimated=s["estimated"], open_interest=s["oi"], **values))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        s = dict(zip(_FIELDS, self._state.get(), strict=True)) if self._state.exists() else None
        for t in sorted(rows, key=lambda r: r.seq):
            if t.attach:
                # whoever attaches in mid-session does not know what was traded before
                if s is not None:
                    s["known"] = None
                continue
            if not t.has_any_session or t.bar is None:
                yield _rejected(key, t, "outside_session" if t.has_any_session else "non_trading_day")
                continue
            us = int(t.ts.astimezone(UTC).timestamp() * 1_000_000)
            if s and s["day"] != t.day:
                if s["bar"] is not None:
                    yield self._bar(key, s)
                # the old day's timer must not close a bar of the new one
                self._handle.deleteTimer(s["close_ms"])
                s = None
            if s and us < s["last_us"]:
                yield _rejected(key, t, "late_tick")
                continue
            if s and s["bar"] is not None and t.bar > s["bar"]:
                yield self._bar(key, s)
                s = {**s, "bar": None, "known": s["last_cum"] if s["last_cum"] is not None else s["known"]}
            if s is None or s["bar"] is None:
                known, at_open = s["known"] if s else None, t.bar == t.cont_s
                base = known if known is not None else 0 if at_open else (t.cum or 0)
                s = {"day": t.day, "bar": t.bar, "open": t.price, "high": t.price, "low": t.price, "close": t.price, "last_us": us, "printed": t.qty or 0, "last_cum": t.cum, "base": base}
                s |= {"estimated": known is None and not at_open and t.cum is not None, "known": base, "oi": t.oi, "partial": t.partial, "close_ms": int(t.close_ms)}
                self._handle.registerTimer(s["close_ms"])
            else:
                s["high"], s["low"], s["close"], s["last_us"] = max(s["high"], t.price), min(s["low"], t.price), t.price, us
                s["oi"] = s["oi"] if t.oi is None else t.oi
                if t.cum is None:
                    s["printed"] += t.qty or 0
                else:
                    s["last_cum"] = t.cum
        if s is not None:
            self._state.update(tuple(s[f] for f in _FIELDS))
            if self._peek and s["bar"] is not None:
                yield self._bar(key, s, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self._state.exists():
            s = dict(zip(_FIELDS, self._state.get(), strict=True))
            if expiredTimerInfo.getExpiryTimeInMs() == s["close_ms"]:
                if s["bar"] is not None:
                    yield self._bar(key, s)
                self._state.clear()

    def close(self) -> None:
        pass


def _row(key, kind: str, **values) -> dict:
    names = [f.split(" ")[0] for f in OUTPUT.split(", ")]
    return dict.fromkeys(names) | {"key": key[0], "timeframe": key[1], "kind": kind} | values


def _rejected(key, t: Row, reason: str) -> Row:
    return Row(**_row(key, "reject", day=t.day, bar=t.bar, close=t.price, reason=reason))


def candle_stream(ticks: DataFrame, calendar: DataFrame, timeframes: str | list[str], delay: str = "1 minute", peek: bool = False) -> DataFrame:
    """A stream of OUTPUT rows from a stream of ticks (key, ts timestamp, seq, price, qty, cum; perhaps oi and attach).

    The stream is read once for all timeframes. A tick with attach true carries no trade: it says that what its key traded
    before in the session is unknown from here on. With peek the unclosed bars come too, as kind 'open'.
    """
    frames = [timeframes] if isinstance(timeframes, str) else timeframes
    rows = cal.with_calendar(ticks.withWatermark("ts", delay), calendar)
    each = [F.struct(F.lit(f).alias("timeframe"), cal.bar_second(f).alias("bar"), F.coalesce(cal.is_partial(cal.bar_second(f), f), F.lit(False)).alias("partial")) for f in frames]
    close = F.unix_millis(cal.at_second(F.col("day"), F.col("cont_e"), "timestamp"))
    rows = rows.withColumn("oi", F.col("oi").cast("long") if "oi" in ticks.columns else F.lit(None).cast("long"))
    rows = rows.withColumn("attach", F.col("attach") if "attach" in ticks.columns else F.lit(False)).withColumn("close_ms", close)
    rows = rows.select("*", F.inline(F.array(*each))).select(*INPUT)
    return rows.groupBy("key", "timeframe").transformWithState(statefulProcessor=CandleProcessor(peek), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def _as_bars(rows: DataFrame, exchange: str) -> DataFrame:
    ts = cal.at_second(F.col("day"), F.col("bar"), "timestamp").alias("ts")
    return rows.select(F.lit(exchange).alias("exchange"), F.col("key").alias("symbol"), "timeframe", ts, "open", "high", "low", "close", "volume", F.col("open_interest").alias("oi"))


def store_candles(stream: DataFrame, store: BarStore, exchange: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the closed bars of candle_stream() to a bar store, a batch at a time; a batch that is repeated changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        store.write(_as_bars(batch.where("kind = 'candle'"), exchange), batch=(checkpoint, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def open_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bars that a stopped candle_stream() query had not closed, as OUTPUT rows of kind 'candle': what a shutdown flushes.

    They are read from the query's own state, so nothing is lost and the query can be started again from where it was.
    """
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "bar").load().select("key.key", "key.timeframe", "value.*").where("bar IS NOT NULL")
    volume = F.when(F.col("last_cum").isNull(), F.col("printed")).otherwise(F.greatest(F.lit(0), F.col("last_cum") - F.col("base")))
    made = {"volume": volume, "volume_estimated": F.col("estimated"), "open_interest": F.col("oi"), "kind": F.lit("candle"), "reason": F.lit(None)}
    pairs = (f.split(" ") for f in OUTPUT.split(", "))
    return held.select(*(made.get(n, F.col(n)).cast(kind).alias(n) for n, kind in pairs))


def flush_to_store(spark: SparkSession, checkpoint: str, store: BarStore, exchange: str) -> int:
    """Stores all open bars of a stopped query; its own later closing of a bar replaces what is stored here."""
    return store.write(_as_bars(open_bars(spark, checkpoint), exchange))


# The state of a live feed as expressions over (phase, connected, data_age_s, disconnected_s, attempts).


def is_stale(age_s: Column, timeout_s: float = 10.0) -> Column:
    return F.coalesce(age_s > timeout_s, F.lit(False))


def wants_rest(age_s: Column, threshold_s: float = 30.0) -> Column:
    return F.coalesce(age_s >= threshold_s, F.lit(False))


def desired_state(phase: Column) -> Column:
    return F.when(phase == "continuous", "live").when(phase == "pre_open", "pre_open").otherwise("idle")


def feed_state(phase: Column, connected: Column, age_s: Column, disconnected_s: Column, attempts: Column, max_attempts: int = 20) -> Column:
    """idle, pre_open, connecting, live, stale, rest_fallback or halted. attempts counts the one being made."""
    return (
        F.when(desired_state(phase) != "live", desired_state(phase))
        .when(attempts > max_attempts, "halted")
        .when(~connected, F.when(wants_rest(disconnected_s), "rest_fallback").otherwise("connecting"))
        .when(wants_rest(age_s), "rest_fallback")
        .when(is_stale(age_s), "stale")
        .otherwise("live")
    )


def health(ticks: DataFrame, keys: list[str], timeout_s: float = 10.0) -> DataFrame:
    """Counts, last values and lags of ticks (keys, ts, seq, price, received_at)."""
    lag = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000
    return ticks.withColumn("_lag", lag).groupBy(*keys).agg(
        F.count("*").alias("ticks"),
        F.max_by("price", "seq").alias("last_price"),
        F.max("ts").alias("last_tick"),
        F.round(F.avg("_lag"), 3).alias("avg_lag_ms"),
        F.max("_lag").alias("max_lag_ms"),
        F.count_if(F.col("_lag") > timeout_s * 1000).alias("stale_ticks"),
    )
