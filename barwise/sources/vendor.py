"""What vendors send, as tables: raw ticks, quotes, instruments and history; and fetching planned chunks in parallel.

There is no network here: a source takes a client, which tests replace. Vendor times without zone are the exchange's, which
the session's time zone is.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.schemas import TICK, conform
from barwise.sources import feeds

# A vendor's names of timeframes, and its instrument types.
INTERVALS = {"1m": "minute", "5m": "5minute", "15m": "15minute", "1h": "60minute", "1d": "day"}
KINDS = {"EQ": "equity", "INDICES": "index", "FUT": "future", "CE": "option", "PE": "option"}

_SIDE = "array<struct<price:double,quantity:bigint,orders:int>>"
RAW_TICK = (
    "instrument_token bigint, exchange_timestamp string, last_trade_time string, last_price double, last_traded_quantity bigint, volume_traded bigint, average_traded_price double, "
    f"total_buy_quantity bigint, total_sell_quantity bigint, oi bigint, depth struct<buy:{_SIDE},sell:{_SIDE}>"
)
RAW_QUOTE = f"timestamp string, last_trade_time string, last_price double, last_quantity bigint, volume bigint, average_price double, buy_quantity bigint, sell_quantity bigint, oi bigint, depth struct<buy:{_SIDE},sell:{_SIDE}>"
_TICK_NAMES = {"last_quantity": "last_traded_quantity", "volume_traded_today": "volume_traded", "average_traded_price": "average_traded_price", "total_buy_quantity": "total_buy_quantity", "total_sell_quantity": "total_sell_quantity", "open_interest": "oi"}
_QUOTE_NAMES = {"last_quantity": "last_quantity", "volume_traded_today": "volume", "average_traded_price": "average_price", "total_buy_quantity": "buy_quantity", "total_sell_quantity": "sell_quantity", "open_interest": "oi"}


def _ladder(side: Column) -> Column:
    """A side of the book; no levels if it is missing, no orders if their number is."""
    levels = F.coalesce(side, F.array().cast(_SIDE))
    return F.transform(levels, lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity"), F.coalesce(x["orders"], F.lit(0)).alias("orders")))


def _ticks(rows: DataFrame, names: dict[str, str], stamp: str) -> DataFrame:
    ts = F.coalesce(F.col(f"r.{stamp}").try_cast("timestamp"), F.col("r.last_trade_time").try_cast("timestamp"), F.col("received_at"))
    made = {"ts": ts, "last_price": F.col("r.last_price"), "bids": _ladder(F.col("r.depth.buy")), "asks": _ladder(F.col("r.depth.sell")), **{k: F.col(f"r.{v}") for k, v in names.items()}}
    return conform(rows.withColumns(made).drop("r"), TICK)


def ticks_from_payload(raw: DataFrame, instruments: DataFrame, payload: str = "payload") -> DataFrame:
    """Ticks of raw (payload JSON, seq, received_at); tokens that instruments (token, exchange, symbol) lacks are dropped."""
    rows = raw.withColumn("r", F.from_json(payload, RAW_TICK))
    known = instruments.select(F.col("token").alias("_token"), F.concat_ws(":", "exchange", "symbol").alias("instrument_key"))
    return _ticks(rows.join(known, F.col("r.instrument_token") == F.col("_token")), _TICK_NAMES, "exchange_timestamp")


def ticks_from_quotes(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Ticks of snapshot quotes (instrument_key, payload JSON, seq, received_at)."""
    return _ticks(raw.withColumn("r", F.from_json(payload, RAW_QUOTE)), _QUOTE_NAMES, "timestamp")


def tick_stream(spark: SparkSession, folder: str, instruments: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A stream of ticks from JSON lines that arrive as files (payload a line); unknown tokens are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    raw = lines.select(F.col("value").alias("payload"), F.current_timestamp().alias("received_at"), F.get_json_object("value", "$.seq").cast("long").alias("seq"))
    return ticks_from_payload(raw, instruments)


def feed_ticks(spark: SparkSession, client: Any, instruments: DataFrame, **options: Any) -> DataFrame:
    """A stream of ticks from a feed's client, which a restarted query goes on reading where it had stopped."""
    return ticks_from_payload(feeds.feed(spark, client, **options), instruments)


def polled_ticks(spark: SparkSession, client: Any, **options: Any) -> DataFrame:
    """A stream of ticks from polled quotes: each payload is a quote with its instrument_key beside it."""
    rows = feeds.feed(spark, client, **options)
    return ticks_from_quotes(rows.withColumn("instrument_key", F.get_json_object("payload", "$.instrument_key")))


def with_polls(ticks: DataFrame, quotes: DataFrame) -> DataFrame:
    """Ticks of a feed and of polled quotes (as for ticks_from_quotes) as one table or stream."""
    return ticks.unionByName(ticks_from_quotes(quotes))


def subscribe(held: DataFrame, more: DataFrame, cap: int, key: str = "instrument_key") -> DataFrame:
    """The different keys of both; refused if they are more than cap."""
    both = held.select(key).unionByName(more.select(key)).distinct()
    if (n := both.count()) > cap:
        raise ValueError(f"{n} subscriptions, {cap} at most")
    return both


def unsubscribe(held: DataFrame, gone: DataFrame, key: str = "instrument_key") -> DataFrame:
    return held.select(key).distinct().join(gone, key, "left_anti")


def instruments_from_master(rows: DataFrame) -> DataFrame:
    """Instruments of a vendor's master (instrument_token, tradingsymbol, exchange, instrument_type, segment, name, lot_size, tick_size)."""
    kinds = F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))))
    kind = F.when(F.col("segment").endswith("INDICES"), "index").otherwise(F.coalesce(F.try_element_at(kinds, F.col("instrument_type")), F.lit("equity")))
    return rows.select(
        F.col("tradingsymbol").alias("symbol"), "exchange", kind.alias("kind"), F.col("instrument_token").cast("long").alias("token"), F.nullif("name", F.lit("")).alias("name"),
        F.nullif(F.col("lot_size").cast("int"), F.lit(0)).alias("lot_size"), F.nullif(F.col("tick_size").cast("double"), F.lit(0.0)).alias("tick_size"),
    )


def fetch(plan: DataFrame, client: Callable[[dict], list[dict]], per_second: float = 3.0, quotas: int = 1) -> DataFrame:
    """Bars of the planned chunks (chunk, exchange, symbol, timeframe, first_day, last_day), with the chunk and its error.

    client takes a request, its days as ISO texts, and returns rows (ts, open, high, low, close, volume, oi); the source
    ``barwise_history`` calls it in the tasks, one partition for each quota. A chunk that fails yields one row without ts that
    tells why, and the others go on; one over the vendor's span is refused. A plan is one row a request, which the driver holds.
    """
    spark = plan.sparkSession
    feeds.register(spark)
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")]
    requests = [r.asDict() for r in plan.select(F.col("chunk").cast("int").alias("chunk"), "exchange", "symbol", "timeframe", *days).collect()]
    options = {"client": feeds.packed(client), "plan": json.dumps(requests), "report": "true", "per_second": per_second, "quotas": quotas, "zone": spark.conf.get("spark.sql.session.timeZone")}
    return spark.read.format("barwise_history").options(**options).load()


def ingest_log(fetched: DataFrame) -> DataFrame:
    """(exchange, symbol, timeframe, chunk, rows, first_ts, last_ts, error) of fetched bars, for operators.ingest.ingest_summary()."""
    return fetched.groupBy("exchange", "symbol", "timeframe", "chunk").agg(F.count("ts").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("error").alias("error"))
