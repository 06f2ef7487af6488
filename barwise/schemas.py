"""Schemas of the tables, and the check that a table has its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table lacks a column or has one of another type."""


_KINDS = {"string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType()}


def fields(text: str, **more: T.DataType) -> T.StructType:
    """A schema from 'name type' pairs; usable before there is a session. more names types that are not plain."""
    pairs = (x.split() for x in text.split(","))
    return T.StructType([T.StructField(n, more[n] if n in more else _KINDS[k]) for n, k in pairs])


LADDER = T.ArrayType(fields("price double, quantity bigint, orders int"))
BAR = fields("exchange string, symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume bigint, oi bigint")
TICK = fields(
    "instrument_key string, ts timestamp, seq bigint, last_price double, last_quantity bigint, volume_traded_today bigint, average_traded_price double, total_buy_quantity bigint, "
    "total_sell_quantity bigint, open_interest bigint, bids ladder, asks ladder, received_at timestamp",
    bids=LADDER,
    asks=LADDER,
)
ACTION = fields("symbol string, ex_date date, action_type string, ratio_new double, ratio_old double, value_per_share_inr double, rights_issue_price_inr double, price_factor_override double, note string, source string")
HOLIDAY = fields("date date, name string, confidence string, source string")
SPECIAL = fields("date date, label string, continuous_start string, continuous_end string, pre_open_start string, pre_open_end string, post_close_start string, post_close_end string, tradeable string, source string")
INSTRUMENT = fields("symbol string, exchange string, kind string, token bigint, lot_size int, tick_size double")
WORD = fields("doc_id bigint, page_index int, text string, x0 double, x1 double, top double, bottom double")

#: Seconds of a bar; a daily bar has none.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": None}


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_zoned(df: DataFrame, column: str = "ts") -> DataFrame:
    """Bars and ticks carry instants; wall-clock timestamps are refused."""
    if not isinstance(df.schema[column].dataType, T.TimestampType):
        raise ContractError(f"{column} must be a timestamp with time zone, not {df.schema[column].dataType.simpleString()}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order and types; other columns go, absent nullable ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
