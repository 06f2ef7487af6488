"""Queries over the driver's tables, and the DuckDB SQL they must agree with.

events serve as ticks (key user_id, arrival order event_id, price value, quantity from props), lineitem as statements. The
tables' timestamps have no zone and are read as the exchange's wall clock.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions import calendar as cal
from barwise.functions import numbers as num
from barwise.operators import actions as act
from barwise.operators import bars as ops
from barwise.operators import footing, ingest, integrity, layout
from barwise.sources import feeds, html_tables, replay, vendor
from barwise.sources.store import BarStore
from barwise.streaming import candles

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str, late: bool = False, calendar: bool = True) -> DataFrame:
    """key, ts, seq, price, qty, cum and the calendar's columns; late: in an order of arrival that delays some ticks."""
    e = _read(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"), "event_id")
    day = W.partitionBy("key", F.to_date("ts")).orderBy("event_id")
    rows = e.withColumn("cum", F.sum("qty").over(day))
    if late:
        seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 + (F.col("event_id") * 7919) % 1800
        rows = rows.withColumn("seq", F.row_number().over(W.partitionBy("key").orderBy(seconds, "event_id")))
    rows = rows.drop("event_id")
    return cal.with_calendar(rows, cal.days_of(_read(spark, d, "events"))) if calendar else rows


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of in-session ticks: symbol, day, bar, ts, open..volume."""
    rows = ops.session_bars(ticks(spark, d), "1d")
    return rows.select(F.col("key").alias("symbol"), "day", "bar", cal.at_second(F.col("day"), F.col("bar"), "timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


_HOLIDAYS = ", ".join(f"DATE '{day}'" for day, _ in cal.holiday_list())
_CTE = f"""days AS (SELECT CAST(d AS DATE) AS day, isodow(d) >= 6 AS weekend, CAST(d AS DATE) IN ({_HOLIDAYS}) AS holiday
  FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE)::TIMESTAMP, CAST(max(ts) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events)),
trading AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM days WHERE NOT weekend AND NOT holiday),
e AS (SELECT user_id AS key, ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty, event_id,
  CAST(ts AS DATE) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS s FROM events),
ticks AS (SELECT e.*, sum(qty) OVER (PARTITION BY key, day ORDER BY event_id) AS cum, t.day IS NOT NULL AS open_day FROM e LEFT JOIN trading t USING (day)),
daily AS (SELECT key AS symbol, day, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM ticks WHERE open_day AND s >= 33300 AND s < 55800 GROUP BY ALL)"""
_LATE = f"""{_CTE},
late AS (SELECT * EXCLUDE (seq), row_number() OVER (PARTITION BY key ORDER BY epoch_us(ts) / 1000000.0 + (event_id * 7919) % 1800, event_id) AS seq,
  CASE WHEN open_day AND s >= 33300 AND s < 55800 THEN 33300 + (s - 33300) // 900 * 900 END AS bar FROM ticks),
ins AS (SELECT *, CASE WHEN day IS DISTINCT FROM lag(day) OVER (PARTITION BY key ORDER BY seq) THEN 1 ELSE 0 END AS turn FROM late WHERE bar IS NOT NULL),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY key ORDER BY seq) AS run FROM ins),
told AS (SELECT *, ts < max(ts) OVER (PARTITION BY key, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS is_late FROM runs)"""


@query(f"""WITH {_CTE}
SELECT key AS user_id, day, CAST(33300 + (s - 33300) // 900 * 900 AS INTEGER) AS bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS ticks
FROM ticks WHERE open_day AND s >= 33300 AND s < 55800 GROUP BY ALL""")
def ohlcv_15m_session(spark, d):
    return ops.session_bars(ticks(spark, d), "15m").drop("cont_e").withColumnRenamed("key", "user_id")


@query(f"""WITH {_CTE}, b AS (SELECT key, day, 33300 + (s - 33300) // 3600 * 3600 AS bar, price, seq FROM ticks WHERE open_day AND s >= 33300 AND s < 55800)
SELECT key AS user_id, day, CAST(bar AS INTEGER) AS bar, CAST(least(bar + 3600, 55800) AS INTEGER) AS bar_end, bar + 3600 > 55800 AS partial, arg_min(price, seq) AS open, arg_max(price, seq) AS close, count(*) AS ticks FROM b GROUP BY ALL""")
def ohlcv_1h_ragged_partial(spark, d):
    rows = ops.session_bars(ticks(spark, d), "1h")
    rows = rows.withColumn("cont_s", F.lit(33300))
    return rows.select(F.col("key").alias("user_id"), "day", "bar", cal.bar_end_second(F.col("bar"), "1h").alias("bar_end"), cal.is_partial(F.col("bar"), "1h").alias("partial"), "open", "close", "ticks")


@query(f"""WITH {_LATE},
ok AS (SELECT *, row_number() OVER (PARTITION BY key, run, bar ORDER BY seq) AS rn FROM told WHERE NOT coalesce(is_late, false)),
b AS (SELECT key, run, day, bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, arg_max(cum, seq) AS lc, arg_min(cum, seq) AS fc,
  sum(CASE WHEN rn = 1 OR cum IS NULL THEN coalesce(qty, 0) ELSE 0 END) AS sv, count(*) AS ticks FROM ok GROUP BY ALL),
c AS (SELECT *, last_value(lc IGNORE NULLS) OVER (PARTITION BY key, run ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried,
  first_value(bar) OVER (PARTITION BY key, run ORDER BY bar) AS b0, first_value(fc) OVER (PARTITION BY key, run ORDER BY bar) AS f0 FROM b)
SELECT key AS user_id, CAST(run AS BIGINT) AS run, day, CAST(bar AS INTEGER) AS bar, open, high, low, close,
  CAST(CASE WHEN lc IS NULL THEN sv ELSE greatest(0, lc - coalesce(carried, CASE WHEN b0 = 33300 THEN 0 ELSE coalesce(f0, 0) END)) END AS BIGINT) AS volume,
  bar = b0 AND bar <> 33300 AND fc IS NOT NULL AS volume_estimated, ticks FROM c""")
def tick_fold_late_volume(spark, d):
    rows = ops.bars_from_ticks(ticks(spark, d, late=True), "15m")
    return rows.select(F.col("key").alias("user_id"), "run", "day", "bar", "open", "high", "low", "close", "volume", "volume_estimated", "ticks")


@query(f"""WITH {_LATE}
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT open_day THEN 'non_trading_day' ELSE 'outside_session' END AS outcome FROM late WHERE bar IS NULL
UNION ALL SELECT CASE WHEN coalesce(is_late, false) THEN 'late_tick' ELSE 'accepted' END FROM told) GROUP BY outcome""")
def tick_reject_reasons(spark, d):
    return ops.rejections(ops.judged(ticks(spark, d, late=True), "15m"))


_PHASE = "CASE WHEN NOT open_day THEN 'closed' WHEN s >= 32400 AND s < 33300 THEN 'pre_open' WHEN s >= 33300 AND s < 55800 THEN 'continuous' WHEN s >= 56400 AND s < 57600 THEN 'post_close' ELSE 'closed' END"


@query(f"WITH {_CTE} SELECT {_PHASE} AS phase, count(*) AS n FROM ticks GROUP BY 1")
def session_phase_counts(spark, d):
    return ticks(spark, d).groupBy(cal.phase().alias("phase")).agg(F.count("*").alias("n"))


@query(f"WITH {_CTE} SELECT event_id, CASE WHEN open_day AND s >= 32400 AND s < 57600 THEN day END AS session_date FROM ticks")
def session_date_of_tick(spark, d):
    return ticks(spark, d).select(F.col("seq").alias("event_id"), cal.session_date().alias("session_date"))


@query(f"WITH {_CTE} SELECT t.day, count(e.key) AS ticks FROM trading t LEFT JOIN e USING (day) GROUP BY t.day")
def trading_days_grid(spark, d):
    e = _read(spark, d, "events")
    per_day = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("ticks"))
    return cal.days_of(e).where("is_trading_day").select("day").join(per_day, "day", "left").select("day", F.coalesce("ticks", F.lit(0)).alias("ticks"))


@query(f"""WITH {_CTE}, span AS (SELECT key, min(day) AS a, max(day) AS b FROM e GROUP BY key)
SELECT key AS user_id, 25 * count(t.day) AS expected_bars FROM span LEFT JOIN trading t ON t.day BETWEEN a AND b GROUP BY key""")
def bar_grid_15m(spark, d):
    e = _read(spark, d, "events")
    per_day = F.broadcast(cal.bar_grid(cal.days_of(e), "15m").groupBy("day").agg(F.count("*").alias("bars")).select(F.collect_list(F.struct("day", "bars")).alias("days")))
    span = e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).join(per_day)
    inside = F.filter("days", lambda x: x["day"].between(F.col("a"), F.col("b")))
    return span.select("user_id", F.aggregate(inside, F.lit(0).cast("long"), lambda s, x: s + x["bars"]).alias("expected_bars"))


@query(f"""WITH {_CTE}, k AS (SELECT d.day, NOT d.weekend AND NOT d.holiday AS open, (SELECT count(*) FROM trading t WHERE t.day <= d.day) AS upto FROM days d)
SELECT e.event_id, a.day AS next_day, b.day AS next_3rd, c.day AS previous_day FROM e JOIN k USING (day)
LEFT JOIN trading a ON a.n = upto + 1 LEFT JOIN trading b ON b.n = upto + 3 LEFT JOIN trading c ON c.n = upto - CAST(open AS INTEGER)""")
def nth_trading_day(spark, d):
    e = _read(spark, d, "events")
    days = cal.days_of(e)
    rows = e.select("event_id", F.to_date("ts").alias("day"))
    for n, name in ((1, "next_day"), (3, "next_3rd"), (-1, "previous_day")):
        rows = cal.nth_trading_day(rows, days, n).withColumnRenamed("target", name)
    return rows.drop("day")


@query(f"""WITH {_CTE}, span AS (SELECT key, min(day) AS a, max(day) AS b FROM e GROUP BY key)
SELECT key AS user_id, a AS start, b AS "end", count(t.day) AS sessions FROM span LEFT JOIN trading t ON t.day > a AND t.day <= b GROUP BY ALL""")
def sessions_between(spark, d):
    e = _read(spark, d, "events")
    span = e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    return cal.sessions_between(span, cal.days_of(e)).select("user_id", "start", "end", "sessions")


@query(f"WITH {_CTE} SELECT symbol AS user_id, day + INTERVAL 33300 SECOND AS ts, open, high, low, close, volume FROM daily")
def daily_rollup(spark, d):
    t = ops.session_bars(ticks(spark, d), "15m").withColumn("ts", cal.at_second(F.col("day"), F.col("bar"), "timestamp_ntz")).drop("day")
    days, _ = ops.rollup_to_days(t, ["key"], cal.days_of(_read(spark, d, "events")))
    return days.select(F.col("key").alias("user_id"), "ts", "open", "high", "low", "close", "volume")


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id")
def coverage_by_key(spark, d):
    return ops.coverage(_read(spark, d, "events"), ["user_id"])


@query("SELECT user_id, arg_max(value, event_id) AS last_price, max(ts) AS ts, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_quote(spark, d):
    rows = _read(spark, d, "events").withColumnRenamed("value", "last_price")
    return ops.latest(rows, ["user_id"], F.struct("ts", "event_id"), ["last_price", "ts", "event_type"])


@query(f"""WITH {_CTE} SELECT u.symbol AS user_id, t.day FROM (SELECT DISTINCT symbol FROM daily) u, trading t WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.symbol = u.symbol AND x.day = t.day)""")
def missing_bars(spark, d):
    grid = cal.bar_grid(cal.days_of(_read(spark, d, "events")), "1d")
    return integrity.missing_bars(daily(spark, d), grid, ["symbol"], ["day", "bar"]).select(F.col("symbol").alias("user_id"), "day")


@query(f"""WITH {_CTE} SELECT key AS user_id, day, s // 900 * 900 AS bar, count(*) AS ticks FROM ticks WHERE NOT (open_day AND s >= 33300 AND s < 55800) GROUP BY ALL""")
def unexpected_bars(spark, d):
    grid = cal.bar_grid(cal.days_of(_read(spark, d, "events")), "15m", include_special=True)
    rows = ticks(spark, d, calendar=False).withColumn("day", F.to_date("ts")).withColumn("bar", F.floor(cal.second_of_day(F.col("ts")) / 900).cast("int") * 900)
    bars = rows.groupBy(F.col("key").alias("user_id"), "day", "bar").agg(F.count("*").alias("ticks"))
    return integrity.unexpected_bars(bars, grid, ["day", "bar"]).select("user_id", "day", F.col("bar").cast("long").alias("bar"), "ticks")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return integrity.duplicate_keys(_read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_partkey % 2 DESC, l_shipdate DESC, l_partkey DESC, l_extendedprice DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def upsert_keep_last(spark, d):
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_suppkey")
    stored, incoming = rows.where("l_partkey % 2 = 0").withColumn("version", F.lit(0)), rows.where("l_partkey % 2 <> 0").withColumn("version", F.lit(1))
    order = [F.col(c) for c in ("version", "l_shipdate", "l_partkey", "l_extendedprice", "l_suppkey")]
    return integrity.keep_last(stored.unionByName(incoming), ["l_orderkey", "l_linenumber"], order).drop("l_suppkey", "version")


@query(f"WITH {_LATE} SELECT key AS user_id, CAST(seq AS INTEGER) AS seq, ts, p AS previous_ts FROM (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY seq) AS p FROM late) WHERE ts < p")
def out_of_order_rows(spark, d):
    return integrity.out_of_order(ticks(spark, d, late=True, calendar=False), ["key"]).select(F.col("key").alias("user_id"), "seq", "ts", "previous_ts")


@query(f"""WITH {_CTE}, x AS (SELECT symbol, day, CASE WHEN (symbol + day(day)) % 7 = 0 THEN NULL ELSE open END AS open, CASE WHEN (symbol + day(day)) % 5 = 0 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN (symbol + day(day)) % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE close END AS close, CASE WHEN (symbol + day(day)) % 3 = 0 THEN -volume ELSE volume END AS volume FROM daily),
y AS (SELECT symbol, day, concat_ws(', ', CASE WHEN NOT isnan(high) AND high < low THEN 'high<low' END, CASE WHEN open IS NULL OR NOT (low <= open AND open <= high) THEN 'open outside range' END,
  CASE WHEN isnan(close) OR NOT (low <= close AND close <= high) THEN 'close outside range' END, CASE WHEN volume < 0 THEN 'negative volume' END,
  CASE WHEN coalesce(open <= 0, false) OR high <= 0 OR low <= 0 OR close <= 0 THEN 'non-positive price' END) AS reasons FROM x)
SELECT symbol AS user_id, day, reasons FROM y WHERE reasons <> ''""")
def invalid_ohlc_reasons(spark, d):
    k = F.col("symbol") + F.dayofmonth("day")
    rows = daily(spark, d).withColumns({"open": F.when(k % 7 != 0, F.col("open")), "high": F.when(k % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("close")), "volume": F.when(k % 3 == 0, -F.col("volume")).otherwise(F.col("volume"))})
    return integrity.invalid_bars(rows).select(F.col("symbol").alias("user_id"), "day", "reasons")


@query(f"""WITH {_CTE}, p AS (SELECT symbol, day, lead(day) OVER (PARTITION BY symbol ORDER BY day) AS following FROM daily)
SELECT symbol AS user_id, p.day, following, count(*) AS skipped FROM p JOIN trading t ON t.day > p.day AND t.day < following GROUP BY ALL""")
def session_gaps(spark, d):
    return integrity.session_gaps(daily(spark, d), ["symbol"], cal.days_of(_read(spark, d, "events"))).withColumnRenamed("symbol", "user_id")


_MOVES = "m AS (SELECT symbol, day, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY day) AS r FROM daily WHERE close > 0)"


@query(f"WITH {_CTE}, {_MOVES} SELECT symbol AS user_id, day, round(r, 9) AS log_return FROM m WHERE abs(r) >= 0.2")
def suspected_actions(spark, d):
    return integrity.suspected_actions(daily(spark, d), ["symbol"], 0.2).select(F.col("symbol").alias("user_id"), "day", F.round("log_return", 9).alias("log_return"))


_KNOWN = "known AS (SELECT DISTINCT user_id AS symbol, DATE '2024-01-10' AS day FROM events WHERE user_id % 2 = 0)"


@query(f"WITH {_CTE}, {_MOVES}, {_KNOWN} SELECT symbol AS user_id, day, round(r, 9) AS log_return FROM m ANTI JOIN known USING (symbol, day) WHERE abs(r) >= 1.5")
def suspected_minus_known(spark, d):
    known = _read(spark, d, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("symbol"), F.lit("2024-01-10").cast("date").alias("day")).distinct()
    return integrity.suspected_actions(daily(spark, d), ["symbol"], 1.5, known).select(F.col("symbol").alias("user_id"), "day", F.round("log_return", 9).alias("log_return"))


@query(f"""WITH {_CTE}, part_of AS (SELECT * FROM daily WHERE day(day) % 6 <> 4) SELECT t.day FROM trading t, (SELECT min(day) AS a, max(day) AS b, count(DISTINCT symbol) AS series FROM part_of)
WHERE t.day BETWEEN a AND b AND series >= 5 AND t.day NOT IN (SELECT day FROM part_of)""")
def missing_holidays(spark, d):
    return integrity.missing_holidays(daily(spark, d).where("day(day) % 6 <> 4"), cal.days_of(_read(spark, d, "events")))


@query(f"""WITH {_CTE} SELECT e.day, count(*) AS bars, count(DISTINCT key) AS symbols, false AS is_special FROM e JOIN days USING (day) WHERE holiday AND NOT weekend GROUP BY e.day""")
def phantom_holidays(spark, d):
    e = _read(spark, d, "events")
    rows = e.select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day"))
    return integrity.phantom_holidays(rows, cal.days_of(e)).select("day", "bars", "symbols", "is_special")


def _actions(spark, d) -> DataFrame:
    """Actions of the users: splits, bonuses, demergers and rights issues by the user's number."""
    users = _read(spark, d, "events").select(F.col("user_id").alias("symbol")).distinct()
    kinds = [(3, "2024-01-10", "SPLIT", 2.0, 1.0, None, None), (5, "2024-01-17", "BONUS", 4.0, 3.0, None, None), (4, "2024-01-23", "DEMERGER", None, None, 1.5, None), (7, "2024-01-24", "RIGHTS", 1.0, 4.0, None, 2.0), (9, "2024-01-18", "SPLIT", None, 1.0, None, None)]
    names = ["m", "ex_date", "action_type", "ratio_new", "ratio_old", "value_per_share_inr", "rights_issue_price_inr"]
    rows = F.array(*(F.struct(*(F.lit(v).cast({"m": "int", "ex_date": "date", "action_type": "string"}.get(k, "double")).alias(k) for k, v in zip(names, row, strict=True))) for row in kinds))
    out = users.select("symbol", F.inline(rows)).where("symbol % m = 0").drop("m")
    return out.withColumn("price_factor_override", F.lit(None).cast("double"))


_ACTIONS = f"""a AS (SELECT symbol, CAST(ex AS DATE) AS ex_date, kind, rn, ro, v, issue FROM (SELECT DISTINCT user_id AS symbol FROM events),
  (VALUES (3, '2024-01-10', 'SPLIT', 2.0, 1.0, NULL, NULL), (5, '2024-01-17', 'BONUS', 4.0, 3.0, NULL, NULL), (4, '2024-01-23', 'DEMERGER', NULL, NULL, 1.5, NULL), (7, '2024-01-24', 'RIGHTS', 1.0, 4.0, NULL, 2.0),
   (9, '2024-01-18', 'SPLIT', NULL, 1.0, NULL, NULL)) k(m, ex, kind, rn, ro, v, issue) WHERE symbol % m = 0),
c AS (SELECT a.*, (SELECT arg_max(close, day) FROM daily x WHERE x.symbol = a.symbol AND x.day < a.ex_date) AS cum FROM a),
f AS (SELECT *, CASE WHEN kind IN ('SPLIT', 'BONUS') THEN CAST(ro AS DOUBLE) / rn WHEN cum IS NULL OR cum <= 0 THEN NULL WHEN kind = 'DEMERGER' THEN (cum - v) / cum
  ELSE (CAST(ro AS DOUBLE) * cum + rn * issue) / (ro + rn) / cum END AS pf,
  CASE WHEN kind = 'RIGHTS' THEN (CAST(ro AS DOUBLE) + rn) / ro WHEN kind = 'DEMERGER' THEN 1.0 ELSE CAST(rn AS DOUBLE) / ro END AS vf FROM c)"""


def _factored(spark, d) -> DataFrame:
    return act.with_factors(act.with_cum_close(_actions(spark, d), daily(spark, d)))


@query(f"WITH {_CTE}, {_ACTIONS} SELECT symbol AS user_id, ex_date, kind AS action_type, cum AS cum_close FROM c")
def cum_close_asof(spark, d):
    return act.with_cum_close(_actions(spark, d), daily(spark, d)).select(F.col("symbol").alias("user_id"), "ex_date", "action_type", "cum_close")


@query(f"""WITH {_CTE}, {_ACTIONS} SELECT symbol AS user_id, ex_date, kind AS action_type, round(pf, 9) AS price_factor, round(CASE WHEN pf IS NOT NULL THEN vf END, 9) AS volume_factor,
CASE WHEN pf IS NULL THEN 'skipped' ELSE 'applied' END AS status FROM f""")
def action_factors(spark, d):
    return _factored(spark, d).select(F.col("symbol").alias("user_id"), "ex_date", "action_type", F.round("price_factor", 9).alias("price_factor"), F.round("volume_factor", 9).alias("volume_factor"), "status")


_ADJUSTED = f"""{_CTE}, {_ACTIONS}, g AS (SELECT d.symbol, d.day, any_value(d.open) AS open, any_value(d.close) AS close, any_value(d.volume) AS volume, coalesce(product(pf), 1.0) AS p, coalesce(product(CASE WHEN pf IS NOT NULL THEN vf END), 1.0) AS v
  FROM daily d LEFT JOIN f ON f.symbol = d.symbol AND f.ex_date > d.day GROUP BY d.symbol, d.day)"""


@query(f"WITH {_ADJUSTED} SELECT symbol AS user_id, day, round(p, 9) AS price_factor, round(v, 9) AS volume_factor FROM g")
def adjust_factors(spark, d):
    rows = act.adjust(daily(spark, d), _factored(spark, d))
    return rows.select(F.col("symbol").alias("user_id"), "day", F.round("price_factor", 9).alias("price_factor"), F.round("volume_factor", 9).alias("volume_factor"))


@query(f"WITH {_ADJUSTED} SELECT symbol AS user_id, day, close AS raw_close, round(open * p, 6) AS open, round(close * p, 6) AS close, round(volume * v, 6) AS volume FROM g")
def adjusted_bars(spark, d):
    rows = act.adjust(daily(spark, d), _factored(spark, d))
    return rows.select(F.col("symbol").alias("user_id"), "day", "raw_close", *(F.round(c, 6).alias(c) for c in ("open", "close", "volume")))


@query(f"""WITH {_CTE}, r AS (SELECT symbol, day, open, high, low, close * CASE WHEN symbol % 4 = 0 THEN 1.01 ELSE 1.0001 END AS close, CASE WHEN symbol % 6 = 0 THEN 0 ELSE volume END AS volume FROM daily),
u AS (SELECT l.symbol, l.day, unnest([{{'field': 'open', 'l': l.open, 'r': r.open}}, {{'field': 'high', 'l': l.high, 'r': r.high}}, {{'field': 'low', 'l': l.low, 'r': r.low}}, {{'field': 'close', 'l': l.close, 'r': r.close}},
  {{'field': 'volume', 'l': CAST(l.volume AS DOUBLE), 'r': CAST(r.volume AS DOUBLE)}}], recursive := true) FROM daily l JOIN r USING (symbol, day)),
v AS (SELECT *, CASE WHEN r = 0 THEN CASE WHEN l = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE abs((l - r) / r) END AS err FROM u)
SELECT symbol AS user_id, day, field, round(err, 9) AS relative_error FROM v WHERE err > CASE WHEN field = 'volume' THEN 0.02 ELSE 0.0005 END""")
def reconcile_fields(spark, d):
    live = daily(spark, d)
    rest = live.withColumns({"close": F.col("close") * F.when(F.col("symbol") % 4 == 0, 1.01).otherwise(1.0001), "volume": F.when(F.col("symbol") % 6 == 0, 0).otherwise(F.col("volume"))})
    got = integrity.reconcile(live, rest, ["symbol", "day"])
    return got.select(F.col("symbol").alias("user_id"), "day", "field", F.round("relative_error", 9).alias("relative_error"))


@query(f"""WITH {_CTE}, {_MOVES}, gone AS (SELECT symbol, t.day FROM (SELECT DISTINCT symbol FROM daily) u, trading t WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.symbol = u.symbol AND x.day = t.day)),
x AS (SELECT symbol, 'missing_bars' AS c, CASE WHEN count(*) > 0.02 * (SELECT count(*) FROM trading) THEN 'error' ELSE 'warning' END AS severity, count(*) AS n, count(*) || ' bar(s) missing' AS message, list(DISTINCT day ORDER BY day)[:10] AS places FROM gone GROUP BY symbol
UNION ALL SELECT symbol, 'suspected_unadjusted_action', 'error', count(*), count(*) || ' suspected unadjusted action(s)', list(DISTINCT day ORDER BY day)[:10] FROM m WHERE abs(r) >= 1.5 GROUP BY symbol
UNION ALL SELECT symbol, 'invalid_ohlc', 'error', count(*), count(*) || ' invalid bar(s)', list(DISTINCT day ORDER BY day)[:10] FROM daily WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 GROUP BY symbol)
SELECT symbol AS user_id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'error') = 0 AS is_clean, string_agg(c || '=' || n, ';' ORDER BY c) AS counts,
  string_agg(message, ';' ORDER BY c) AS messages, string_agg(array_to_string(places, ','), ';' ORDER BY c) AS places FROM x GROUP BY symbol""")
def integrity_summary(spark, d):
    days = cal.days_of(_read(spark, d, "events"))
    bars = daily(spark, d).withColumn("seq", F.unix_date("day"))
    found = integrity.check_bars(bars, ["symbol"], cal.bar_grid(days, "1d"), cal.bar_grid(days, "1d", True), days, threshold=1.5)
    each = F.array_sort(F.collect_list(F.struct("check", "n", "message", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))))
    joined = lambda f: F.array_join(F.transform("each", f), ";")
    texts = found.groupBy("symbol").agg(each.alias("each"), *integrity.totals())
    texts = texts.select("symbol", "errors", "warnings", "is_clean", joined(lambda x: F.concat_ws("=", x["check"], x["n"])).alias("counts"), joined(lambda x: x["message"]).alias("messages"), joined(lambda x: x["places"]).alias("places"))
    return texts.withColumnRenamed("symbol", "user_id")


@query("SELECT event_id, user_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-08 09:15:00' AND ts <= TIMESTAMP '2024-01-12 15:30:00'")
def partition_prune_range(spark, d):
    rows = _read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return rows.where(F.col("ts").between(F.lit("2024-01-08 09:15:00").cast("timestamp_ntz"), F.lit("2024-01-12 15:30:00").cast("timestamp_ntz")))


@query("SELECT p_partkey, 'NSE:' || p_brand AS instrument_key, regexp_replace(p_brand || '&' || p_name, '[^A-Za-z0-9._+-]', '_', 'g') AS safe, CASE WHEN p_brand LIKE '%.NS' OR p_brand LIKE '%.BO' THEN p_brand ELSE p_brand || '.NS' END AS ticker FROM part")
def symbol_safe_key(spark, d):
    brand = F.col("p_brand")
    return _read(spark, d, "part").select("p_partkey", F.concat_ws(":", F.lit("NSE"), brand).alias("instrument_key"), num.safe_name(F.concat(brand, F.lit("&"), F.col("p_name"))).alias("safe"), F.when(brand.rlike(r"\.(NS|BO)$"), brand).otherwise(F.concat(brand, F.lit(".NS"))).alias("ticker"))


# Tokens of the documents, and each of the first ten of an order's price written in the ways that statements have.
_FORMS = ["{}", "({})", "-{}", "INR {}", "₹{}", "Rs. {}", "{}%", "–{}", "nil", "$ -{}"]


def _tokens(spark, d) -> DataFrame:
    words = _read(spark, d, "documents").select(F.explode(F.split(F.col("text"), "[ \n]+")).alias("token"))
    price = F.format_number("o_totalprice", 2)
    forms = F.array(*(F.lit(f) for f in _FORMS))
    written = _read(spark, d, "orders").select(F.replace(F.element_at(forms, (F.col("o_orderkey") % len(_FORMS) + 1).cast("int")), F.lit("{}"), price).alias("token"))
    return words.unionByName(written).groupBy("token").agg(F.count("*").alias("n"))


_TOKENS = f"""w AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS token FROM documents
UNION ALL SELECT replace((['{"','".join(_FORMS)}'])[CAST(o_orderkey % {len(_FORMS)} + 1 AS INTEGER)], '{{}}', format('{{:,.2f}}', o_totalprice)) FROM orders) GROUP BY token)"""
_PARSED = """p AS (SELECT token, n, trim(token) AS s FROM w), q AS (SELECT *, starts_with(s, '(') AND ends_with(s, ')') AND length(s) >= 2 AS wrapped FROM p),
r AS (SELECT *, CASE WHEN wrapped THEN trim(s[2:-2]) ELSE s END AS b FROM q),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(b, '(?i)\\b(inr|usd|eur|gbp|aed|jpy|cny|sgd|rs|rmb)\\.?', '', 'g'), '^[₹$€£¥–—−‒ \\t]+|[₹$€£¥–—−‒ \\t]+$', '', 'g'), '^[-+–—−‒ ]+', '') AS bare FROM r),
v AS (SELECT token, n, CASE WHEN s = '' THEN NULL WHEN lower(s) IN ('-', '--', '—', '–', '−', 'nil', 'n/a', 'na') THEN 0.0 WHEN contains(s, '%') THEN NULL
  WHEN regexp_full_match(regexp_replace(replace(bare, ',', ''), '([0-9])[  ]([0-9])', '\\1\\2', 'g'), '[0-9]+(\\.[0-9]+)?')
  THEN CAST(regexp_replace(replace(bare, ',', ''), '([0-9])[  ]([0-9])', '\\1\\2', 'g') AS DOUBLE) * CASE WHEN wrapped OR regexp_matches(b, '^[^0-9]*[-–—−‒][^0-9]*[0-9]') THEN -1 ELSE 1 END END AS value FROM t)"""


@query(f"WITH {_TOKENS}, {_PARSED} SELECT token, n, value FROM v WHERE value IS NOT NULL")
def parse_number_tokens(spark, d):
    return _tokens(spark, d).withColumn("value", num.parse_number(F.col("token"))).where("value is not null")


@query(f"WITH {_TOKENS} SELECT token, n FROM w WHERE regexp_matches(trim(token), '[0-9]') AND regexp_full_match(trim(token), '[()+,.0-9₹$€£¥–—−‒-]+')")
def is_numberish_tokens(spark, d):
    return _tokens(spark, d).where(num.is_numberish(F.col("token")))


@query("SELECT o_orderkey, CASE WHEN v = floor(v) THEN format('{:,}', CAST(v AS BIGINT)) ELSE format('{:,.2f}', v) END AS shown FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS v FROM orders)")
def format_number_amounts(spark, d):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice"))
    return _read(spark, d, "orders").select("o_orderkey", num.format_number(v).alias("shown"))


_LABELS = ["Total ", "Sub-total ", "As at ", "Gross profit ", "Year ended ", "", "Sum  of ", "Net income ", "totally ", "Statement of "]


def _labels(spark, d) -> DataFrame:
    words = F.array(*(F.lit(x) for x in _LABELS))
    own = F.concat(F.element_at(words, (F.col("p_partkey") % len(_LABELS) + 1).cast("int")), F.col("p_name"))
    return _read(spark, d, "part").select("p_partkey", own.alias("label"), (F.col("p_size") + 1985).cast("string").alias("figure"))


_LABEL_SQL = f"l AS (SELECT p_partkey, (['{"','".join(_LABELS)}'])[CAST(p_partkey % {len(_LABELS)} + 1 AS INTEGER)] || p_name AS label, CAST(p_size + 1985 AS VARCHAR) AS figure FROM part)"


@query(f"WITH {_LABEL_SQL} SELECT p_partkey, regexp_matches(label, '{num.HEADER}') OR regexp_matches(figure, '^(19|20)[0-9]{{2}}$') AS is_header FROM l")
def header_row_predicate(spark, d):
    return _labels(spark, d).select("p_partkey", num.is_header(F.col("label"), F.array("figure")).alias("is_header"))


@query(f"WITH {_LABEL_SQL} SELECT p_partkey, regexp_matches(label, '{num.TOTAL}') AS is_total, regexp_matches(label, '{num.DERIVED}') AS is_derived FROM l")
def total_row_predicate(spark, d):
    return _labels(spark, d).select("p_partkey", num.is_total(F.col("label")).alias("is_total"), num.is_derived(F.col("label")).alias("is_derived"))


def _edges(spark, d) -> DataFrame:
    return _read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 400).cast("double").alias("x1"))


_EDGES = """x AS (SELECT l_orderkey, CAST(l_partkey % 400 AS DOUBLE) AS x1 FROM lineitem), g AS (SELECT *, x1 - lag(x1) OVER (PARTITION BY l_orderkey ORDER BY x1) > 18 AS wide FROM x),
c AS (SELECT l_orderkey, x1, sum(CASE WHEN wide THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x1) AS col FROM g),
ed AS (SELECT l_orderkey, col, avg(x1) AS edge FROM c GROUP BY ALL)"""


@query(f'WITH {_EDGES} SELECT l_orderkey, CAST(col AS INTEGER) AS "column", round(edge, 6) AS edge FROM ed')
def column_edges_1d(spark, d):
    return layout.column_edges(_edges(spark, d), ["l_orderkey"]).withColumn("edge", F.round("edge", 6))


@query(f"""WITH {_EDGES}, n AS (SELECT x.l_orderkey, x1, arg_min(col, (round(abs(edge - x1 - 7), 9), col)) AS nearest FROM x JOIN ed USING (l_orderkey) GROUP BY ALL)
SELECT l_orderkey, x1, CAST(nearest AS INTEGER) AS nearest FROM n""")
def nearest_edge(spark, d):
    rows = _edges(spark, d).distinct()
    edges = layout.column_edges(_edges(spark, d), ["l_orderkey"]).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "edge"))), lambda e: F.round(e["edge"], 9)).alias("edges"))
    return rows.join(edges, "l_orderkey").select("l_orderkey", "x1", layout.nearest_edge(F.col("x1") + 7, F.col("edges")).cast("int").alias("nearest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_returnflag <> 'R' AND round_even(y.l_quantity / 4, 0) = round_even(x.l_quantity / 4, 0)) THEN 0
ELSE (SELECT count(DISTINCT round_even(y.l_quantity / 4, 0)) FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_returnflag <> 'R' AND round_even(y.l_quantity / 4, 0) < round_even(x.l_quantity / 4, 0)) END AS indent FROM lineitem x""")
def indent_levels(spark, d):
    rows = _read(spark, d, "lineitem").withColumn("label_x0", F.col("l_quantity") / 4).withColumn("label", F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")))
    return layout.indent_levels(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("indent").cast("long").alias("indent"))


def _statements(spark, d) -> DataFrame:
    """Statements: an order's lines in whole cents, closed by a total that is a cent-and-a-half wrong in some."""
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rint(F.col("l_extendedprice")).alias("value"), "l_partkey", "l_suppkey")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "value")
    items = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("column"), F.row_number().over(order).alias("row_no"), F.lit("Item").alias("label"), "value")
    total = items.groupBy("doc_id", "page_index", "column").agg(F.lit(9999).alias("row_no"), F.lit("Total").alias("label"), (F.sum("value") + F.when(F.col("doc_id") % 5 == 0, 1000.0).otherwise(0.0)).alias("value"))
    return items.unionByName(total).withColumn("x0", F.lit(100.0)).withColumn("top", F.col("row_no") * 12.0)


@query("""WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS amount FROM lineitem),
k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS m FROM i), t AS (SELECT l_orderkey, sum(CASE WHEN row_no > m - (1 + l_orderkey % 4) THEN amount ELSE 0 END) AS target FROM k GROUP BY l_orderkey),
r AS (SELECT l_orderkey, target, sum(amount) OVER w AS running, count(*) OVER w AS depth FROM i JOIN t USING (l_orderkey) WINDOW w AS (PARTITION BY l_orderkey ORDER BY row_no DESC))
SELECT l_orderkey, CAST(min(depth) AS BIGINT) AS depth, CAST(arg_min(running, depth) AS BIGINT) AS total FROM r WHERE running = target AND depth <= 80 GROUP BY l_orderkey""")
def footing_reconcile_static(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = _read(spark, d, "lineitem").withColumn("row_no", F.row_number().over(order)).withColumn("amount", F.rint(F.col("l_extendedprice") * 100).cast("long"))
    items = items.select("l_orderkey", "row_no", "amount", F.count("*").over(W.partitionBy("l_orderkey")).alias("m"))
    goal = F.sum(F.when(F.col("row_no") > F.col("m") - (1 + F.col("l_orderkey") % 4), F.col("amount")).otherwise(0)).over(W.partitionBy("l_orderkey"))
    return footing.reconcile_static(items.withColumn("target", goal), ["l_orderkey"], "row_no")


def _folded(rows: str) -> str:
    """SQL of all checks over r (doc, n, row_no, label, value, total, derived): the table of operators.footing, a row a step."""
    money = lambda x: f"format('{{:,}}', CAST({x} AS BIGINT))"
    near = lambda total, n: f"abs({total} - value) <= 1 + 0.5 * {n} + 1e-9 * abs(value)"
    return f"""WITH RECURSIVE {rows},
w AS (SELECT doc, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS v, CAST([] AS VARCHAR[]) AS labels, CAST([] AS BOOLEAN[]) AS closed, CAST([] AS BOOLEAN[]) AS wall,
  0 AS row_no, '' AS label, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS status, 0.0::DOUBLE AS stated, 0.0::DOUBLE AS expected, 0 AS components, '' AS parts FROM (SELECT DISTINCT doc FROM r)
UNION ALL SELECT doc, n, list_filter(v, lambda x, i: NOT list_contains(pos, i)) || [CASE WHEN total AND k IS NULL AND len(pos) >= 2 THEN list_sum(list_select(v, pos)) ELSE value END],
  list_filter(labels, lambda x, i: NOT list_contains(pos, i)) || [label], list_filter(closed, lambda x, i: NOT list_contains(pos, i)) || [total OR derived OR len(pos) > 0], list_filter(wall, lambda x, i: NOT list_contains(pos, i)) || [derived],
  row_no, label, CASE WHEN total THEN 'total' WHEN len(pos) > 0 THEN 'implicit' END, CASE WHEN total AND k IS NULL THEN CASE WHEN len(pos) >= 2 THEN 'error' ELSE 'unverified' END ELSE 'ok' END,
  value, CASE WHEN len(pos) > 0 THEN list_sum(list_select(v, pos)) ELSE value END, CAST(len(pos) AS INTEGER), array_to_string(list_transform(pos, lambda i: labels[i] || ' (' || {money('v[i]')} || ')'), ' + ')
FROM (SELECT *, CAST(CASE WHEN total AND k IS NOT NULL THEN range(len(v) - k + 1, len(v) + 1) WHEN total AND tail >= 2 THEN range(len(v) - tail + 1, len(v) + 1) WHEN total AND tail = 0 AND len(g) >= 2 THEN g[-2 :]
    WHEN NOT total AND NOT derived AND tail >= 2 AND {near('list_sum(v[-tail :])', 'tail')} THEN range(len(v) - tail + 1, len(v) + 1) ELSE [] END AS BIGINT[]) AS pos
  FROM (SELECT w.doc, r.n, r.row_no, r.label, r.value, total, derived, v, labels, closed, wall, coalesce(nullif(list_position(list_reverse(closed), true), 0) - 1, len(v)) AS tail, list_filter(range(1, len(v) + 1), lambda i: closed[i] AND NOT wall[i]) AS g,
    CASE WHEN total THEN list_filter(range(1, least(len(v), 80, coalesce(nullif(list_position(list_reverse(wall), true), 0), 80)) + 1), lambda q: {near('list_sum(v[-q :])', 'q')})[1] END AS k FROM w JOIN r ON r.doc = w.doc AND r.n = w.n + 1)))
SELECT doc AS doc_id, row_no, label, kind, status, stated, round(expected, 4) AS expected, components,
  CASE status WHEN 'ok' THEN 'Adds up: ' || {money('stated')} || ' = ' || parts WHEN 'unverified' THEN 'Total ' || {money('stated')} || ': its items could not be told apart'
  ELSE 'Does not add up: stated ' || {money('stated')} || ', items give ' || {money('expected')} || ' (off by ' || {money('stated - expected')} || '). Items: ' || parts END AS message
FROM w WHERE kind IS NOT NULL"""


def _checked(cells: DataFrame) -> DataFrame:
    got = footing.analyze(cells)
    return got.select("doc_id", "row_no", "label", "kind", "status", "stated", F.round("expected", 4).alias("expected"), F.size("components").alias("components"), "message")


@query(
    _folded("""i AS (SELECT l_orderkey AS doc, CAST(round_even(l_extendedprice, 0) AS DOUBLE) AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice, 0)) AS n FROM lineitem),
r AS (SELECT doc, n, CAST(n AS INTEGER) AS row_no, 'Item' AS label, value, false AS total, false AS derived FROM i UNION ALL SELECT doc, count(*) + 1, 9999, 'Total', sum(value) + CASE WHEN doc % 5 = 0 THEN 1000.0 ELSE 0.0 END, true, false FROM i GROUP BY doc)""")
)
def footing_fold(spark, d):
    return _checked(_statements(spark, d))


def _ledgers(spark, d) -> DataFrame:
    """A supplier's lines as one long column: subtotals in it without a name, a total after every ten lines and one over four of
    those, derived figures, totals that are off, and for every third supplier totals over more lines than are looked back on."""
    lines = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.rint("l_extendedprice").alias("x"), "l_orderkey", "l_linenumber", "l_partkey")
    order = W.partitionBy("doc_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "x")
    # sums of whole figures: differences of a running sum are exact, and a row costs the same whatever the span
    lines = lines.withColumn("run", F.sum("x").over(order.rowsBetween(W.unboundedPreceding, 0)))
    upto = lambda n: F.coalesce(F.lag("run", n).over(order), F.lit(0.0))
    back = lambda n: upto(1) - upto(n + 1)
    n, long, even = F.col("row_no"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    rows = lines.select("doc_id", "x", F.row_number().over(order).alias("row_no"), *(back(k).alias(f"s{k}") for k in (4, 10, 43, 199)), F.coalesce(F.lag("x", 6).over(order), F.lit(0.0)).alias("x6"))
    off = F.when(n % 44 == 0, 500.0).otherwise(0.0)
    label = F.when(n % 97 == 0, "Net income").when(long, F.when(n % 200 == 0, "Total").otherwise("Item")).when((n % 11 == 0) | ((n > 44) & (n % 44 == 1)), "Total").otherwise("Item")
    value = F.when(n % 97 == 0, F.col("x")).when(long, F.when(n % 200 == 0, F.col("s199")).otherwise(F.col("x"))).when(n % 11 == 0, F.col("s10") - F.when(even, F.col("x6")).otherwise(0.0) + off).when((n > 44) & (n % 44 == 1), F.col("s43")).when(even & (n % 11 == 5), F.col("s4")).otherwise(F.col("x"))
    return rows.select("doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("column"), "row_no", label.alias("label"), value.alias("value"), F.lit(100.0).alias("x0"), (n * 12.0).alias("top"))


@query(
    _folded("""l AS (SELECT l_suppkey AS doc, CAST(round_even(l_extendedprice, 0) AS DOUBLE) AS x, l_orderkey, l_linenumber, l_partkey FROM lineitem),
s AS (SELECT doc, x, row_number() OVER o AS n, coalesce(sum(x) OVER (o ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0) AS s4, coalesce(sum(x) OVER (o ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.0) AS s10, coalesce(sum(x) OVER (o ROWS BETWEEN 43 PRECEDING AND 1 PRECEDING), 0.0) AS s43,
  coalesce(sum(x) OVER (o ROWS BETWEEN 199 PRECEDING AND 1 PRECEDING), 0.0) AS s199, coalesce(lag(x, 6) OVER o, 0.0) AS x6 FROM l WINDOW o AS (PARTITION BY doc ORDER BY l_orderkey, l_linenumber, l_partkey, x)),
t AS (SELECT *, CASE WHEN n % 97 = 0 THEN 'Net income' WHEN doc % 3 = 0 THEN CASE WHEN n % 200 = 0 THEN 'Total' ELSE 'Item' END WHEN n % 11 = 0 OR (n > 44 AND n % 44 = 1) THEN 'Total' ELSE 'Item' END AS label FROM s),
r AS (SELECT doc, n, CAST(n AS INTEGER) AS row_no, label, CASE WHEN n % 97 = 0 THEN x WHEN doc % 3 = 0 THEN CASE WHEN n % 200 = 0 THEN s199 ELSE x END WHEN n % 11 = 0 THEN s10 - CASE WHEN doc % 2 = 0 THEN x6 ELSE 0.0 END + CASE WHEN n % 44 = 0 THEN 500.0 ELSE 0.0 END
  WHEN n > 44 AND n % 44 = 1 THEN s43 WHEN doc % 2 = 0 AND n % 11 = 5 THEN s4 ELSE x END AS value, label = 'Total' AS total, label = 'Net income' AS derived FROM t)""")
)
def footing_ledgers(spark, d):
    return _checked(_ledgers(spark, d))


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS doc, CAST(round_even(l_extendedprice, 0) AS DOUBLE) AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice, 0)) AS n FROM lineitem),
r AS (SELECT doc, n, value, false AS total FROM i UNION ALL SELECT doc, count(*) + 1, sum(value) + CASE WHEN doc % 5 = 0 THEN 1000.0 ELSE 0.0 END, true FROM i GROUP BY doc),
w AS (SELECT doc, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS v, CAST([] AS BOOLEAN[]) AS closed, 0 AS checks, 0 AS figures, 0 AS unverified, 0 AS errors FROM (SELECT DISTINCT doc FROM r)
UNION ALL SELECT doc, n, v[: len(v) - take] || [CASE WHEN total AND k IS NULL AND take >= 2 THEN list_sum(v[-take :]) ELSE value END], closed[: len(v) - take] || [total OR take > 0],
  checks + CAST(total OR take > 0 AS INTEGER), figures + CASE WHEN total AND k IS NULL AND take < 2 THEN 0 ELSE take END, unverified + CAST(total AND k IS NULL AND take < 2 AS INTEGER), errors + CAST(total AND k IS NULL AND take >= 2 AS INTEGER)
FROM (SELECT *, CAST(CASE WHEN total THEN coalesce(k, CASE WHEN tail > 0 THEN tail ELSE least(2, len(v)) END) WHEN tail >= 2 AND abs(list_sum(v[-tail :]) - value) <= 1 + 0.5 * tail + 1e-9 * abs(value) THEN tail ELSE 0 END AS INTEGER) AS take
  FROM (SELECT r.doc, r.n, value, total, v, closed, checks, figures, unverified, errors, coalesce(nullif(list_position(list_reverse(closed), true), 0) - 1, len(v)) AS tail,
    CASE WHEN total THEN list_filter(range(1, least(len(v), 80) + 1), lambda q: abs(list_sum(v[-q :]) - value) <= 1 + 0.5 * q + 1e-9 * abs(value))[1] END AS k FROM w JOIN r ON r.doc = w.doc AND r.n = w.n + 1)))
SELECT doc AS doc_id, checks AS totals_checked, figures AS figures_checked, unverified, errors, errors = 0 AS consistent FROM w QUALIFY n = max(n) OVER (PARTITION BY doc)""")
def footing_report(spark, d):
    return footing.report(footing.column_checks(_statements(spark, d)))


def _checks(spark, d) -> DataFrame:
    """Checks as a page with split columns has them: an order's lines, each in the column of its supplier's parity."""
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("l_suppkey") % 2).cast("int").alias("column"), F.col("l_linenumber").alias("row_no"), F.rint("l_quantity").alias("stated"), F.when(F.col("l_returnflag") == "A", "error").otherwise("ok").alias("status"), F.lit("total").alias("kind"))
    return rows.withColumn("top", F.col("row_no") * 12.0).withColumn("x0", 100.0 + 40 * F.col("column")).distinct()


_CHECKS_SQL = """k AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INTEGER) AS col, l_linenumber AS row_no, round_even(l_quantity, 0) AS stated, CASE WHEN l_returnflag = 'A' THEN 'error' ELSE 'ok' END AS status FROM lineitem)"""


@query(f"""WITH {_CHECKS_SQL} SELECT doc_id, col AS "column", row_no, stated, status FROM k WHERE status = 'ok' OR NOT EXISTS (SELECT 1 FROM k g WHERE g.status = 'ok' AND g.doc_id = k.doc_id AND g.row_no = k.row_no AND g.stated = k.stated)""")
def split_column_suppression(spark, d):
    return footing.without_split_columns(_checks(spark, d)).select("doc_id", "column", "row_no", "stated", "status")


@query(f"""WITH {_CHECKS_SQL} SELECT doc_id, 100.0 + 40 * col AS x, 12.0 * row_no AS y, CASE max(CASE WHEN status = 'error' THEN 3 ELSE 1 END) WHEN 3 THEN 'error' ELSE 'ok' END AS mark FROM k GROUP BY ALL""")
def annotation_priority(spark, d):
    none = F.array().cast("array<struct<row_no:int,label:string,value:double,x0:double,top:double>>")
    return footing.annotations(_checks(spark, d).withColumn("components", none)).select("doc_id", "x", "y", "mark")


@query(f"""WITH {_CTE}, span AS (SELECT key, min(day) AS a, max(day) AS b FROM e GROUP BY key), c AS (SELECT key, b AS last, unnest(range(0, date_diff('day', a, b) // 5 + 1)) AS chunk, a FROM span),
r AS (SELECT key, chunk, a + CAST(5 * chunk AS INTEGER) AS x, least(a + CAST(5 * chunk + 4 AS INTEGER), last) AS y FROM c)
SELECT key AS user_id, CAST(chunk AS INTEGER) AS chunk, min(t.day) AS first_day, max(t.day) AS last_day, CAST(count(*) AS INTEGER) AS sessions FROM r JOIN trading t ON t.day BETWEEN x AND y GROUP BY ALL""")
def ingest_chunk_plan(spark, d):
    e = _read(spark, d, "events")
    span = e.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    return ingest.chunk_plan(span, cal.days_of(e), 5, ["user_id"])


@query("""SELECT event_type, count(*) AS ticks, arg_max(value, event_id) AS last_price, max(ts) AS last_tick, round(avg((event_id * 37) % 20000), 3) AS avg_lag_ms, CAST(max((event_id * 37) % 20000) AS DOUBLE) AS max_lag_ms,
count_if((event_id * 37) % 20000 > 10000) AS stale_ticks FROM events GROUP BY event_type""")
def stream_health(spark, d):
    rows = _read(spark, d, "events").select("event_type", "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("event_id") * 37) % 20000 / 1000).cast("decimal(18,6)")).alias("i"))
    return candles.health(rows.withColumn("received_at", F.col("ts") + F.col("i")), ["event_type"])


@query("""SELECT event_id, CASE WHEN event_id % 24 > 20 THEN 'halted' WHEN event_id % 3 = 0 THEN CASE WHEN (event_id * 7) % 60 >= 30 THEN 'rest_fallback' ELSE 'connecting' END
WHEN (event_id * 7) % 60 >= 30 THEN 'rest_fallback' WHEN (event_id * 7) % 60 > 10 THEN 'stale' ELSE 'live' END AS state, least(pow(2.0, event_id % 8), 60.0) AS backoff_s FROM events""")
def backoff_schedule(spark, d):
    n = F.col("event_id")
    state = candles.feed_state(F.lit("continuous"), n % 3 != 0, ((n * 7) % 60).cast("double"), ((n * 7) % 60).cast("double"), n % 24)
    return _read(spark, d, "events").select("event_id", state.alias("state"), ingest.backoff(n % 8).alias("backoff_s"))


@query("SELECT event_id, round(value - 0.05, 2) AS best_bid, round(value + 0.05, 2) AS best_ask, round(round(value + 0.05, 2) - round(value - 0.05, 2), 6) AS spread FROM (SELECT event_id, round(value, 2) AS value FROM events)")
def depth_ladder_spread(spark, d):
    price = F.round("value", 2)
    rows = _read(spark, d, "events").withColumn("bids", ops.synthetic_ladder(price, -1)).withColumn("asks", ops.synthetic_ladder(price, 1))
    return ops.depth_measures(rows).select("event_id", "best_bid", "best_ask", F.round("spread", 6).alias("spread"))


@query("""SELECT page_id, cell, cell || '.NS' AS ticker FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([A-Za-z]+)">', 1)) AS cell FROM pages)""")
def pages_table_symbols(spark, d):
    cells = _read(spark, d, "pages").select("page_id", F.explode(F.expr("regexp_extract_all(html, '<li><a href=\"/([A-Za-z]+)\">', 1)")).alias("cell"))
    return cells.withColumn("ticker", F.when(F.col("cell").rlike(r"\.(NS|BO)$"), F.col("cell")).otherwise(F.concat("cell", F.lit(".NS"))))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in the session's, or a local one where all are one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-barwise-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {_CTE}, b AS (SELECT key, day + to_seconds(33300 + (s - 33300) // 900 * 900) AS begins, price, seq, qty FROM ticks WHERE open_day AND s >= 33300 AND s < 55800)
SELECT key AS user_id, strftime(begins, '%Y-%m-%d %H:%M:%S') AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume
FROM b WHERE begins >= TIMESTAMP '2024-01-08 09:15:00' AND begins <= TIMESTAMP '2024-01-12 15:15:00' GROUP BY key, begins""")
def store_range_read(spark, d):
    """All 15-minute bars are written to a store, then a range of them is read back."""
    rows = ops.session_bars(ticks(spark, d), "15m").withColumn("ts", cal.at_second(F.col("day"), F.col("bar"), "timestamp"))
    rows = rows.select(F.lit("NSE").alias("exchange"), F.col("key").cast("string").alias("symbol"), F.lit("15m").alias("timeframe"), "ts", "open", "high", "low", "close", "volume")
    bars = BarStore(spark, _scratch(spark, "bars"))
    bars.write(rows)
    got = bars.read("NSE", None, "15m", "2024-01-08 09:15:00", "2024-01-12 15:15:00")
    return got.select(F.col("symbol").cast("long").alias("user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


@query(f"""WITH {_CTE} SELECT symbol AS user_id, strftime(day, '%Y-%m-%d') AS day, open, high, low, close, volume FROM daily WHERE day >= DATE '2024-01-05' AND day < DATE '2024-02-10'""")
def vendor_history(spark, d):
    """All daily bars, stored as a vendor has them, come back through the history source in chunks that a filter on time chooses."""
    days, zone = _read(spark, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")), spark.conf.get("spark.sql.session.timeZone")
    rows = daily(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _scratch(spark, "vendor")
    rows.select("symbol", "ts", "open", "high", "low", "close", "volume").repartition("symbol").write.partitionBy("symbol").parquet(folder)
    first, last = days.first()
    symbols = sorted(str(r[0]) for r in rows.select("symbol").distinct().collect())
    got = feeds.history(spark, feeds.ParquetReplay(folder, zone), symbols, "1d", first, last, chunk_days=30, zone=zone, quotas=8, per_second=1_000_000)
    got = got.where("ts >= timestamp'2024-01-05 00:00:00' AND ts < timestamp'2024-02-10 00:00:00'")
    return got.select(F.col("symbol").cast("long").alias("user_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume")


@query("SELECT p_partkey % 50 AS page_id, p_brand AS symbol, p_brand || '.NS' AS ticker FROM part")
def html_table_symbols(spark, d):
    """Symbols out of HTML tables that are made of the parts."""
    cells = F.concat(F.lit("<tr><td>"), F.col("p_name"), F.lit("</td><td>"), F.col("p_brand"), F.lit("</td></tr>"))
    pages = _read(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("page_id")).agg(F.array_join(F.sort_array(F.collect_list(cells)), "").alias("rows"))
    return html_tables.symbols_from_tables(pages.select("page_id", F.concat(F.lit("<table><tr><th>Name</th><th>Symbol</th></tr>"), "rows", F.lit("</table>")).alias("html")))


@query("SELECT event_id, 'NSE:U' || user_id AS instrument_key, value AS last_price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS last_quantity FROM events WHERE user_id % 5 <> 0")
def payload_ticks(spark, d):
    """Events as a vendor's payloads; tokens that divide by five are unknown."""
    e = _read(spark, d, "events")
    payload = F.to_json(F.struct(F.col("user_id").alias("instrument_token"), F.col("value").alias("last_price"), F.get_json_object("props", "$.k").cast("long").alias("last_traded_quantity")))
    known = e.select(F.col("user_id").alias("token")).distinct().where("token % 5 <> 0").select("token", F.lit("NSE").alias("exchange"), F.concat(F.lit("U"), "token").alias("symbol"))
    raw = e.select(payload.alias("payload"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("received_at"))
    return vendor.ticks_from_payload(raw, known).select(F.col("seq").alias("event_id"), "instrument_key", "last_price", "last_quantity")


@query(f"""WITH {_CTE}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM daily), c AS (SELECT *, unnest(range(CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END)) AS copy FROM b)
SELECT 'NSE:' || symbol AS instrument_key, row_number() OVER (PARTITION BY symbol ORDER BY n, copy) AS seq, close AS last_price, volume AS volume_traded_today FROM c""")
def replayed_ticks(spark, d):
    """Daily bars as ticks, every third one twice."""
    got = replay.ticks_from_bars(daily(spark, d).withColumn("exchange", F.lit("NSE")), duplicate_every=3)
    return got.select("instrument_key", "seq", "last_price", "volume_traded_today")


@query(f"WITH {_CTE} SELECT day, (SELECT min(t.day) FROM trading t WHERE t.day >= days.day) AS session FROM days")
def first_session_on_or_after(spark, d):
    days = cal.days_of(_read(spark, d, "events"))
    return cal.first_session(days.select("day"), days)
