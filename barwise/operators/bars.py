"""Bars from ticks, and coarser bars from finer ones.

Ticks have key, ts, seq (arrival order), price, qty and cum (traded so far today); calendar columns come from
functions.calendar.with_calendar(). A key's ticks are folded in arrival order. The fold is a scan in two passes, so that a very
active key is not one task: its arrivals are cut into blocks, each block is summed up by what it does to the fold's state, the
few summaries of a key are chained to the state that each block opens with, and every block then runs by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions import calendar as cal

#: Ticks of a key that one task folds; a key with more is cut by its arrival numbers.
BLOCK_TICKS = 1_000_000


def _blocked(ticks: DataFrame, block_ticks: int) -> DataFrame:
    """ticks with _block, and _cut where their key has several blocks: arrival numbers from lo on, width to a block."""
    n = F.col("_n")
    spans = ticks.groupBy(F.col("key").alias("_key")).agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"), F.count("*").alias("_n")).where(n > block_ticks)
    spans = spans.select("_key", "_lo", ((F.col("_hi") - F.col("_lo") + 1) / F.ceil(n / block_ticks)).alias("_width"))
    rows = ticks.join(spans, F.col("key").eqNullSafe(F.col("_key")), "left")
    block = F.coalesce(F.floor((F.col("seq") - F.col("_lo")) / F.col("_width")), F.lit(0))
    return rows.withColumn("_block", block).withColumn("_cut", F.col("_width").isNotNull()).drop("_key", "_lo", "_width")


def _openings(rows: DataFrame, inside: Column, strict_sessions: bool) -> DataFrame:
    """(_key, _at, runs, turns, newest) of each block of the keys that were cut: the runs before it, whether its first tick inside
    a session opens a new one, and the newest tick so far of the run that it opens in."""
    seq, state = F.when(inside, F.col("seq")), F.max(F.when(inside, F.struct("_turns", "ts"))).alias("end")
    blocks = rows.where("_cut").groupBy("key", "_block").agg(F.min_by("day", seq).alias("first"), F.max_by("day", seq).alias("last"), F.max("_turns").alias("within"), state)
    order = W.partitionBy("key").orderBy("_block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    first_turns = (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.last("last", ignorenulls=True).over(before))).cast("int")
    blocks = blocks.withColumn("turns", F.lit(0) if strict_sessions else first_turns)
    blocks = blocks.withColumn("runs", F.coalesce(F.sum(F.col("turns") + F.col("within")).over(before), F.lit(0))).withColumn("_end", F.col("runs") + F.col("turns") + F.col("within"))
    newest = F.when(F.col("first").isNotNull(), F.max("end.ts").over(W.partitionBy("key", "_end").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)))
    blocks = blocks.withColumn("_newest", newest).withColumn("newest", F.last("_newest", ignorenulls=True).over(before))
    return blocks.select(F.col("key").alias("_key"), F.col("_block").alias("_at"), "runs", "turns", F.col("newest").alias("_newest"))


def judged(ticks: DataFrame, timeframe: str, strict_sessions: bool = False, block_ticks: int = BLOCK_TICKS) -> DataFrame:
    """ticks with bar, run (of one session) and reason: null, non_trading_day, outside_session or late_tick.

    A tick is late if it is older than one accepted before it in its run. A step back to an earlier day opens a new run, as
    live engines that roll on any change of date do; with strict_sessions such a tick is late too.
    """
    rows = _blocked(ticks.withColumn("bar", cal.bar_second(timeframe)), block_ticks)
    arrival = W.partitionBy("key", "_block").orderBy("seq")
    # only ticks inside a session move the fold, so the others are taken out of its order
    inside = F.col("bar").isNotNull()
    rows = rows.withColumn("_last_day", F.last(F.when(inside, F.col("day")), ignorenulls=True).over(arrival.rowsBetween(W.unboundedPreceding, -1)))
    turn = (inside & F.col("_last_day").isNotNull() & (F.col("day") != F.col("_last_day"))).cast("int")
    rows = rows.withColumn("_turns", F.lit(0) if strict_sessions else F.sum(turn).over(arrival.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    rows = rows.withColumn("_own", F.max(F.when(inside, F.col("ts"))).over(W.partitionBy("key", "_block", "_turns").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)))
    opening = _openings(rows, inside, strict_sessions)
    rows = rows.join(opening, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")), "left")
    # a key's first tick inside a session opens its first run
    first = F.coalesce("turns", F.lit(1))
    began = (inside | F.col("_last_day").isNotNull()).cast("int")
    run = F.lit(0) if strict_sessions else (F.coalesce("runs", F.lit(0)) + first * began + F.col("_turns")).cast("long")
    goes_on = F.lit(True) if strict_sessions else (F.col("_turns") == 0) & (first == 0)
    newest = F.greatest("_own", F.when(goes_on, F.col("_newest")))
    closed = ~F.coalesce("has_any_session", F.lit(False))
    reason = F.when(closed, "non_trading_day").when(~inside, "outside_session").when(F.col("ts") < newest, "late_tick")
    return rows.withColumn("run", run).withColumn("reason", reason).select(*ticks.columns, "bar", "run", "reason")


def bars_from_ticks(ticks: DataFrame, timeframe: str, strict_sessions: bool = False, block_ticks: int = BLOCK_TICKS) -> DataFrame:
    """Bars (key, run, day, bar, open, high, low, close, volume, volume_estimated, open_interest?, ticks) of accepted ticks.

    Volume is the growth of cum over the bar, never below 0; where no tick of the bar has cum it is the sum of qty. The
    first bar of a run starts from 0 at the session's open, else from its first cum, and is then marked as estimated.
    """
    taken = judged(ticks, timeframe, strict_sessions, block_ticks).where("reason is null")
    if strict_sessions:
        taken = taken.withColumn("run", F.col("day"))
    seen = F.when(F.col("cum").isNotNull(), F.col("seq"))
    measures = [
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.max_by("cum", seen).alias("_last_cum"),
        F.min_by("cum", "seq").alias("_first_cum"),
        # the first tick's quantity counts whether it has cum or not
        (F.sum(F.when(F.col("cum").isNull(), F.coalesce("qty", F.lit(0))).otherwise(0)) + F.min_by(F.when(F.col("cum").isNotNull(), F.coalesce("qty", F.lit(0))).otherwise(0), "seq")).alias("_printed"),
        F.count("*").alias("ticks"),
        F.first("cont_s").alias("cont_s"),
        F.first("cont_e").alias("cont_e"),
    ]
    if "oi" in ticks.columns:
        measures.append(F.max_by("oi", F.when(F.col("oi").isNotNull(), F.col("seq"))).alias("open_interest"))
    rows = taken.groupBy("key", "run", "day", "bar").agg(*measures)
    order = W.partitionBy("key", "run").orderBy("bar")
    carried = F.last("_last_cum", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    opening = F.first("bar").over(order) == F.col("cont_s")
    rebased = F.when(opening, F.lit(0)).otherwise(F.coalesce(F.first("_first_cum").over(order), F.lit(0)))
    estimated = (F.row_number().over(order) == 1) & (F.col("bar") != F.col("cont_s")) & F.col("_first_cum").isNotNull()
    rows = rows.withColumn("_base", F.coalesce(carried, rebased)).withColumn("volume_estimated", estimated)
    volume = F.when(F.col("_last_cum").isNull(), F.col("_printed")).otherwise(F.greatest(F.lit(0), F.col("_last_cum") - F.col("_base")))
    return rows.withColumn("volume", volume.cast("long")).drop("_last_cum", "_first_cum", "_printed", "_base")


def session_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Plain bars of all ticks inside sessions, whatever their arrival; one aggregation, combined before its shuffle."""
    rows = ticks.withColumn("bar", cal.bar_second(timeframe)).where("bar is not null")
    return rows.groupBy("key", "day", "bar").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("ticks"),
        F.first("cont_e").alias("cont_e"),
    )


def rollup_to_days(bars: DataFrame, keys: list[str], calendar: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Daily bars stamped at the session's open, and the rows of days without a session, which have no daily bar."""
    kind = dict(bars.dtypes)[ts]
    rows = bars.withColumn("day", F.to_date(ts)).join(F.broadcast(calendar.where("has_any_session").select("day", "cont_s")), "day", "left")
    days = rows.where("cont_s is not null").groupBy(*keys, "day", "cont_s").agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col(ts))).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col(ts))).alias("close"),
        F.sum("volume").alias("volume"),
    )
    days = days.withColumn(ts, cal.at_second(F.col("day"), F.col("cont_s"), kind)).drop("cont_s")
    return days, rows.where("cont_s is null").drop("cont_s")


def coverage(bars: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return bars.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")


def rejections(judged_ticks: DataFrame) -> DataFrame:
    """Ticks by outcome."""
    return judged_ticks.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def depth_measures(rows: DataFrame) -> DataFrame:
    """best_bid, best_ask and spread from ladders bids and asks; the spread is null if a side is empty."""
    rows = rows.withColumn("best_bid", F.try_element_at("bids", F.lit(1))["price"]).withColumn("best_ask", F.try_element_at("asks", F.lit(1))["price"])
    return rows.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def synthetic_ladder(price: Column, side: int, levels: int = 5, step: float = 0.05) -> Column:
    """Depth of a side (-1 bids, 1 asks) around a price."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct(F.round(price + side * step * (i + 1), 2).alias("price"), (100 * (i + 1)).cast("long").alias("quantity"), (i + 1).cast("int").alias("orders")))
