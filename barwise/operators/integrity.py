"""Integrity checks of bars. Each returns the rows that fail; findings() joins them to one report.

Keys name the columns of a series (symbol and the like). Calendars and expected grids are small and broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close", "volume"]


def missing_bars(bars: DataFrame, grid: DataFrame, keys: list[str], slot: list[str]) -> DataFrame:
    """(keys, slot) expected by the grid and absent; slot names the grid's columns. The grid excludes special sessions."""
    expected = bars.select(*keys).distinct().join(F.broadcast(grid.select(F.collect_list(F.struct(*slot)).alias("slots"))))
    return expected.select(*keys, F.inline("slots")).join(bars, [*keys, *slot], "left_anti")


def unexpected_bars(bars: DataFrame, grid: DataFrame, slot: list[str]) -> DataFrame:
    """Bars at no slot of the grid, which includes special sessions; all bars of closed days are among them."""
    return bars.join(F.broadcast(grid), slot, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order, found without a window: an aggregate that combines before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def out_of_order(rows: DataFrame, keys: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Rows older than the one that arrived just before them."""
    return rows.withColumn("previous_ts", F.lag(ts).over(W.partitionBy(*keys).orderBy(seq))).where(F.col(ts) < F.col("previous_ts"))


def invalid_reasons() -> Column:
    """The broken rules of a bar, joined by commas; empty for a sound one. A NaN or null price breaks the rule it stands in."""
    bad = lambda *cs: reduce(lambda a, b: a | b, [F.coalesce(F.isnan(c) | c.isNull(), F.lit(True)) for c in cs])
    o, h, lo, c, v = (F.col(x) for x in FIELDS)
    return F.concat_ws(
        ", ",
        F.when(~bad(h, lo) & (h < lo), "high<low"),
        F.when(bad(lo, o, h) | ~((lo <= o) & (o <= h)), "open outside range"),
        F.when(bad(lo, c, h) | ~((lo <= c) & (c <= h)), "close outside range"),
        F.when(F.coalesce(v < 0, F.lit(False)), "negative volume"),
        F.when(reduce(lambda a, b: a | b, [F.coalesce(x <= 0, F.lit(False)) for x in (o, h, lo, c)]), "non-positive price"),
    )


def invalid_bars(bars: DataFrame) -> DataFrame:
    return bars.withColumn("reasons", invalid_reasons()).where("reasons <> ''")


def session_gaps(days: DataFrame, keys: list[str], calendar: DataFrame) -> DataFrame:
    """(keys, day, following, skipped): consecutive observed days (keys, day) with trading days between them."""
    upto = F.broadcast(calendar.select("day", F.sum(F.col("is_trading_day").cast("int")).over(W.orderBy("day")).alias("upto"), F.col("is_trading_day").cast("int").alias("own")))
    seen = days.select(*keys, "day").distinct().join(upto, "day")
    order = W.partitionBy(*keys).orderBy("day")
    pairs = seen.withColumn("following", F.lead("day").over(order)).withColumn("_next", F.lead(F.col("upto") - F.col("own")).over(order))
    return pairs.where(F.col("_next") > F.col("upto")).select(*keys, "day", "following", (F.col("_next") - F.col("upto")).alias("skipped"))


def suspected_actions(days: DataFrame, keys: list[str], threshold: float, known: DataFrame | None = None) -> DataFrame:
    """Daily closes (keys, day, close) that move by the log-return threshold or more, without those of known (keys, day)."""
    order = W.partitionBy(*keys).orderBy("day")
    real = days.where((F.col("close") > 0) & ~F.isnan("close"))
    moves = real.withColumn("log_return", F.ln("close") - F.lag(F.ln("close")).over(order)).where(F.abs("log_return") >= threshold)
    return moves if known is None else moves.join(known, [*keys, "day"], "left_anti")


def missing_holidays(days: DataFrame, calendar: DataFrame, min_symbols: int = 5, symbol: str = "symbol") -> DataFrame:
    """Trading days on which no series has a bar, within the observed span; none if fewer than min_symbols series exist."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count_distinct(symbol).alias("n"))
    seen = days.select("day").distinct()
    open_days = calendar.where("is_trading_day").select("day").join(F.broadcast(span), F.col("day").between(F.col("a"), F.col("b")) & (F.col("n") >= min_symbols))
    return open_days.select("day").join(seen, "day", "left_anti")


def phantom_holidays(bars: DataFrame, calendar: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Holidays that have bars, with the number of bars and of series."""
    closed = calendar.where("is_holiday and not is_weekend").select("day", "holiday", "is_special")
    return bars.join(F.broadcast(closed), "day").groupBy("day", "holiday", "is_special").agg(F.count("*").alias("bars"), F.count_distinct(symbol).alias("symbols"))


def reconcile(live: DataFrame, rest: DataFrame, keys: list[str], price_tolerance: float = 0.0005, volume_tolerance: float = 0.02) -> DataFrame:
    """(keys, field, live, rest, relative_error) of fields that differ by more than their tolerance; infinite where rest is 0."""
    both = live.select(*keys, *(F.col(f).cast("double").alias(f"l_{f}") for f in FIELDS)).join(rest.select(*keys, *(F.col(f).cast("double").alias(f"r_{f}") for f in FIELDS)), keys)
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("live"), F.col(f"r_{f}").alias("rest")) for f in FIELDS))
    rows = both.select(*keys, F.inline(fields))
    error = F.when(F.col("rest") == 0, F.when(F.col("live") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.abs(F.try_divide(F.col("live") - F.col("rest"), F.col("rest"))))
    limit = F.when(F.col("field") == "volume", volume_tolerance).otherwise(price_tolerance)
    return rows.withColumn("relative_error", error).where((F.col("relative_error") > limit) & ~F.isnan("relative_error"))


#: Checks in the order of a report: severity and message.
CHECKS = {
    "missing_bars": ("warning", "%d bar(s) missing"),
    "unexpected_bars": ("warning", "%d bar(s) outside sessions"),
    "duplicate_bars": ("error", "%d duplicated timestamp(s)"),
    "out_of_order": ("error", "%d row(s) out of order"),
    "invalid_ohlc": ("error", "%d invalid bar(s)"),
    "suspected_unadjusted_action": ("error", "%d suspected unadjusted action(s)"),
}


def check_bars(bars: DataFrame, keys: list[str], grid: DataFrame, grid_with_specials: DataFrame, calendar: DataFrame, max_missing: float = 0.02, threshold: float = 0.2, known: DataFrame | None = None) -> DataFrame:
    """All findings of bars (keys, ts, day, bar, seq, open..volume): keys, check, severity, n, message, places (the first ten days).

    The bars are read and shuffled once. A series is sorted by time and by arrival; its rows carry a mark for each check, which
    are counted by day and then by series. Grids are broadcast: a bar learns from one row of them whether its slot is expected
    and allowed. Missing are the expected slots less those found, on the days that have fewer than they should. A slot of grid
    that grid_with_specials lacks is allowed too.
    """
    slot = ["day", "bar"]
    slots = grid_with_specials.select(*slot, F.lit(0).alias("_want")).unionByName(grid.select(*slot, F.lit(1).alias("_want")))
    slots = slots.groupBy(*slot).agg(F.max("_want").alias("_want"))
    wanted = grid.select(*slot).distinct().groupBy("day").agg(F.count("*").alias("_day_wants"))
    whole = F.broadcast(wanted.agg(F.coalesce(F.sum("_day_wants"), F.lit(0)).alias("_slots"), F.coalesce(F.collect_list("day"), F.array()).alias("_days")))
    rows = bars.join(F.broadcast(slots), slot, "left").join(F.broadcast(wanted), "day", "left")
    if known is not None:
        rows = rows.join(known.select(*keys, "day").distinct().withColumn("_known", F.lit(True)), [*keys, "day"], "left")
    time = W.partitionBy(*keys).orderBy("day", "ts", "seq")
    arrival = W.partitionBy(*keys).orderBy("seq")
    real = (F.col("close") > 0) & ~F.isnan("close")
    last_close = F.last(F.when(real, F.ln("close")), ignorenulls=True).over(time.rowsBetween(W.unboundedPreceding, -1))
    again = lambda n: F.lag(F.struct("day", "ts"), n).over(time) == F.struct("day", "ts")
    marks = {
        "unexpected_bars": F.col("_want").isNull(),
        "duplicate_bars": again(1) & ~F.coalesce(again(2), F.lit(False)),
        "out_of_order": F.col("ts") < F.lag("ts").over(arrival),
        "invalid_ohlc": invalid_reasons() != "",
        "suspected_unadjusted_action": real & (F.abs(F.ln("close") - last_close) >= threshold) & (F.col("_known").isNull() if known is not None else F.lit(True)),
    }
    rows = rows.select(*keys, "day", "bar", "_want", "_day_wants", *(F.coalesce(m, F.lit(False)).alias(c) for c, m in marks.items()))
    found = F.size(F.collect_set(F.when(F.col("_want") == 1, F.col("bar"))))
    by_day = rows.groupBy(*keys, "day").agg(found.alias("_found"), F.first("_day_wants").alias("_day_wants"), *(F.count_if(c).alias(c) for c in marks))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.col("day"))))
    complete = F.collect_list(F.when(F.col("_found") == F.col("_day_wants"), F.col("day")))
    series = by_day.groupBy(*keys).agg(F.sum("_found").alias("_found"), complete.alias("_complete"), *(F.struct(F.sum(c).alias("n"), listed(c).alias("places")).alias(c) for c in marks))
    series = series.join(whole).withColumn("missing_bars", F.struct((F.col("_slots") - F.col("_found")).alias("n"), F.array_sort(F.array_except("_days", "_complete")).alias("places")))

    def outcome(check: str) -> Column:
        severity, message = CHECKS[check]
        n = F.col(check)["n"]
        level = F.when(n > max_missing * F.col("_slots"), "error").otherwise(severity) if check == "missing_bars" else F.lit(severity)
        return F.struct(F.lit(check).alias("check"), level.alias("severity"), n.alias("n"), F.format_string(message, n).alias("message"), F.slice(F.col(check)["places"], 1, 10).alias("places"))

    return series.select(*keys, F.inline(F.filter(F.array(*map(outcome, CHECKS)), lambda x: x["n"] > 0)))


def totals() -> list[Column]:
    """errors, warnings and is_clean of findings, as aggregates."""
    errors = F.count_if(F.col("severity") == "error")
    return [errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("is_clean")]


def report_totals(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(*totals())
