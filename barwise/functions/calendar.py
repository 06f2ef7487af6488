"""Exchange calendar: days with their session windows, and what a timestamp means in them.

Windows are held as seconds after midnight of the exchange's day, so the same expressions serve instants (under the
exchange's session time zone) and wall-clock timestamps. The calendar has one row a day and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.schemas import HOLIDAY, SPECIAL, TIMEFRAMES

# Exchange holidays (day, name) and evening sessions (day, label, continuous and pre-open windows).
HOLIDAYS = """
2019-03-04 Mahashivratri
2019-03-21 Holi
2019-04-17 Mahavir Jayanti
2019-04-19 Good Friday
2019-04-29 Parliamentary Elections (Mumbai)
2019-05-01 Maharashtra Day
2019-06-05 Id-ul-Fitr
2019-08-12 Bakri Id
2019-08-15 Independence Day
2019-09-02 Ganesh Chaturthi
2019-09-10 Moharram
2019-10-02 Gandhi Jayanti
2019-10-08 Dussehra
2019-10-28 Diwali Balipratipada
2019-11-12 Guru Nanak Jayanti
2019-12-25 Christmas
2020-02-21 Mahashivratri
2020-03-10 Holi
2020-04-02 Ram Navami
2020-04-06 Mahavir Jayanti
2020-04-10 Good Friday
2020-04-14 Dr Baba Saheb Ambedkar Jayanti
2020-05-01 Maharashtra Day
2020-05-25 Id-ul-Fitr
2020-10-02 Gandhi Jayanti
2020-11-16 Diwali Balipratipada
2020-11-30 Guru Nanak Jayanti
2020-12-25 Christmas
2021-01-26 Republic Day
2021-03-11 Mahashivratri
2021-03-29 Holi
2021-04-02 Good Friday
2021-04-14 Dr Baba Saheb Ambedkar Jayanti
2021-04-21 Ram Navami
2021-05-13 Id-ul-Fitr
2021-07-21 Bakri Id
2021-08-19 Moharram
2021-09-10 Ganesh Chaturthi
2021-10-15 Dussehra
2021-11-04 Diwali Laxmi Pujan
2021-11-05 Diwali Balipratipada
2021-11-19 Guru Nanak Jayanti
2022-01-26 Republic Day
2022-03-01 Mahashivratri
2022-03-18 Holi
2022-04-14 Dr Baba Saheb Ambedkar Jayanti / Mahavir Jayanti
2022-04-15 Good Friday
2022-05-03 Id-ul-Fitr
2022-08-09 Moharram
2022-08-15 Independence Day
2022-08-31 Ganesh Chaturthi
2022-10-05 Dussehra
2022-10-24 Diwali Laxmi Pujan
2022-10-26 Diwali Balipratipada
2022-11-08 Guru Nanak Jayanti
2023-01-26 Republic Day
2023-03-07 Holi
2023-03-30 Ram Navami
2023-04-04 Mahavir Jayanti
2023-04-07 Good Friday
2023-04-14 Dr Baba Saheb Ambedkar Jayanti
2023-05-01 Maharashtra Day
2023-06-29 Bakri Id
2023-08-15 Independence Day
2023-09-19 Ganesh Chaturthi
2023-10-02 Gandhi Jayanti
2023-10-24 Dussehra
2023-11-14 Diwali Balipratipada
2023-11-27 Guru Nanak Jayanti
2023-12-25 Christmas
2024-01-22 Special holiday (Ayodhya Pran Pratishtha)
2024-01-26 Republic Day
2024-03-08 Mahashivratri
2024-03-25 Holi
2024-03-29 Good Friday
2024-04-11 Id-ul-Fitr
2024-04-17 Ram Navami
2024-05-01 Maharashtra Day
2024-05-20 Lok Sabha Elections (Mumbai)
2024-06-17 Bakri Id
2024-07-17 Moharram
2024-08-15 Independence Day
2024-10-02 Gandhi Jayanti
2024-11-01 Diwali Laxmi Pujan
2024-11-15 Guru Nanak Jayanti
2024-11-20 Maharashtra Assembly Elections
2024-12-25 Christmas
2025-02-26 Mahashivratri
2025-03-14 Holi
2025-03-31 Id-ul-Fitr
2025-04-10 Shri Mahavir Jayanti
2025-04-14 Dr Baba Saheb Ambedkar Jayanti
2025-04-18 Good Friday
2025-05-01 Maharashtra Day
2025-08-15 Independence Day
2025-08-27 Ganesh Chaturthi
2025-10-02 Gandhi Jayanti / Dussehra
2025-10-21 Diwali Laxmi Pujan
2025-10-22 Diwali Balipratipada
2025-11-05 Guru Nanak Jayanti
2025-12-25 Christmas
2026-01-26 Republic Day
2026-04-03 Good Friday
2026-05-01 Maharashtra Day
2026-10-02 Gandhi Jayanti
2026-12-25 Christmas
"""
SPECIALS = """
2019-10-27,Muhurat Trading (Samvat 2076),18:15,19:15,18:00,18:08
2020-11-14,Muhurat Trading (Samvat 2077),18:15,19:15,18:00,18:08
2021-11-04,Muhurat Trading (Samvat 2078),18:15,19:15,18:00,18:08
2022-10-24,Muhurat Trading (Samvat 2079),18:15,19:15,18:00,18:08
2023-11-12,Muhurat Trading (Samvat 2080),18:15,19:15,18:00,18:08
2024-11-01,Muhurat Trading (Samvat 2081),18:00,19:00,17:45,17:53
2025-10-21,Muhurat Trading (Samvat 2082),13:45,14:45,13:30,13:38
"""


def holiday_list() -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in HOLIDAYS.strip().splitlines()]


@dataclass(frozen=True)
class Windows:
    """Regular session in seconds after midnight, half-open."""

    pre: tuple[int, int] = (9 * 3600, 9 * 3600 + 900)
    continuous: tuple[int, int] = (9 * 3600 + 900, 15 * 3600 + 1800)
    post: tuple[int, int] = (15 * 3600 + 2400, 16 * 3600)


REGULAR = Windows()


def seconds_of(clock: Column) -> Column:
    """Seconds after midnight of an HH:MM text; null if blank."""
    own = F.nullif(F.trim(clock), F.lit(""))
    return F.split_part(own, F.lit(":"), F.lit(1)).cast("int") * 3600 + F.split_part(own, F.lit(":"), F.lit(2)).cast("int") * 60


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Holidays from CSV with comment lines before the header."""
    rows = spark.read.schema(HOLIDAY).option("header", True).option("comment", "#").csv(path)
    return rows.select("date", F.trim("name").alias("name"), F.trim("confidence").alias("confidence"), F.trim("source").alias("source"))


def read_specials(spark: SparkSession, path: str) -> DataFrame:
    return special_rows(spark.read.schema(SPECIAL).option("header", True).option("comment", "#").csv(path))


def special_rows(rows: DataFrame) -> DataFrame:
    names = {"cont_s": "continuous_start", "cont_e": "continuous_end", "pre_s": "pre_open_start", "pre_e": "pre_open_end", "post_s": "post_close_start", "post_e": "post_close_end"}
    return rows.select("date", F.trim("label").alias("label"), *(seconds_of(F.col(v)).alias(k) for k, v in names.items()), (F.lower(F.trim("tradeable")) == "true").alias("tradeable"))


def shipped(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Holidays and special sessions that come with the library."""
    days = spark.createDataFrame(holiday_list(), "date string, name string").select(F.to_date("date").alias("date"), "name")
    rows = [(*x.split(","), None, None, "false", "shipped") for x in SPECIALS.split("\n") if x]
    specials = spark.createDataFrame(rows, "date string, label string, continuous_start string, continuous_end string, pre_open_start string, pre_open_end string, post_close_start string, post_close_end string, tradeable string, source string")
    return days, special_rows(specials.withColumn("date", F.to_date("date")))


def calendar_days(spark: SparkSession, start, end, holidays: DataFrame | None = None, specials: DataFrame | None = None, windows: Windows = REGULAR) -> DataFrame:
    """One row a day from start to end with flags and windows; a closed day's windows are null, a special session's override.

    start and end are dates, ISO texts or columns of the one-row frame F.expr() may see. ordinal numbers the trading days.
    """
    if holidays is None or specials is None:
        a, b = shipped(spark)
        holidays, specials = (a if holidays is None else holidays), (b if specials is None else specials)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return describe_days(days, holidays, specials, windows)


def describe_days(days: DataFrame, holidays: DataFrame, specials: DataFrame, windows: Windows = REGULAR) -> DataFrame:
    names = ["cont_s", "cont_e", "pre_s", "pre_e", "post_s", "post_e"]
    own = days.join(F.broadcast(holidays.select(F.col("date").alias("day"), F.col("name").alias("holiday"))), "day", "left")
    own = own.join(F.broadcast(specials.select(F.col("date").alias("day"), "label", "tradeable", *(F.col(n).alias(f"s_{n}") for n in names))), "day", "left")
    trading = (F.weekday("day") < 5) & F.col("holiday").isNull()
    special = F.col("label").isNotNull()
    regular = dict(zip(names, (*windows.continuous, *windows.pre, *windows.post), strict=True))
    return own.select(
        "day",
        (F.weekday("day") >= 5).alias("is_weekend"),
        F.col("holiday").isNotNull().alias("is_holiday"),
        "holiday",
        trading.alias("is_trading_day"),
        special.alias("is_special"),
        (trading | special).alias("has_any_session"),
        "label",
        F.when(special, F.col("tradeable")).otherwise(trading).alias("tradeable"),
        *(F.when(special, F.col(f"s_{n}")).when(trading, F.lit(regular[n])).alias(n) for n in names),
        F.when(trading, F.lit("open")).when(special, F.lit("special")).when(F.weekday("day") >= 5, F.lit("weekend")).otherwise(F.lit("holiday")).alias("status"),
    )


def days_of(df: DataFrame, ts: str = "ts", windows: Windows = REGULAR) -> DataFrame:
    """The calendar over the days that df spans, found by one aggregate."""
    span = df.agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b"))
    days = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return describe_days(days, *shipped(df.sparkSession), windows)


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def at_second(day: Column, second: Column, kind: str) -> Column:
    """The timestamp (of type kind) at a second of a day."""
    return day.cast(kind) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))


def with_calendar(df: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """df with day, second and the day's calendar columns; days outside the calendar have nulls."""
    own = df.withColumn("day", F.to_date(ts)).withColumn("second", second_of_day(F.col(ts)))
    return own.join(F.broadcast(calendar), "day", "left")


def phase() -> Column:
    """Session phase of a row of with_calendar()."""
    def inside(a, b):
        return (F.col("second") >= F.col(a)) & (F.col("second") < F.col(b))

    return F.when(inside("pre_s", "pre_e"), "pre_open").when(inside("cont_s", "cont_e"), "continuous").when(inside("post_s", "post_e"), "post_close").otherwise("closed")


def session_date() -> Column:
    """The day, if the row lies between the first and last moment of its windows; else null."""
    first = F.coalesce("pre_s", "cont_s")
    last = F.coalesce("post_e", "cont_e")
    return F.when((F.col("second") >= first) & (F.col("second") < last), F.col("day"))


def bar_second(timeframe: str) -> Column:
    """Start of the bar that holds the row, anchored at the session's open; null outside the continuous session."""
    step = TIMEFRAMES[timeframe]
    start = F.col("cont_s") if step is None else F.col("cont_s") + F.floor((F.col("second") - F.col("cont_s")) / step).cast("int") * step
    return F.when((F.col("second") >= F.col("cont_s")) & (F.col("second") < F.col("cont_e")), start)


def bar_end_second(start: Column, timeframe: str) -> Column:
    """End of a bar, clamped to the session's close."""
    step = TIMEFRAMES[timeframe]
    return F.col("cont_e") if step is None else F.least(start + step, F.col("cont_e"))


def is_partial(start: Column, timeframe: str) -> Column:
    step = TIMEFRAMES[timeframe]
    return F.lit(False) if step is None else start + step > F.col("cont_e")


def bar_grid(calendar: DataFrame, timeframe: str, include_special: bool = False, anchor: str = "open") -> DataFrame:
    """(day, bar) for every expected bar, bar in seconds after midnight.

    Bars step from the session's open, or with anchor midnight from there, of which those inside the session count. A daily bar
    begins at the open either way.
    """
    if anchor not in ("open", "midnight"):
        raise ValueError(f"anchor must be open or midnight, not {anchor!r}")
    days = calendar.where(F.col("has_any_session") if include_special else F.col("is_trading_day"))
    step = TIMEFRAMES[timeframe]
    if step is None:
        return days.select("day", F.col("cont_s").alias("bar"))
    first = F.col("cont_s") if anchor == "open" else (F.ceil(F.col("cont_s") / step) * step).cast("int")
    bars = F.when(first < F.col("cont_e"), F.sequence(first, F.col("cont_e") - 1, F.lit(step)))
    return days.select("day", F.explode(bars).alias("bar"))


def trading_ordinals(calendar: DataFrame) -> DataFrame:
    """(day, ordinal) of trading days in order; the calendar is one small table, so one window is enough."""
    return calendar.where("is_trading_day").select("day", F.row_number().over(W.orderBy("day")).alias("ordinal"))


def nth_trading_day(days: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """days (day) with the n-th trading day after it (before it, for negative n) as target; null beyond the calendar.

    Special sessions do not count. The calendar carries, for each day, how many trading days lie up to it.
    """
    seen = calendar.select("day", "is_trading_day", F.sum(F.col("is_trading_day").cast("int")).over(W.orderBy("day")).alias("upto"))
    goal = F.col("upto") + n if n > 0 else F.col("upto") - F.col("is_trading_day").cast("int") + n + 1
    targets = trading_ordinals(calendar).select(F.col("day").alias("target"), "ordinal")
    near = seen.withColumn("ordinal", goal).join(F.broadcast(targets), "ordinal", "left").select("day", "target")
    return days.join(F.broadcast(near), "day", "left")


def sessions_between(spans: DataFrame, calendar: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """spans with the number of trading days after start up to end."""
    seen = calendar.select("day", F.sum(F.col("is_trading_day").cast("int")).over(W.orderBy("day")).alias("upto"))
    a = F.broadcast(seen.select(F.col("day").alias(start), F.col("upto").alias("_a")))
    b = F.broadcast(seen.select(F.col("day").alias(end), F.col("upto").alias("_b")))
    return spans.join(a, start, "left").join(b, end, "left").withColumn("sessions", F.col("_b") - F.col("_a")).drop("_a", "_b")


def holidays_between(calendar: DataFrame, start, end) -> DataFrame:
    """(day, holiday) from start to end, both included."""
    return calendar.where(F.col("is_holiday") & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("day", "holiday")


def first_session(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """days (day) with the first trading day on or after it as session; null beyond the calendar."""
    ahead = F.min(F.when(F.col("is_trading_day"), F.col("day"))).over(W.orderBy("day").rowsBetween(0, W.unboundedFollowing))
    return days.join(F.broadcast(calendar.select("day", ahead.alias("session"))), "day", "left")


def next_expiry(now: Column, second: int = 6 * 3600) -> Column:
    """The next moment, after now, at which a token that lapses daily at that second of the day does so."""
    today = F.date_trunc("day", now) + F.make_dt_interval(secs=F.lit(second).cast("decimal(18,6)"))
    return F.when(today <= now, today + F.make_dt_interval(F.lit(1))).otherwise(today)


def seconds_until(moment: Column, now: Column) -> Column:
    """Seconds from now to moment, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(moment.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000)


def data_age(last: Column, now: Column) -> Column:
    """Seconds since last; null if nothing came yet."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1_000_000
