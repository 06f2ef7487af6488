"""spark-submit entry points: backfill the store from a vendor, check stored bars, verify the calendar, check statements.

Settings come from config.load(): a file, then the environment; options win over both.

Exit codes: 0 fine, 1 findings, 2 nothing to work on.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from barwise import config
from barwise.functions import calendar as cal
from barwise.operators import footing, ingest, integrity, layout
from barwise.session import session
from barwise.sources import csv_sink, feeds, vendor
from barwise.sources.store import BarStore


def check_bars(args, spark) -> int:
    bars = BarStore(spark, args.store).read(args.exchange, args.symbol, args.timeframe, args.start, f"{args.end} 23:59:59")
    if not bars.limit(1).count():
        return 2
    days = cal.calendar_days(spark, args.start, args.end).cache()
    rows = cal.with_calendar(bars, days).withColumn("bar", F.col("second")).withColumn("seq", F.unix_micros("ts"))
    limits = args.config.integrity
    found = integrity.check_bars(rows, ["symbol"], cal.bar_grid(days, args.timeframe), cal.bar_grid(days, args.timeframe, True), days, limits.max_missing, limits.suspect_abs_log_return)
    found = found.cache()
    found.orderBy("severity", "check").show(truncate=False)
    return int(found.where("severity = 'error'").limit(1).count() > 0)


def backfill(args, spark) -> int:
    """Plan, fetch, store and check, a wave of requests at a time; what is stored is not asked for again but for its last day.

    A run that dies has stored its finished waves; the next one goes on from there.
    """
    settings, store = args.config, BarStore(spark, args.store)
    keys = ["exchange", "symbol", "timeframe"]
    symbols = [s.strip() for s in args.symbols.split(",") if s.strip()]
    if not symbols:
        return 2
    wanted = spark.createDataFrame([(args.exchange, s, t, args.start, args.end) for s in symbols for t in args.timeframes.split(",")], ", ".join(f"{k} string" for k in (*keys, "start", "end")))
    wanted = wanted.withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    ranges = ingest.resume_points(wanted, store.coverage(), keys, args.years or settings.history_years).cache()
    span = ranges.agg(F.min("start"), F.max("end")).first()
    if span[0] is None:
        return 0
    days = cal.calendar_days(spark, *span).cache()
    plans = [ingest.chunk_plan(ranges.where(F.col("timeframe") == t), days, ingest.SPAN_DAYS[t], keys) for t in args.timeframes.split(",")]
    plan = plans[0]
    for more in plans[1:]:
        plan = plan.unionByName(more)
    # requests in the order of time, so that a series has no hole where a run ends
    plan = plan.orderBy("first_day", *keys).collect()
    client, failed = feeds.unpacked(args.client), 0
    for i in range(0, len(plan), args.wave):
        rows = vendor.fetch(spark.createDataFrame(plan[i : i + args.wave]), client, args.per_second, args.quotas).cache()
        log = ingest.ingest_summary(vendor.ingest_log(rows), ["exchange", "symbol", "timeframe"]).cache()
        store.write(rows.where("ts IS NOT NULL"))
        log.show(truncate=False)
        if args.csv:
            csv_sink.write_csv(rows.where("ts IS NOT NULL").drop("chunk", "error"), f"{args.csv}/wave-{i // args.wave:05d}", ["symbol"], ["timeframe", "ts"])
        failed = log.where(F.size("errors") > 0).count()
        rows.unpersist()
        if failed:
            break  # later days of a failed series would hide the hole from the next run
    return int(failed > 0)


def verify_calendar(args, spark) -> int:
    store = BarStore(spark, args.store)
    table = store._table()
    days = cal.calendar_days(spark, args.start, args.end).cache()
    own = None if table is None else table.where(f"timeframe = '{args.timeframe}'").select("symbol", F.to_date("ts").alias("day")).where(F.col("day").between(args.start, args.end))
    if own is None or own.select("symbol").distinct().limit(5).count() < 5:
        return 2
    missing, phantom = integrity.missing_holidays(own, days), integrity.phantom_holidays(own, days)
    missing.show()
    phantom.show(truncate=False)
    return int(missing.limit(1).count() + phantom.limit(1).count() > 0)


def check_statements(args, spark) -> int:
    words = spark.read.parquet(args.words)
    if not words.limit(1).count():
        return 2
    checks = footing.analyze(layout.cells(layout.table_rows(words)), args.tolerance).cache()
    if args.json:
        checks.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(args.json)
    if args.marks:
        footing.annotations(checks).write.mode("overwrite").parquet(args.marks)
    footing.report(checks).show(truncate=False)
    return int(checks.where("status = 'error'").limit(1).count() > 0)


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    kinds = parser.add_subparsers(required=True)
    parser.add_argument("--config")
    for name, f in (("bars", check_bars), ("calendar", verify_calendar), ("backfill", backfill)):
        p = kinds.add_parser(name)
        p.set_defaults(run=f)
        p.add_argument("--store")
        p.add_argument("--end", required=True)
        p.add_argument("--start", required=name != "backfill")
        if name == "backfill":
            for option in ("--symbols", "--client"):
                p.add_argument(option, required=True)
            p.add_argument("--exchange", default="NSE")
            p.add_argument("--timeframes", default="1d")
            for option, kind, value in (("--years", int, 0), ("--wave", int, 500), ("--quotas", int, 1), ("--per-second", float, 3.0), ("--csv", str, None)):
                p.add_argument(option, type=kind, default=value)
            continue
        p.add_argument("--timeframe", default="1d")
        if name == "bars":
            p.add_argument("--exchange", default="NSE")
            p.add_argument("--symbol", required=True)
    p = kinds.add_parser("statements")
    p.set_defaults(run=check_statements)
    p.add_argument("words")
    p.add_argument("--tolerance", type=float, default=1.0)
    p.add_argument("--json")
    p.add_argument("--marks")
    args = parser.parse_args(argv)
    args.config = config.load(args.config)
    if getattr(args, "store", "") is None:
        args.store = args.config.store.root
    return args.run(args, spark or session())


if __name__ == "__main__":
    raise SystemExit(main())
