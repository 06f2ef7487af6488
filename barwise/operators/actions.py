"""Corporate actions: factors, the close they refer to, and back-adjusted bars. Adjustment is made on read, never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.operators.asof import as_of
from barwise.schemas import ACTION

KINDS = ["SPLIT", "BONUS", "DIVIDEND", "RIGHTS", "MERGER", "DEMERGER"]


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Actions from CSV with comment lines: symbols and types in capitals, blank numbers null, source 'seed' if blank."""
    texts = spark.read.schema(", ".join(f"{f.name} string" for f in ACTION)).option("header", True).option("comment", "#").csv(path)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    numbers = {f.name for f in ACTION if f.dataType.typeName() == "double"}
    made = {"symbol": F.upper(F.trim("symbol")), "action_type": F.upper(F.trim("action_type")), "ex_date": F.trim("ex_date").cast("date"), "source": F.coalesce(blank("source"), F.lit("seed"))}
    return texts.select(*((made[f.name] if f.name in made else F.col(f.name).try_cast("double") if f.name in numbers else blank(f.name)).alias(f.name) for f in ACTION))


def with_factors(actions: DataFrame, adjust_dividends: bool = True) -> DataFrame:
    """actions (with cum_close) with price_factor, volume_factor, status (applied, skipped) and reason.

    An override wins for the price. Factors that lack what they need are null and the action is skipped with the reason.
    """
    kind, over, cum = F.col("action_type"), F.col("price_factor_override"), F.col("cum_close")
    new, old, value, at = F.col("ratio_new"), F.col("ratio_old"), F.col("value_per_share_inr"), F.col("rights_issue_price_inr")
    ratio_bad = new.isNull() | old.isNull() | (new <= 0) | (old <= 0)
    needs_ratio, needs_value = kind.isin("SPLIT", "BONUS", "RIGHTS"), kind.isin("DIVIDEND", "DEMERGER")
    reason = (
        F.when(~kind.isin(KINDS), F.format_string("unknown action type %s", kind))
        .when((kind == "DIVIDEND") & F.lit(not adjust_dividends), "dividends are not adjusted")
        .when(needs_ratio & ratio_bad & (over.isNull() | (kind == "RIGHTS")), "needs positive ratio_new and ratio_old")
        .when(over.isNotNull(), None)
        .when(needs_value & (value.isNull() | (value <= 0)), "needs a positive value_per_share")
        .when((kind == "RIGHTS") & at.isNull(), "needs the rights issue price")
        .when((needs_value | (kind == "RIGHTS")) & (cum.isNull() | (cum <= 0)), "no cum-date close")
        .when(kind == "MERGER", "a merger needs a price factor override")
    )
    rights = F.try_divide(F.try_divide(old * cum + new * at, old + new), cum)
    price = F.when(over.isNotNull(), over).when(kind.isin("SPLIT", "BONUS"), F.try_divide(old, new)).when(needs_value, F.try_divide(cum - value, cum)).when(kind == "RIGHTS", rights)
    volume = (
        F.when(kind == "RIGHTS", F.try_divide(old + new, old))
        .when(kind.isin("SPLIT", "BONUS"), F.when(over.isNotNull(), F.try_divide(F.lit(1.0), over)).otherwise(F.try_divide(new, old)))
        .otherwise(1.0)
    )
    judged = actions.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return judged.withColumn("price_factor", F.when(ok, price)).withColumn("volume_factor", F.when(ok, volume)).withColumn("status", F.when(ok, "applied").otherwise("skipped"))


def with_cum_close(actions: DataFrame, bars: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """actions with cum_close: the last raw close of their symbol before ex_date (as-of, strictly earlier).

    Only bars of symbols that have actions are sorted, together with those: rows through the join follow the sum of both.
    """
    own = bars.where("close is not null").join(actions.select(symbol).distinct(), symbol, "left_semi")
    return as_of(actions, own, [symbol], F.col("ex_date"), F.col(ts), F.col("close"), "cum_close")


def validity(actions: DataFrame, symbol: str = "symbol") -> DataFrame:
    """(symbol, ex_date, price_factor, volume_factor): for each day of applied actions, the product of its factors and of all later
    ones, which holds for the bars between the action before and this one."""
    later = W.partitionBy(symbol).orderBy(F.desc("ex_date")).rangeBetween(W.unboundedPreceding, 0)
    factors = [F.product(c).over(later).alias(c) for c in ("price_factor", "volume_factor")]
    return actions.where("status = 'applied' AND ex_date IS NOT NULL").select(symbol, "ex_date", *factors).distinct()


def adjust(bars: DataFrame, actions: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """bars with prices and volume adjusted for later actions (from with_factors()), beside raw_close and both factors.

    A bar is multiplied by the factors of all actions with ex_date after its day: it finds the next one, which has the product.
    Zero and negative factors multiply as they are. Symbols without actions keep factor 1.
    """
    factors = F.struct("price_factor", "volume_factor")
    names = [c for c in bars.columns if c not in ("price_factor", "volume_factor")]
    rows = as_of(bars.select(*names), validity(actions, symbol), [symbol], F.to_date(ts), F.col("ex_date"), factors, "_f", forward=True)
    for c in ("price_factor", "volume_factor"):
        rows = rows.withColumn(c, F.coalesce(F.col("_f")[c], F.lit(1.0)))
    rows = rows.drop("_f").withColumn("raw_close", F.col("close"))
    return rows.withColumns({**{c: F.col(c) * F.col("price_factor") for c in ("open", "high", "low", "close")}, "volume": F.col("volume") * F.col("volume_factor")})


def deadjust(bars: DataFrame, ex_date, new: float, old: float, ts: str = "ts") -> DataFrame:
    """A clean series made to look unadjusted: prices before ex_date times new / old, volume divided by it and cut to whole."""
    before = F.to_date(ts) < F.lit(ex_date).cast("date")
    f = new / old
    prices = {c: F.when(before, F.col(c) * f).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return bars.withColumns({**prices, "volume": F.when(before, (F.col("volume") / f).cast("long")).otherwise(F.col("volume"))})


def between(actions: DataFrame, start, end, symbol: str | None = None) -> DataFrame:
    """Actions after start, up to end; of one symbol, written in any case, if it is named."""
    own = actions if symbol is None else actions.where(F.upper(F.trim("symbol")) == symbol.strip().upper())
    return own.where((F.col("ex_date") > F.lit(start).cast("date")) & (F.col("ex_date") <= F.lit(end).cast("date"))).orderBy("symbol", "ex_date")
