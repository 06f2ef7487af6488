"""As-of join by one sorted merge: both sides in one order, the last value carried to the rows behind it.

A side is never multiplied by the other: the union of both is sorted once by series and time. Long series are cut into blocks of
time; a block opens with the last value of the blocks before it, so that no series is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, value: Column, name: str, forward: bool = False, strict: bool = True, block: str = "year") -> DataFrame:
    """left with ``name``: value of the row of right with equal keys that is the last before left_at, or with forward the first after it.

    strict leaves out rows of right at the very time; otherwise they count. Of rows of right at one time the greatest value
    counts, so repeated rows change nothing. Null keys are equal to each other; a row without a time has no match. block is a
    unit of date_trunc.
    """
    own, kind = [F.col(k) for k in keys], right.select(value.alias("v")).schema["v"].dataType
    row = F.struct(*(F.col(c) for c in left.columns))
    rows = left.select(*own, left_at.cast("timestamp").alias("_at"), row.alias("_row"), F.lit(None).cast(kind).alias("_v"), F.lit(False).alias("_r"))
    seen = right.select(*own, right_at.cast("timestamp").alias("_at"), value.alias("_v")).where("_at IS NOT NULL").groupBy(*own, "_at").agg(F.max("_v").alias("_v"))
    seen = seen.select(*keys, "_at", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_v", F.lit(True).alias("_r"))
    both = rows.unionByName(seen).withColumn("_block", F.date_trunc(block, F.col("_at")))
    # at one time a strict search meets the row of left before those of right, whichever way it goes
    at = lambda c: F.desc(c) if forward else F.asc(c)
    tie = F.col("_r") if strict else ~F.col("_r")
    before = W.partitionBy(*keys, "_block").orderBy(at("_at"), tie).rowsBetween(W.unboundedPreceding, 0)
    held = F.struct(F.col("_v").alias("v"))
    both = both.withColumn("_last", F.last(F.when(F.col("_r"), held), ignorenulls=True).over(before))
    pick = F.min_by if forward else F.max_by
    blocks = both.groupBy(*keys, "_block").agg(pick(F.when(F.col("_r"), held), F.when(F.col("_r"), F.col("_at"))).alias("_end"))
    chain = W.partitionBy(*keys).orderBy(at("_block")).rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    opening = blocks.select(*(F.col(k).alias(n) for k, n in names.items()), F.col("_block").alias("_b"), F.last("_end", ignorenulls=True).over(chain).alias("_open"))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    met = both.where(~F.col("_r")).join(opening, [*on, F.col("_block") == F.col("_b")], "left")
    found = F.coalesce("_last", "_open")["v"]
    return met.select("_row.*", F.when(F.col("_at").isNotNull(), found).alias(name))
