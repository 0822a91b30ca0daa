"""Ordered scans without a global window: buckets of the order column are scanned apart, then a small table of bucket
summaries carries the state across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the order column's range that one bucket spans.
BUCKET = 1 << 18


def _bucket(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size).cast("long")


def ordered_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds the last non-null value before each row (itself excluded), within keys, by order.

    order[0] is a dense integer; further columns break ties. A window without keys would run in one task; here a task has
    one bucket of one key, so hot keys are spread too."""
    d = df.withColumn("_value", value).withColumn("_bucket", _bucket(order[0], bucket))
    local = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_local", F.last("_value", ignorenulls=True).over(local))
    ends = d.where(F.col("_value").isNotNull()).groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    across = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_bucket")
    # of the buckets that have a value, each hands it to the rows up to the next such bucket
    reach = ends.withColumn("_until", F.lead("_bucket").over(across)).withColumn("_from", F.col("_bucket") + 1)
    wanted = d.select(*keys, "_bucket").distinct()
    carry = reach.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_from", "_until", "_end")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # wanted and carry are summaries; a window over both replaces an interval join
    marks = carry.select(*[F.col(f"_k_{k}").alias(k) for k in keys], (F.col("_from") - 1).alias("_bucket"), "_end", F.lit(1).alias("_side"))
    asks = wanted.select(*keys, "_bucket", F.lit(None).cast(dict(carry.dtypes)["_end"]).alias("_end"), F.lit(0).alias("_side"))
    line = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_bucket", "_side").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.unionByName(asks).withColumn("_carry", F.last("_end", ignorenulls=True).over(line)).where("_side = 0").drop("_end", "_side")
    back = carried.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_bucket").alias("_c_bucket"), "_carry")
    on = F.col("_bucket") == F.col("_c_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return d.join(back, on, "left").withColumn(name, F.coalesce("_local", "_carry")).drop("_value", "_bucket", "_local", "_carry", "_c_bucket", *[f"_c_{k}" for k in keys])


def ordered_depth(df: DataFrame, order: list[str], step: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds the running sum of step (+1, 0, -1), clamped so that it never falls below zero, up to and with each row.

    The clamped sum is S - min(0, least S so far); a bucket's summary is its sum and its least prefix sum."""
    d = df.withColumn("_step", step).withColumn("_bucket", _bucket(order[0], bucket))
    local = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_sum", F.sum("_step").over(local))
    d = d.withColumn("_least", F.min("_sum").over(local))
    ends = d.groupBy("_bucket").agg(F.sum("_step").alias("_all"), F.min("_sum").alias("_low"))
    across = W.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_all").over(across), F.lit(0)))
    ends = ends.withColumn("_low_before", F.coalesce(F.min(F.col("_before") + F.col("_low")).over(across), F.lit(0)))
    back = ends.select(F.col("_bucket").alias("_b"), "_before", "_low_before")
    d = d.join(back, d["_bucket"] == back["_b"])
    total = F.col("_before") + F.col("_sum")
    least = F.least(F.lit(0), F.col("_low_before"), F.col("_before") + F.col("_least"))
    return d.withColumn(name, (total - least).cast("long")).drop("_step", "_bucket", "_sum", "_least", "_b", "_before", "_low_before")
