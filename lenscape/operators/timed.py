"""Joins by key and time: the last state before an event, and the intervals that an event falls into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import checkpointed

#: Rows of both sides that a part of a sort holds, about.
ROWS = 1_000_000


def as_of(left: DataFrame, right: DataFrame, on: str, at: str, right_at: str | None = None, prefix: str = "right_", strict: bool = False, parts: int | None = None) -> DataFrame:
    """Every row of left with the columns of the last row of right (prefixed) that has the same `on` and a time not after
    its own (strict: before it); nulls where there is none, or where key or time is null. Of equal times in right the row that
    sorts last counts, so that the result is the same each time.

    Both sides are merged by one sort into parts of key and time, in which the last row of right is carried on; a key that
    lies in several parts carries its last row from part to part. So a key with very many rows is cut by time, and no group
    has to fit in a task."""
    right_at = right_at or at
    columns = right.columns
    value = F.struct(*(F.col(c) for c in columns))
    lower = left.withColumn("_l", F.struct(*(F.col(c) for c in left.columns)))
    both = lower.select(F.col(on).alias("_k"), F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_s"), "_l", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_r"))
    some = right.where(F.col(on).isNotNull() & F.col(right_at).isNotNull())
    other = some.select(F.col(on).alias("_k"), F.col(right_at).alias("_t"), F.lit(1 if strict else 0).alias("_s"), F.lit(None).cast(lower.schema["_l"].dataType).alias("_l"), value.alias("_r"))
    merged = both.unionByName(other)
    n = parts or max(1, merged.count() // ROWS + 1)
    dealt = merged.repartitionByRange(n, "_k", "_t", "_s").withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)  # another sampling would draw other parts
    within = Window.partitionBy("_part", "_k").orderBy("_t", "_s", "_r").rowsBetween(Window.unboundedPreceding, 0)
    carried = dealt.withColumn("_own", F.last("_r", ignorenulls=True).over(within)).where("_l IS NOT NULL")
    tails = dealt.groupBy("_part", "_k").agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).alias("_tail"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a key
    brought = tails.withColumn("_brought", F.last("_tail._r", ignorenulls=True).over(before)).where("_brought IS NOT NULL").select("_part", "_k", "_brought")
    found = carried.join(brought, ["_part", "_k"], "left").withColumn("_v", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_brought")))
    return found.select("_l.*", *(F.col(f"_v.`{c}`").alias(f"{prefix}{c}") for c in columns))


def within(points: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str) -> DataFrame:
    """Every pair of a point and an interval (columns of both; `on` once) with the same key and start <= at < end; times are
    whole numbers.

    An interval is filed at the level of its length, by the one or two cells of 2^level that it touches; a point is looked up
    in its cell of every level that occurs (64 at most). Keys are cut by time that way, and long intervals take no more rows
    than short ones."""
    length = F.col(end) - F.col(start)
    filed = intervals.where((length > 0) & F.col(on).isNotNull()).withColumn("_level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    levels = [r[0] for r in filed.select("_level").distinct().collect()]  # 64 at most
    cell = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    last = F.floor((F.col(end) - 1) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    filed = filed.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(start, F.col("_level")), last))))
    asked = points.where(F.col(on).isNotNull() & F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    asked = asked.withColumn("_cell", cell(at, F.col("_level")))
    return asked.join(filed, [on, "_level", "_cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_cell")
