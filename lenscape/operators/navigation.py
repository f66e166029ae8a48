"""Ordered lists: places, neighbours, ranges and selections.

A list's order is a global one. `numbered` gives places without moving the list into one task: rows are sorted into
ranges, counted by range, and numbered within; everything else is expressed over these places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import checkpointed


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with index (from 0) and n (their number) in the order of columns; the columns should tell rows apart.

    One sort by ranges; rows are numbered within their partition, and partitions by a sum over their sizes. The sorted
    rows are kept, as a second sort might draw other borders."""
    names = order or ("id",)
    kept = checkpointed(rows.orderBy(*names).withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    totals = sizes.select(
        "_part",
        (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias("n"),
    )
    numbers = kept.withColumn("_part", part).join(F.broadcast(totals), "_part")
    return numbers.select(*rows.columns, (F.col("_before") + at).alias("index"), "n")


def neighbours(rows: DataFrame, *order: str) -> DataFrame:
    """id, index, prev_id and next_id (the row itself at the ends), has_prev, has_next and position "i / n"."""
    own = numbered(rows, *order).select("id", "index", "n")
    before = own.select((F.col("index") + 1).alias("index"), F.col("id").alias("_prev"))
    after = own.select((F.col("index") - 1).alias("index"), F.col("id").alias("_next"))
    joined = own.join(before, "index", "left").join(after, "index", "left")
    return joined.select(
        "id",
        "index",
        F.coalesce("_prev", "id").alias("prev_id"),
        F.coalesce("_next", "id").alias("next_id"),
        (F.col("index") > 0).alias("has_prev"),
        (F.col("index") < F.col("n") - 1).alias("has_next"),
        F.concat_ws(" / ", (F.col("index") + 1).cast("string"), F.col("n").cast("string")).alias("position"),
    )


def navigate(rows: DataFrame, active: int | None, direction: str, *order: str) -> DataFrame:
    """The row before or after the active one, itself at the ends; without an active one the first (next) or last (prev)."""
    if direction not in ("prev", "next"):
        raise ValueError("prev or next")
    down = direction == "prev"
    names = order or ("id",)
    sort = [F.desc(c) if down else F.asc(c) for c in names]
    if active is None:
        return rows.orderBy(*(F.asc(c) if not down else F.desc(c) for c in names)).limit(1)
    at = rows.where(F.col("id") == active).select(F.struct(*names).alias("_at")).limit(1)
    key = F.struct(*names)
    beyond = rows.crossJoin(F.broadcast(at)).where(key <= F.col("_at") if down else key >= F.col("_at"))
    # the active row comes first, then its neighbour
    two = beyond.orderBy(*sort).limit(2).drop("_at")
    back = [F.asc(c) if down else F.desc(c) for c in names]
    return two.orderBy(*back).limit(1)


def ranged(rows: DataFrame, first: int, last: int, *order: str) -> DataFrame:
    """Rows between two places, both included, whichever comes first."""
    low, high = min(first, last), max(first, last)
    return numbered(rows, *order).where(F.col("index").between(low, high)).select(*rows.columns)


def at_index(rows: DataFrame, index: int, *order: str) -> DataFrame:
    """The row at a place; none outside the list."""
    return numbered(rows, *order).where(F.col("index") == index).select(*rows.columns)


def toggled(selected: DataFrame, ids: DataFrame) -> DataFrame:
    """Selected ids, but each given id the other way round."""
    both = selected.select("id", F.lit(1).alias("n")).unionByName(ids.select("id", F.lit(1).alias("n")))
    return both.groupBy("id").agg(F.sum("n").alias("n")).where("n = 1").select("id")


def select(rows: DataFrame, how: str, id_: int | None = None) -> DataFrame:
    """all, single (an id) or clear: the ids that are selected then."""
    ids = rows.select("id")
    if how == "all":
        return ids
    return ids.where(F.col("id") == id_) if how == "single" else ids.where(F.lit(False))


def default_active(rows: DataFrame, selected: DataFrame, *order: str) -> DataFrame:
    """The first selected row in list order; the first of all if none is selected."""
    marks = selected.select("id").distinct().withColumn("_on", F.lit(True))
    names = order or ("id",)
    return rows.join(marks, "id", "left").orderBy(F.col("_on").isNull(), *names).limit(1).drop("_on")


def selection_counts(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """selected_count and has_selection."""
    return selected.select("id").distinct().agg(F.count(F.lit(1)).alias("selected_count")).withColumn(
        "has_selection", F.col("selected_count") > 0
    )
