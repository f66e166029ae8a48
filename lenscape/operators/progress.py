"""Job progress: counts by queue and state, and the fold of events into the state of each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STATES, TASKS


def _tasks(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in TASKS))).alias("task_type"))


def empty(spark) -> DataFrame:
    """The state before any event."""
    zero = F.lit(0).cast("long")
    return _tasks(spark).select("task_type", *(zero.alias(c) for c in ("current", "total", "items", "failed")))


def job_counts(jobs: DataFrame) -> DataFrame:
    """jobs: task_type and state. A row for each task and a column for each state, zeros included."""
    counted = jobs.groupBy("task_type").agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    return _tasks(jobs.sparkSession).join(F.broadcast(counted), "task_type", "left").na.fill(0)


def outcomes(results: DataFrame) -> DataFrame:
    """processed, successful and failed of processing results (column success)."""
    return results.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("success").alias("successful"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed")
    )


def active_jobs(jobs: DataFrame) -> DataFrame:
    """task_type, state and job_id of jobs that run or wait."""
    return jobs.where(F.col("state").isin("active", "waiting", "delayed")).select("task_type", "state", "job_id")


def of_tasks(events: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """Events of some tasks; None: of all."""
    return events if tasks is None else events.where(F.col("task_type").isin(list(tasks)))


def fold(events: DataFrame) -> DataFrame:
    """task_type, current, total, items and failed after all events in the order of seq.

    scan: the last current and total that are given; a total above 0 is also that of the other tasks. phash and
    embedding: each photo counts once, with its first status, and current is their number then; embedding also takes
    the current and total that it reports itself, whichever came last.

    Aggregations with partial sums only: photos are reduced to one row each first, then everything to a row a task."""
    p = events.where("event_type = 'progress'")
    at = F.col("seq")
    latest = lambda c, cond: F.max_by(c, F.when(cond, at))
    scan, emb = F.col("task_type") == "scan", F.col("task_type") == "embedding"
    given = F.col("current").isNotNull() & (scan | emb & F.col("photo_id").isNull())
    totals = F.col("total").isNotNull() & (scan | emb)
    by_task = p.groupBy("task_type").agg(
        latest("current", given).alias("current"),
        F.max(F.when(given, at)).alias("current_at"),
        latest("total", totals).alias("total"),
        F.max(F.when(totals, at)).alias("total_at"),
        latest("total", scan & (F.col("total") > 0)).alias("shared_total"),
        F.max(F.when(scan & (F.col("total") > 0), at)).alias("shared_at"),
    )
    photos = (
        p.where(~scan & (F.col("photo_id") != 0))
        .groupBy("task_type", "photo_id")
        .agg(F.min("seq").alias("first_at"), F.min_by("status", "seq").alias("status"))
        .groupBy("task_type")
        .agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("first_at").alias("item_at"))
    )
    shared = by_task.agg(F.max("shared_total").alias("scan_total"), F.max("shared_at").alias("scan_at"))
    rows = (
        _tasks(events.sparkSession)
        .join(F.broadcast(by_task.drop("shared_total", "shared_at")), "task_type", "left")
        .join(F.broadcast(photos), "task_type", "left")
        .crossJoin(F.broadcast(shared))
    )
    item_later = F.col("item_at").isNotNull() & (F.col("current_at").isNull() | (F.col("item_at") > F.col("current_at")))
    other = F.col("task_type") != "scan"
    shared_later = other & F.col("scan_at").isNotNull() & (F.col("total_at").isNull() | (F.col("scan_at") > F.col("total_at")))
    zero = F.lit(0).cast("long")
    return rows.select(
        "task_type",
        F.coalesce(F.when(item_later, F.col("items")).otherwise(F.col("current")), zero).alias("current"),
        F.coalesce(F.when(shared_later, F.col("scan_total")).otherwise(F.col("total")), zero).alias("total"),
        F.coalesce("items", zero).alias("items"),
        F.coalesce("failed", zero).alias("failed"),
    )


def totals(state: DataFrame) -> DataFrame:
    """current and total of all tasks together, and whether any has work left."""
    return state.agg(
        F.sum("current").alias("current"),
        F.sum("total").alias("total"),
        F.coalesce(F.bool_or((F.col("total") > 0) & (F.col("current") < F.col("total"))), F.lit(False)).alias("active"),
    )


def percent(current, total):
    """Whole percent, 0 of nothing."""
    return F.when(total > 0, F.floor(current * 100 / total + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def distinct_items(events: DataFrame) -> DataFrame:
    """task_type, photo_id and first status of every photo that an event names."""
    named = events.where("event_type = 'progress' AND photo_id <> 0 AND task_type <> 'scan'")
    return named.groupBy("task_type", "photo_id").agg(
        F.when(F.min_by("status", "seq") == "failed", "failed").otherwise("completed").alias("status")
    )


def retained(jobs: DataFrame, completed: int = 100, failed: int = 50) -> DataFrame:
    """The latest finished jobs of each task: so many completed ones, so many failed ones, and all others. The window's
    rank limit is applied before rows are dealt out, so a task keeps few rows of each group."""
    order = Window.partitionBy("task_type", "state").orderBy(F.desc("seq"))
    most = max(completed, failed)
    done = jobs.where(F.col("state").isin("completed", "failed")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    done = done.where(F.col("_n") <= F.when(F.col("state") == "completed", completed).otherwise(failed)).drop("_n")
    return done.unionByName(jobs.where(~F.coalesce(F.col("state").isin("completed", "failed"), F.lit(False))))


def retry_delays(attempts: int = 3, first_ms: int = 1000) -> list[int]:
    """Waiting times before each further attempt: doubled each time."""
    return [first_ms << i for i in range(attempts - 1)]


def debounced(events: DataFrame, wait_ms: int, *keys: str) -> DataFrame:
    """Of events of a key that follow one another within wait_ms the last."""
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    following = F.unix_millis(F.lead("ts").over(order).cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    return events.withColumn("_gap", following).where(F.col("_gap").isNull() | (F.col("_gap") >= wait_ms)).drop("_gap")
