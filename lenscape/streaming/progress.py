"""The progress of jobs as streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, TASKS

#: How the queues run: at most so many jobs at once, each of them in a scheduler pool of its own.
POOLS = {"scan": 1, "phash": 4, "embedding": 1}
EMBEDDING_BATCH = 16
POLL = "100 milliseconds"


def events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The stream of event files in a folder; other sources need only give the columns of schema.EVENT."""
    return spark.readStream.format(fmt).schema(EVENT).options(**options).load(path)


def merged(*queues: DataFrame) -> DataFrame:
    """The events of several queues in one stream."""
    out = queues[0]
    for q in queues[1:]:
        out = out.unionByName(q)
    return out


def empty_state() -> dict:
    return {t: {"current": 0, "total": 0, "items": {}} for t in TASKS}


def apply_event(state: dict, e: dict) -> dict:
    """One step of the fold that operators.progress.fold does for a whole table."""
    task = e["task_type"]
    if e["event_type"] != "progress" or task not in state:
        return state
    own = state[task]
    if task == "scan":
        own["current"] = e["current"] if e["current"] is not None else own["current"]
        own["total"] = e["total"] if e["total"] is not None else own["total"]
        if e["total"]:
            for other in TASKS:
                if other != "scan" and e["total"] > 0:
                    state[other]["total"] = e["total"]
    elif e["photo_id"]:
        key = str(e["photo_id"])
        if task == "embedding" and e["total"] is not None:
            own["total"] = e["total"]
        if key not in own["items"]:
            own["items"][key] = int(e["status"] == "failed")
            own["current"] = len(own["items"])
    elif task == "embedding":
        own["current"] = e["current"] if e["current"] is not None else own["current"]
        own["total"] = e["total"] if e["total"] is not None else own["total"]
    return state


STATE = "run string, task_type string, current long, total long, items long, failed long"


def folded(stream: DataFrame, run: str = "job_id") -> DataFrame:
    """After every batch, the state of each task of the runs it touched. run: the column that tells runs apart; a run's
    events are folded in the order of seq within a batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else empty_state()
        rows = pd.concat(list(batches)).sort_values("seq")
        for e in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            for c in ("current", "total", "photo_id"):
                e[c] = None if e[c] is None else int(e[c])
            now = apply_event(now, e)
        state.update((json.dumps(now),))
        yield pd.DataFrame(
            [(key[0], t, s["current"], s["total"], len(s["items"]), sum(s["items"].values())) for t, s in now.items()],
            columns=["run", "task_type", "current", "total", "items", "failed"],
        )

    return stream.groupBy(run).applyInPandasWithState(update, STATE, "state string", "update", "NoTimeout")


def appended(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Photos of scan events, each once: what a cached list appends. late: forget ids after so long (by ts)."""
    photos = stream.where("task_type = 'scan' AND event_type = 'progress' AND phase = 'processing' AND photo_id IS NOT NULL")
    photos = photos.select(F.col("photo_id").alias("id"), "path", "ts")
    if late:
        return photos.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    return photos.dropDuplicates(["id"])


def on_completed(stream: DataFrame, refresh: Callable[[], None], task: str = "scan"):
    """A writer that calls refresh after each batch in which a job of the task completed."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.where((F.col("task_type") == task) & (F.col("event_type") == "completed")).limit(1).count():
            refresh()

    return stream.writeStream.foreachBatch(each)


def delivered(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, poll: str = POLL):
    """A writer that hands every batch to sink, at the clients' pace; what was handed over is known from the checkpoint."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=poll)


def windowed(stream: DataFrame, size: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of events by task, kind and window. Beyond the reference: it has no windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        stream.withWatermark("ts", late).groupBy(window, "task_type", "event_type").agg(F.count(F.lit(1)).alias("events"))
        .select("window.start", "window.end", "task_type", "event_type", "events")
    )


def in_pool(spark: SparkSession, task: str) -> None:
    """Jobs that this thread starts from now on run in the task's pool (see POOLS)."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", task)


def pools_file(path: str) -> str:
    """Writes a fair-scheduler file with a pool a task, its weight the number of jobs at once. Gives the path."""
    pools = "".join(f'<pool name="{t}"><schedulingMode>FIFO</schedulingMode><weight>{n}</weight><minShare>0</minShare></pool>' for t, n in POOLS.items())
    with open(path, "w") as f:
        f.write(f'<?xml version="1.0"?><allocations>{pools}</allocations>')
    return path
