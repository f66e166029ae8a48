"""The fold of progress events with keyed state.

State is kept for each run, task and shard of photos: an entry a photo (seen, and how it ended) in a map that expires, and
one row of sums. A batch reads and writes the entries of its own photos only, and the shards of a run are separate groups,
so that a run with most of the events is no single one. What a batch changes comes out as partial rows, which add up:
`state_of` makes of them what operators.progress.fold makes of all events.

A photo counts once, with the status of the event of the smallest seq, and numbers that tasks report themselves are those of
the largest, whatever the order of arrival. Only whether the last photo came after the last own number of an embedding task
is told by each photo's event that arrived first. Events of other kinds and of
unknown tasks change nothing. With `keep`, a photo or a run that no event has named for so long is forgotten; a photo that
is named again counts again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import TASKS
from ..workers import find_package

SHARDS = 16
SUMS = ("items", "failed", "item_at", "current", "current_at", "total", "total_at", "scan_total", "scan_at")
PARTIAL = "run string, task_type string, shard int, " + ", ".join(f"{c} long" for c in SUMS)


class PhotoFold(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.photos = handle.getMapState("photos", "photo_id long", "seq long, failed boolean", self.keep_ms)
        self.sums = handle.getValueState("sums", ", ".join(f"{c} long" for c in SUMS), self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.sums.get()
        now = dict(zip(SUMS, known if known is not None else (0, 0, *(None,) * 7), strict=True))
        first: dict[int, tuple[int, bool]] = {}  # photos of this batch
        for part in rows:
            for name, at in (("current", "current_at"), ("total", "total_at"), ("scan_total", "scan_at")):
                own = part[part[f"takes_{name}"]]
                if len(own):
                    seq = own["seq"].astype("int64")
                    latest = int(seq.max())
                    if now[at] is None or latest >= now[at]:
                        now[name], now[at] = int(own.loc[seq.idxmax(), "total" if name == "scan_total" else name]), latest
            named = part[part["counts"]]
            for photo, seq, failed in zip(named["photo_id"].astype("int64").tolist(), named["seq"].astype("int64").tolist(), named["failed"].tolist(), strict=True):
                if photo not in first or seq < first[photo][0]:
                    first[photo] = seq, failed
        for photo, (seq, failed) in first.items():
            known = self.photos.getValue((photo,)) if self.photos.containsKey((photo,)) else None
            if known is None:
                now["items"] += 1
                now["failed"] += failed
                now["item_at"] = max(seq, now["item_at"] or seq)
                self.photos.updateValue((photo,), (seq, bool(failed)))
            elif seq < known[0]:  # it arrives late
                now["failed"] += int(failed) - int(known[1])
                self.photos.updateValue((photo,), (seq, bool(failed)))
            elif self.keep_ms is not None:
                self.photos.updateValue((photo,), known)  # it stays for as long again
        self.sums.update(tuple(None if now[c] is None else int(now[c]) for c in SUMS))
        yield pd.DataFrame([(*key, *(now[c] for c in SUMS))], columns=[c.split()[0] for c in PARTIAL.split(", ")]).astype({c: "Int64" for c in SUMS})

    def close(self) -> None:
        pass


def partials(stream: DataFrame, run: str = "job_id", keep_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """The partial rows that each batch of events changes. run: the column that tells runs apart. With keep_ms the stream
    makes batches for expiry too: give it a trigger of some seconds, and end it by stopping it."""
    find_package(stream.sparkSession)
    scan, emb, photo = F.col("task_type") == "scan", F.col("task_type") == "embedding", F.col("photo_id")
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = stream.where((F.col("event_type") == "progress") & F.col("task_type").isin(*TASKS)).select(
        F.col(run).alias("run"), "task_type", F.pmod(F.coalesce(photo, "seq"), F.lit(shards)).cast("int").alias("shard"), "seq", "current", "total", "photo_id",
        yes(F.col("current").isNotNull() & (scan | emb & photo.isNull())).alias("takes_current"),
        yes(F.col("total").isNotNull() & (scan | emb)).alias("takes_total"),
        yes(scan & (F.col("total") > 0)).alias("takes_scan_total"),
        yes(~scan & (photo != 0)).alias("counts"),
        yes(F.col("status") == "failed").alias("failed"),
    )
    grouped = own.groupBy("run", "task_type", "shard")
    mode = "None" if keep_ms is None else "ProcessingTime"
    return grouped.transformWithStateInPandas(statefulProcessor=PhotoFold(keep_ms), outputStructType=PARTIAL, outputMode="Update", timeMode=mode)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in the store that maps and expiry need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept_in(stream: DataFrame, folder: str, mode: str = "update"):
    """A writer that keeps each batch's rows as a table in `folder`, by the batch's number: a batch that runs again takes the
    place of its rows."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(each).outputMode(mode)


def kept(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches, with their batch's number."""
    return spark.read.schema(f"{schema}, batch long").parquet(folder)


def latest(rows: DataFrame) -> DataFrame:
    """The last partial row of each run, task and shard."""
    order = Window.partitionBy("run", "task_type", "shard").orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "batch")


def state_of(rows: DataFrame) -> DataFrame:
    """run, task_type, current, total, items and failed of the latest partial rows: a row for each run and task."""
    last = lambda c, at: F.max_by(c, at).alias(c)
    by_task = rows.groupBy("run", "task_type").agg(
        F.sum("items").alias("items"), F.sum("failed").alias("failed"), F.max("item_at").alias("item_at"),
        last("current", "current_at"), F.max("current_at").alias("current_at"), last("total", "total_at"), F.max("total_at").alias("total_at"),
        last("scan_total", "scan_at"), F.max("scan_at").alias("scan_at"),
    )
    runs = by_task.groupBy("run").agg(F.max("scan_total").alias("shared"), F.max("scan_at").alias("shared_at"))  # of the scan only
    every = runs.select("*", F.explode(F.array(*map(F.lit, TASKS))).alias("task_type"))
    both = every.join(by_task, ["run", "task_type"], "left")
    at = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    zero = F.lit(0).cast("long")
    item_later = F.col("item_at").isNotNull() & (F.col("item_at") > at("current_at"))
    shared_later = (F.col("task_type") != "scan") & F.col("shared_at").isNotNull() & (F.col("shared_at") > at("total_at"))
    return both.select(
        "run",
        "task_type",
        F.coalesce(F.when(item_later, F.col("items")).otherwise(F.col("current")), zero).alias("current"),
        F.coalesce(F.when(shared_later, F.col("shared")).otherwise(F.col("total")), zero).alias("total"),
        F.coalesce("items", zero).alias("items"),
        F.coalesce("failed", zero).alias("failed"),
    )
