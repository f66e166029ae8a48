"""Writes to the catalog: an upsert by path, and sidecars that are replaced row by row. Each is a function from tables to
the next version of a table; `store` publishes versions, so readers see the old or the new one as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .navigation import numbered

#: Columns that a rescan replaces; id, path and created_at stay.
REPLACED = ("name", "size", "modified_at", "width", "height", "mime_type", "is_raw", "raw_format", "raw_status", "raw_error")


def seconds(ms: Column) -> Column:
    """A file time in milliseconds as the catalog keeps it: whole seconds, rounded down."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def accepted(results: DataFrame) -> DataFrame:
    return results.where("success")


def rejected(results: DataFrame) -> DataFrame:
    """What the catalog does not take, with the reason."""
    return results.where(~F.col("success")).select("path", "name", "is_raw", "raw_status", F.coalesce("raw_error", "error").alias("error"))


def last_of_path(results: DataFrame) -> DataFrame:
    """One result a path: of several the latest modified one."""
    order = Window.partitionBy("path").orderBy(F.desc("modified_ms"), F.desc("size"), "name")
    return results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(catalog: DataFrame, results: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """The next catalog. Files that are known keep id and creation time and wait for a new embedding; new ones get the
    ids that follow, in order of path. One outer join by path; ids are given without a global sort into one task.
    top: one row with the largest id (column _top), where catalog is a part of the whole one."""
    new = last_of_path(accepted(results)).select(
        "path", "name", "size", seconds(F.col("created_ms")).alias("created_at"), seconds(F.col("modified_ms")).alias("modified_at"),
        "width", "height", "mime_type", "is_raw", "raw_format", "raw_status", "raw_error",
        F.when(F.length("phash") > 0, "completed").otherwise("failed").alias("phash_status"),
    )
    n = F.struct(*[c for c in new.columns if c != "path"])
    o = F.struct(*[c for c in catalog.columns if c != "path"])
    both = catalog.select("path", o.alias("o")).join(new.select("path", n.alias("n")), "path", "full")
    kept = both.where("o is not null")
    rescanned = F.col("n").isNotNull()
    state = {"thumbnail_status": F.lit("completed"), "embedding_status": F.lit("pending"), "phash_status": F.col("n.phash_status")}

    def value(c: str) -> Column:
        if c in REPLACED:
            return F.when(rescanned, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        if c in state:
            return F.when(rescanned, state[c]).otherwise(F.col(f"o.{c}")).alias(c)
        return F.col(c if c == "path" else f"o.{c}").alias(c)

    old = kept.select(*(value(c) for c in catalog.columns))
    fresh = new.join(catalog.select("path"), "path", "left_anti")
    if top is None:
        top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = numbered(fresh, "path").crossJoin(F.broadcast(top)).select(
        *(
            (F.col("_top") + F.col("index") + 1).alias("id") if c == "id" else state[c].alias(c) if c in state and c != "phash_status" else F.col(c)
            for c in catalog.columns
        )
    )
    return old.unionByName(added)


def replaced(sidecar: DataFrame, rows: DataFrame) -> DataFrame:
    """A sidecar after rows: theirs replace those of the same photo, all others stay."""
    return sidecar.join(rows.select("photo_id"), "photo_id", "left_anti").unionByName(rows.select(*sidecar.columns))


def exif_rows(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """EXIF rows of the results that have any; files without keep what they had."""
    found = last_of_path(accepted(results)).where("exif is not null").select("path", "exif")
    return found.join(catalog.select("id", "path"), "path").select(F.col("id").alias("photo_id"), "exif.*")


def hash_rows(catalog: DataFrame, results: DataFrame, at: Column | None = None, algorithm: str = "double_gradient_8x8") -> DataFrame:
    found = last_of_path(accepted(results)).where("length(phash) > 0").select("path", "phash")
    return found.join(catalog.select("id", "path"), "path").select(
        F.col("id").alias("photo_id"), F.col("phash").alias("hash"), F.lit(algorithm).alias("algorithm"),
        (F.current_timestamp() if at is None else at).alias("created_at"),
    )


def with_status(catalog: DataFrame, outcome: DataFrame, column: str) -> DataFrame:
    """catalog with a status column set from outcome (photo_id, ok); other rows keep theirs."""
    marks = outcome.groupBy(F.col("photo_id").alias("id")).agg(F.bool_or("ok").alias("_ok"))
    joined = catalog.join(marks, "id", "left")
    done = F.when(F.col("_ok"), "completed").when(~F.col("_ok"), "failed").otherwise(F.col(column))
    return joined.select(*(done.alias(c) if c == column else F.col(c) for c in catalog.columns))


def save_embeddings(catalog: DataFrame, sidecar: DataFrame, batch: DataFrame, model: str = "clip-vit-b32") -> tuple[DataFrame, DataFrame]:
    """batch: photo_id and embedding (null: it failed). The next catalog and sidecar: failures keep their old vector."""
    made = batch.where("embedding is not null").select(
        "photo_id", "embedding", F.lit(model).alias("model_version"), F.current_timestamp().alias("created_at")
    )
    outcome = batch.select("photo_id", F.col("embedding").isNotNull().alias("ok"))
    return with_status(catalog, outcome, "embedding_status"), replaced(sidecar, made)


def save_hashes(catalog: DataFrame, sidecar: DataFrame, batch: DataFrame, algorithm: str = "double_gradient_8x8") -> tuple[DataFrame, DataFrame]:
    """batch: photo_id and hash (null: it failed)."""
    made = batch.where("hash is not null").select(
        "photo_id", "hash", F.lit(algorithm).alias("algorithm"), F.current_timestamp().alias("created_at")
    )
    return with_status(catalog, batch.select("photo_id", F.col("hash").isNotNull().alias("ok")), "phash_status"), replaced(sidecar, made)


def saved_rows(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """What a save tells its caller about each file: the row, its EXIF as scanned, and for raw files "converted"."""
    own = last_of_path(accepted(results)).select(
        "path", "name", "size", seconds(F.col("created_ms")).alias("created_at"), seconds(F.col("modified_ms")).alias("modified_at"),
        "width", "height", "mime_type", "is_raw", "raw_format", F.when(F.col("is_raw"), "converted").alias("raw_status"), "exif",
    )
    return catalog.select("id", "path").join(own, "path")


class Store:
    """Versions of a table in a folder; the newest complete one is read. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, schema) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{versions[-1]:06d}")

    def write(self, rows: DataFrame) -> int:
        version = (self._versions() or [0])[-1] + 1
        rows.write.parquet(f"{self.path}/v{version:06d}")
        return version
