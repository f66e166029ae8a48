"""Tables that are changed in place by key: the catalog and the folder tree.

A kept table is a Parquet table partitioned by `slot`, a hash of its key, and bucketed and sorted by the key within each
slot. A batch of changes is joined to the slots it touches, where their buckets lie: only the batch is shuffled. The touched
slots are then rewritten (dynamic partition overwrite), and no file of any other slot is.

A rewrite first goes to a journal beside the table. Opening a table finishes a rewrite whose journal is complete, so that a
driver that is lost between the two leaves the rows before or after the batch. One writer at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PHOTOS
from ..workers import checkpointed, remove
from . import upsert as rules

SLOTS, BUCKETS = 64, 8


@contextmanager
def _dynamic(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class KeptTable:
    """A table with one row per key below `root`, a folder that all executors share. The numbers of slots and buckets are
    kept there: those given are for a new table."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, slots: int = SLOTS, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key = spark, root, schema, key
        self.slots, self.buckets = self._layout(slots, buckets)
        self.name = "kept_" + uuid.uuid5(uuid.NAMESPACE_URL, root).hex
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, slot INT) USING parquet PARTITIONED BY (slot) "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{root}/rows'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")
        self._finish()

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _layout(self, slots: int, buckets: int) -> tuple[int, int]:
        """As the name of a file in root says; it is made for a new table."""
        fs, folder = self._files(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        known = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("_layout-")]
        if not known:
            fs.create(self._files(f"{self.root}/_layout-{slots}-{buckets}")[1]).close()
            fs.mkdirs(self._files(f"{self.root}/rows")[1])
        return known[0] if known else (slots, buckets)

    def slot(self, key) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def rows(self, slots: list[int] | None = None) -> DataFrame:
        """The rows of some slots; of all for None."""
        table = self.spark.table(self.name)
        return (table if slots is None else table.where(F.col("slot").isin(slots))).drop("slot")

    def touched(self, keys: DataFrame) -> list[int]:
        """The slots of keys: `slots` numbers at most."""
        return sorted(r[0] for r in keys.select(self.slot(self.key)).distinct().collect())

    def publish(self, rows: DataFrame, touched: list[int]) -> None:
        """rows are all that the touched slots hold from now on. They may be made of what these hold now."""
        journal = f"{self.root}/journal"
        remove(self.spark, journal)
        own = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema), self.slot(self.key).alias("slot"))
        own.write.parquet(f"{journal}/rows")
        self.spark.createDataFrame([(s,) for s in touched], "slot int").coalesce(1).write.parquet(f"{journal}/touched")
        self._finish()

    def _finish(self) -> None:
        journal = f"{self.root}/journal"
        fs, mark = self._files(f"{journal}/touched/_SUCCESS")
        if not fs.exists(mark):
            return
        touched = {r.slot for r in self.spark.read.schema("slot int").parquet(f"{journal}/touched").collect()}
        schema = T.StructType([*self.schema.fields, T.StructField("slot", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{journal}/rows")
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
        with _dynamic(self.spark):
            rows.repartition("slot", bucket).write.mode("overwrite").insertInto(self.name)
        left = {r.slot for r in rows.select("slot").distinct().collect()}
        for slot in sorted(touched - left):  # nothing is left in it
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (slot = {slot})")
            remove(self.spark, f"{self.root}/rows/slot={slot}")
        self.spark.catalog.refreshTable(self.name)
        remove(self.spark, journal)

    def close(self) -> None:
        """Takes the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


TOPS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("top", T.LongType())])


class Catalog:
    """The table of photos, changed by batches of results; the same rows as operators.upsert.upsert makes of a whole one."""

    def __init__(self, spark: SparkSession, root: str, slots: int = SLOTS, buckets: int = BUCKETS):
        self.spark = spark
        self.table = KeptTable(spark, f"{root}/photos", PHOTOS, "path", slots, buckets)
        self._tops = KeptTable(spark, f"{root}/tops", TOPS, "part", 1, 1)  # one row: the largest id given

    def rows(self) -> DataFrame:
        return self.table.rows()

    def load(self, photos: DataFrame) -> DataFrame:
        """Replaces all. Gives the changes, as `upsert` does."""
        before = self._signed(self.rows(), -1)
        changes = checkpointed(_summed(before.unionByName(self._signed(photos, 1))))
        self._reserve(photos.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0])
        self.table.publish(photos, list(range(self.table.slots)))
        return changes

    def upsert(self, results: DataFrame) -> DataFrame:
        """Takes a batch of results (schema.RESULT) in. Gives the changes: path, photos and raws that its files add."""
        new = rules.last_of_path(rules.accepted(results)).select("path", "is_raw")
        touched = self.table.touched(new)
        old = self.table.rows(touched)
        was = old.select("path", F.col("is_raw").alias("_was"), F.lit(1).alias("_old"))
        one = lambda c: F.coalesce(c.cast("long"), F.lit(0))
        changes = checkpointed(was.join(new, "path", "right").select(
            "path", (1 - one(F.col("_old"))).alias("photos"), (one(F.col("is_raw")) - one(F.col("_was"))).alias("raws")
        ))
        top = self._tops.rows().agg(F.coalesce(F.max("top"), F.lit(0)).cast("long").alias("_top"))
        largest = top.first()._top
        self._reserve(largest + (changes.agg(F.sum("photos")).first()[0] or 0))
        numbers = self.spark.range(1).select(F.lit(largest).alias("_top"))
        self.table.publish(rules.upsert(old, results, numbers), touched)
        return changes

    def _reserve(self, top: int) -> None:
        """Before photos have them: a driver that is lost in between leaves a gap, and no id is given twice."""
        self._tops.publish(self.spark.createDataFrame([(0, top)], TOPS), [0])

    @staticmethod
    def _signed(photos: DataFrame, sign: int) -> DataFrame:
        return photos.select("path", F.lit(sign).cast("long").alias("photos"), (F.coalesce("is_raw", F.lit(False)).cast("long") * sign).alias("raws"))

    def close(self) -> None:
        self.table.close()
        self._tops.close()


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.sum("photos").alias("photos"), F.sum("raws").alias("raws")).where("photos <> 0 OR raws <> 0")


FOLDERS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("photo_count", T.LongType()),
    T.StructField("total_count", T.LongType()), T.StructField("raw_count", T.LongType()),
])


class Tree:
    """The folder tree, kept by changes: for every folder its photos, those below it too, and the raw ones of these. The
    row of path "" is the whole library, with photos outside of any folder."""

    def __init__(self, spark: SparkSession, root: str, slots: int = SLOTS, buckets: int = BUCKETS):
        self.spark = spark
        self.table = KeptTable(spark, f"{root}/folders", FOLDERS, "path", slots, buckets)

    def apply(self, changes: DataFrame) -> None:
        """changes: path (of files), photos and raws, with their signs. Added up by folder first, so that only folders are
        taken apart into those above them; only slots of folders whose counts change are read and written."""
        folder = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
        inside = F.length("path") - F.length(F.substring_index("path", "/", -1)) > 1
        direct = changes.groupBy(F.when(inside, folder).otherwise("").alias("folder")).agg(F.sum("photos").alias("photos"), F.sum("raws").alias("raws"))
        parts = direct.where("photos <> 0 OR raws <> 0").select(F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/")).alias("p"), "photos", "raws")
        above = parts.select("p", "photos", "raws", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth"))
        here = F.col("depth") == F.size("p")
        deltas = checkpointed(
            above.groupBy(F.concat_ws("/", F.slice("p", 1, F.col("depth"))).alias("path"), F.col("depth").alias("d_depth"))
            .agg(F.sum(F.when(here, F.col("photos")).otherwise(0)).alias("d_photos"), F.sum("photos").alias("d_total"), F.sum("raws").alias("d_raws"))
            .where("d_photos <> 0 OR d_total <> 0 OR d_raws <> 0")
        )
        touched = self.table.touched(deltas)
        both = self.table.rows(touched).join(deltas, "path", "full")
        zero = F.lit(0).cast("long")
        new = both.select(
            "path", F.coalesce("depth", "d_depth").alias("depth"),
            *((F.coalesce(c, zero) + F.coalesce(d, zero)).alias(c) for c, d in (("photo_count", "d_photos"), ("total_count", "d_total"), ("raw_count", "d_raws"))),
        )
        self.table.publish(new.where("total_count <> 0 OR path = ''"), touched)

    def folders(self) -> DataFrame:
        """path, name, parent_path, depth, photo_count, total_count and raw_count, as operators.folders.tree has them."""
        nodes = self.table.rows().where("path <> ''")
        cut = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
        return nodes.select("path", F.substring_index("path", "/", -1).alias("name"), F.when(F.col("depth") > 1, cut).alias("parent_path"), "depth", "photo_count", "total_count", "raw_count")

    def library(self) -> DataFrame:
        """photos and raws of the whole library: one slot is read."""
        whole = self.table.slot(F.lit(""))
        slot = self.spark.range(1).select(whole).first()[0]
        return self.table.rows([slot]).where("path = ''").select(F.col("total_count").alias("photos"), F.col("raw_count").alias("raws"))

    def close(self) -> None:
        self.table.close()
