"""What the operators of this folder share: the folder that driver and executors
share, cutting lineage, and joins that hold with very frequent keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import find_package as on_workers  # noqa: F401  the operators take it from here
from ..workers import shared_base

#: A key is frequent if it has at least this share of the rows, so that at most
#: HOT_KEYS keys are; that bounds what `join_to_groups` broadcasts.
HOT_KEYS = 2000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes(range(65)) + LOWER.encode() + bytes(range(91, 256))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names."""
    return f"{shared_base(spark)}/lenscape-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators keep in the shared folder. Results that are not written out
    by then are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: it outlives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(column) -> F.Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to groups, which has one row for each key of rows and in `size` its number of rows.

    The few keys that hold at least 1/HOT_KEYS of all rows (so at most HOT_KEYS of them) are joined by
    broadcast, where their rows lie; the rest, in which no key is frequent, by a sort-merge join."""
    hot = F.broadcast(groups.where(F.col(size) * HOT_KEYS >= F.lit(total)))
    near = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(key), key, "left_anti")
    far = rest.hint("merge").join(groups.where(F.col(size) * HOT_KEYS < F.lit(total)), key, "inner")
    return near.unionByName(far)


#: Row numbers that `without_rows` sends to every executor, at most (16 MB of longs).
SENT_ROWS = 2_000_000


def free_name(columns, name: str) -> str:
    """name, or the first of name_, name__ ... that is no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs stored with a column that numbers its rows, and that column's name. The numbers are data from then on: they
    hold however the table is split when it is read again, which numbers made anew at each reading would not."""
    name = free_name(docs.columns, "row")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without_rows(own: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """A `numbered` table without the rows whose numbers (column row) are listed, and without the numbers. Up to
    SENT_ROWS numbers are broadcast, so that texts stay where they lie; more are joined by sort-merge."""
    gone = stored(rows.select(F.col("row").alias(name)), "rows")
    few = gone.count() <= SENT_ROWS
    return own.join(F.broadcast(gone) if few else gone.hint("merge"), name, "left_anti").drop(name)


def with_row(docs: DataFrame, row: str | None):
    """The column that numbers rows: one that is there, or numbers made as docs is read (for operators that read once)."""
    return (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row")


@contextmanager
def pinned_splits(spark: SparkSession) -> Iterator[None]:
    """While it lasts, how files are split depends on the files alone and not on how many cores there are just then, so
    that jobs inside that read the same files see the same partitions."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(max(spark.sparkContext.defaultParallelism, 1)))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def hash_sample(rows: DataFrame, most: int, total: int) -> list:
    """The `most` rows with the smallest hashes (column h, an xxhash64; ties by the other columns), as a list. total: their
    number or a bound of it. Only rows below a bound that four times as many should pass are sorted, so a task sends few
    rows however many tasks there are; should chance, or rows that total counted and that are not there, let too few
    pass, all are sorted."""
    rest = [c for c in rows.columns if c != "h"]
    best = lambda df: list(df.orderBy("h", *rest).limit(most).toLocalIterator())
    share = 4 * most / max(total, 1)
    if share < 1:
        found = best(rows.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64))))
        if len(found) == most:
            return found
    return best(rows)
