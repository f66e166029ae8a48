"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to one row per
digest, a sort-merge anti-join against the index finds the digests that are new, and those are appended.
DataFrame operations only.

Null text counts as empty. Empty texts equal one another. Rows with a null doc_id count as smaller than all
others. Of rows that repeat doc_id and text one is kept. An empty batch appends nothing. Extra columns of the
documents are not read, so clashing names do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import join_to_groups, lowered, shared_dir, stored, with_row

ENTRY = T.StructType([
    T.StructField("digest", T.StringType()),
    T.StructField("keep_id", T.LongType()),
    T.StructField("group_size", T.LongType()),
    T.StructField("batch", T.StringType()),
])


class DigestIndex:
    """The digests seen so far. `path` is a folder in storage that all executors share; an index that is there is
    opened again, whichever session wrote it. `buckets` is for a new index: its folder keeps the number, which holds from
    then on, whatever later sessions give. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path
        self.buckets = self._recorded(buckets)
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _recorded(self, buckets: int) -> int:
        """The number that the index's folder keeps, as a file's name that table readers pass over; it is written where
        there is no index yet."""
        mark, Path = "_buckets-", self.spark._jvm.org.apache.hadoop.fs.Path
        folder = Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        known = [int(n.removeprefix(mark)) for n in names if n.startswith(mark)]
        if not known and any(n.endswith(".parquet") for n in names):
            raise ValueError(f"the index at {self.path} does not say how many buckets it has")
        if not known:
            fs.create(Path(f"{self.path}/{mark}{buckets}")).close()
        return known[0] if known else buckets

    def close(self) -> None:
        """Takes the index out of the session's catalog. Its files stay, and results that read them hold."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest the index lacks: a sort-merge anti-join that deals out only groups."""
        return groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        dealt = groups.select(*ENTRY.names).repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, path: str) -> DigestIndex:
        """The same entries in a new folder, one sorted file a bucket however many batches came, so that joins need no
        sort of the index."""
        new = DigestIndex(self.spark, path, self.buckets)
        new.append(self.entries())
        return new


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, row (tells repeated rows apart; the column `row` of docs if there is one) and the SHA-256 of the normalised
    whole text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        with_row(docs, row),
        F.sha2(lowered(F.col("text")).cast("binary"), 256).alias("digest"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, row: str | None = None) -> DataFrame:
    """Adds a batch of documents to the index. One row per document: doc_id, row, digest, keep_id (of the row that
    stays), group_size (rows of this text in the batch that brought it), kept, known (the index had the text before).

    `batch` names the batch. Entries of that name are the batch's own, so a job that failed, or whose result was lost,
    runs again with the name that it had and gives the same rows, and adds only what the index lacks. Rows are numbered
    as docs is read once; `row` names a column that has their numbers already."""
    rows = stored(digests(docs, row), "digests")
    total = rows.count()
    groups = rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # a table, since the optimizer would else move the anti-join below the aggregation, where copies meet in one task
    groups = stored(groups, "groups")
    index.append(index.unseen(groups).withColumn("batch", F.lit(batch)))
    # `here` is the number of this batch's rows, which says what keys are frequent in it
    own = groups.select("digest", "keep_row", F.col("group_size").alias("here"))
    joined = join_to_groups(rows, own.join(index.entries().hint("merge"), "digest"), "digest", "here", total)
    new = F.col("batch") == batch
    return joined.select(
        "doc_id", "row", "digest", "keep_id", "group_size",
        (new & (F.col("row") == F.col("keep_row"))).alias("kept"),
        (~new).alias("known"),
    )


def forget(index: DigestIndex) -> None:
    """Removes an index: its table of the catalog and its files. Results that read it are lost."""
    index.close()
    path = index.spark._jvm.org.apache.hadoop.fs.Path(index.path)
    path.getFileSystem(index.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An index of its own for one call, in the shared folder."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every row of documents against an index that is empty at first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = fresh_index(spark)
    found = deduplicate(docs, index, "all")
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""
