"""A training corpus from the table of documents: toxic documents, copies, near copies and benchmark leaks go, the rest
is encoded.

Every stage takes empty tables, texts of any length, nulls in any column and further columns of any name. A stage that
drops single rows of equal content first stores its documents with a row number, which then is data like any other, so
that a change of executors between jobs changes no decision."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lenscape.llm import digest_index, near_copies, sentencepiece_bpe, toxicity, wu_manber
from lenscape.llm._common import numbered, shared_dir, table, without_rows


#: Rows that a Python worker is handed at once, at most. Stages hand over whole texts and sets of shingles, of which Spark's
#: default of 10,000 rows is hundreds of megabytes in the executor and in its worker.
ROWS_AT_ONCE = 1000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a severity above 0 is at most one half. Null and empty texts stay. Repeated rows stay
    or go alike; without labelled documents all stay."""
    _small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, null being the smallest; of repeated rows one. Null texts equal
    empty ones."""
    _small_batches(spark)
    own, row = numbered(docs)
    index = digest_index.fresh_index(spark)
    found = digest_index.deduplicate(own, index, "all", row)
    index.close()
    return without_rows(own, row, found.where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents, linked by a similarity of 0.8 in five-word shingles or by fingerprints over them
    within 3 bits, the one with the smallest doc_id, null being the largest; of repeated rows one."""
    _small_batches(spark)
    own, row = numbered(docs)
    return without_rows(own, row, near_copies.near_copies(own, row))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item, with or without an id, occurs. Null and empty texts stay; with an
    empty benchmark all stay."""
    _small_batches(spark)
    return wu_manber.without_contaminated(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text decoded from them, of every row; null counts as
    empty."""
    _small_batches(spark)
    import public_tokenizers

    return sentencepiece_bpe.encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Learning, fingerprints and encoding are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the others keep is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
