"""Token counts from flat token files.

A token file is a run of fixed-width little-endian ids in which an end-of-document id follows every document; nothing
says where documents begin. Files are cut into blocks, each block is searched for the id as one vector, and a prefix scan
over the blocks of a file (running sums of documents and tokens, the last separator so far) stitches the documents that
cross blocks. The scan has two levels, groups of blocks and a file's groups, so that no task sorts all of a large file.
Only names of blocks, their summaries and separator places are shuffled.

A document that no separator ends (the file's last one) is reported with terminated = false. Two separators side by side
are a document of no tokens. An empty file has no documents. A file whose size is no multiple of the id's width raises an
error. Null and empty texts are documents of no tokens. Repeated rows are documents of their own. Tasks read byte ranges of
files of any size, where pyarrow has the file system; where it has not, through Spark's reader of whole files, whose bound
is 2 GB a file (a larger one is an error). The writer makes one file for each partition of its input.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import on_workers, pinned_splits, shared_dir, stored

#: Ids in a block.
BLOCK = 1 << 20
#: Blocks of a file whose summaries are scanned as one group, and blocks that a task reads, at most.
GROUP, BLOCKS_A_TASK = 1024, 64
WIDTHS = {2: "<u2", 4: "<u4"}


@lru_cache(maxsize=2)
def _encoding(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, ranks_file: str, pattern: str, eod: int, width: int = 2) -> None:
    """Tokenises the column text and writes one flat file for each partition, in the order of its rows. The ids go
    through Spark's own writer, as lines that the end-of-document id ends, so files are committed as any other table's."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_file, pattern).encode_ordinary
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = [
                    np.array(encode(t.as_py()), WIDTHS[width]).tobytes() if t.is_valid else b""
                    for t in b.column(0).slice(at, 256)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    lines = docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    separator = eod.to_bytes(width, "little").decode("latin-1")
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("compression", "none").text(path)


def _opened(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address as Spark names it, and the path there."""
    scheme, _, rest = address.partition(":")
    return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(address)


def _by_range(address: str) -> bool:
    """Whether byte ranges of the file can be read."""
    try:
        system, path = _opened(address)
        return system.get_file_info(path).type == pafs.FileType.File
    except (OSError, ValueError, NotImplementedError, ImportError):
        return False


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length > 0")


def _blocks(files: DataFrame, size: int, *more: str) -> DataFrame:
    """file (its name), block (its number in the file) and more columns, for all blocks of size bytes."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), number.alias("block"), *more)


def token_blocks(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK, glob: str = "part-*") -> DataFrame:
    """file, block and data (the bytes) of every file in a folder, each read as one value."""
    size = block * width
    # a block is cut out as its row is made (generation is compiled into the projection), so one is held at a time
    cut = F.substring(F.col("content"), (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data")
    return _blocks(_files(spark, path, glob), size, "content").select("file", "block", cut)


FOUND = "file string, block long, n long, ends array<int>"


def _searched(files: list, numbers: list[int], blocks: list, eod: int, width: int) -> pa.RecordBatch:
    ids = [np.frombuffer(x, WIDTHS[width]) for x in blocks]
    ends = [np.flatnonzero(x == eod).astype(np.int32) for x in ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(files, pa.string()), pa.array(numbers, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.list_(pa.int32()))],
        names=["file", "block", "n", "ends"],
    )


def block_search(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """file, block, n (ids) and ends (places of separators in the block) of blocks that hold their data."""
    on_workers(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _searched(b.column(0).to_pylist(), b.column(1).to_pylist(), [x.as_buffer() for x in b.column(2)], eod, width)

    return blocks.select("file", F.col("block").cast("long"), "data").mapInArrow(run, FOUND)


def file_search(spark: SparkSession, path: str, eod: int, width: int = 2, block: int = BLOCK, glob: str = "part-*") -> DataFrame:
    """`block_search` of every file in a folder. Blocks are dealt out by name and read where they are searched, one at a
    time."""
    on_workers(spark)
    size = block * width
    files = _files(spark, path, glob).select("path", "length")
    total, one = files.agg(F.sum(F.ceil(F.col("length") / size)), F.first("path")).first()
    if one is not None and not _by_range(one):
        return block_search(token_blocks(spark, path, width, block, glob), eod, width)
    total = total or 0
    tasks = max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCKS_A_TASK))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, number, address, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, at = _opened(address)
                want = min(size, length - number * size)
                with system.open_input_file(at) as f:
                    data = f.read_at(want, number * size)
                if len(data) != want:
                    raise OSError(f"{address} ends before its length")
                yield _searched([file], [number], [data], eod, width)

    return _blocks(files, size, "path", "length").repartition(tasks, "file", "block").mapInArrow(run, FOUND)


def separator_scan(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """`stitched` over blocks that hold their data (file, block, data)."""
    return stitched(block_search(blocks, eod, width))


def stitched(found: DataFrame) -> DataFrame:
    """One row per document: file, ordinal (in the file, from 0), start (place of its first id), n_tokens (without the
    separator), terminated. found: file, block, n, ends."""
    found = stored(found, "separators").withColumn("group", F.floor(F.col("block") / GROUP))
    number = F.size("ends").cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    order = Window.partitionBy("file", "group").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    near = found.select(
        "*",
        zero(F.sum("n").over(before)).alias("near_base"),
        zero(F.sum(number).over(before)).alias("near_docs"),
        F.lead("block").over(order).isNull().alias("near_last"),
    )
    # the last separator so far, as a place in the group; null if there is none
    ended = F.when(number > 0, F.col("near_base") + F.element_at("ends", -1))
    groups = near.groupBy("file", "group").agg(F.sum("n").alias("n"), F.sum(number).alias("docs"), F.max(ended).alias("ended"))
    all_order = Window.partitionBy("file").orderBy("group")
    all_before = all_order.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "file", "group", "ended",
        zero(F.sum("n").over(all_before)).alias("far_base"),
        zero(F.sum("docs").over(all_before)).alias("far_docs"),
        F.lead("group").over(all_order).isNull().alias("far_last"),
    )
    far_carry = F.coalesce(F.max(F.col("far_base") + F.col("ended")).over(all_before), F.lit(-1))
    groups = groups.select("file", "group", "far_base", "far_docs", "far_last", far_carry.alias("far_carry"))
    near = near.withColumn("near_carry", F.max(ended).over(before)).hint("merge")
    summed = near.join(groups, ["file", "group"]).select(
        "file", "ends", "n",
        (F.col("far_base") + F.col("near_base")).alias("base"),
        (F.col("far_docs") + F.col("near_docs")).alias("docs"),
        (F.col("near_last") & F.col("far_last")).alias("last"),
        F.greatest("far_carry", F.col("far_base") + F.col("near_carry")).alias("carry"),
    )
    places = F.transform("ends", lambda e: F.struct((F.col("base") + e).alias("end"), F.lit(True).alias("terminated")))
    open_end = F.col("last") & (F.when(number > 0, F.element_at("ends", -1)).otherwise(-1) < F.col("n") - 1)
    tail = F.array(F.struct((F.col("base") + F.col("n")).alias("end"), F.lit(False).alias("terminated")))
    all_places = F.when(open_end, F.concat(places, tail)).otherwise(places)
    each = summed.select("file", "docs", "carry", all_places.alias("places")).select(
        "file", "docs", "carry", "places", F.posexplode("places").alias("i", "place")
    )
    start = 1 + F.when(F.col("i") > 0, F.get("places", F.col("i") - 1)["end"]).otherwise(F.col("carry"))
    return each.select(
        "file",
        (F.col("docs") + F.col("i")).alias("ordinal"),
        start.alias("start"),
        (F.col("place.end") - start).alias("n_tokens"),
        F.col("place.terminated").alias("terminated"),
    )


def part_number(file) -> F.Column:
    return F.regexp_extract(file, r"^part-(\d+)", 1).cast("int")


def token_counts(docs: DataFrame, path: str, ranks_file: str, pattern: str, eod: int, width: int = 2) -> DataFrame:
    """doc_id, file number, ordinal, start and n_tokens of every document, by way of flat files in `path`.

    The files carry no doc_id. The doc_ids are stored apart with their place in their partition, by a job that splits the
    files of docs as the one before it did, whatever becomes of executors in between; docs is to be a plain reading of
    files, whose partitions have no other order. That every file has as many documents as rows is checked."""
    spark = docs.sparkSession
    with pinned_splits(spark):
        write_token_files(docs, path, ranks_file, pattern, eod, width)
        rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")), "places")
    scanned = stitched(file_search(spark, path, eod, width)).withColumn("file", part_number(F.col("file")))
    low = (1 << 33) - 1
    named = rows.select(
        "doc_id", F.shiftright("row", 33).cast("int").alias("file"), F.col("row").bitwiseAND(F.lit(low)).alias("ordinal"),
        F.lit(True).alias("named"),
    )
    both = scanned.join(named, ["file", "ordinal"], "full")
    paired = F.col("named").isNotNull() & F.col("n_tokens").isNotNull()
    return both.select(
        "doc_id", "file", "ordinal", "start",
        F.when(paired, F.col("n_tokens")).otherwise(F.raise_error(F.lit("files and documents differ"))).alias("n_tokens"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all whole documents, tokenised to flat files in the shared folder and counted from there."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts(docs, path, ranks, tokenizers.PATTERN, eod=50256)
