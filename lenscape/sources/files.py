"""Files: a walk that keeps what Spark's own listing hides, and what can be read from them."""

from __future__ import annotations

import json
import os
import stat
import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import media
from ..workers import checkpointed, find_package

EXTENSIONS = tuple(f".{e}" for e in media.STANDARD + media.RAW + media.HEIF)


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class Discovery(DataSource):
    """format "media_files", option path: path, relative_path, name, size, created_ms and modified_ms of the supported
    files below a folder of a mounted file system. Links are followed (each folder once on a way down), names that begin
    with a dot are left out, the folder's own name too, and folders that cannot be read are passed over. The folder's
    children are walked in parallel."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "path string, relative_path string, name string, size long, created_ms double, modified_ms double"

    def reader(self, schema) -> DataSourceReader:
        return _Walk(os.path.abspath(self.options["path"]))


class _Walk(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        if os.path.basename(self.root).startswith(".") or not os.path.isdir(self.root):
            return []
        own = [Folder(self.root, False)]
        with os.scandir(self.root) as entries:
            own += [Folder(e.path, True) for e in sorted(entries, key=lambda e: e.name) if not e.name.startswith(".") and e.is_dir()]
        return own

    def read(self, part: Folder | None) -> Iterator[tuple]:
        if part is None:  # what Spark passes if there are no partitions
            return
        todo = [(part.path, (os.path.realpath(part.path),))]
        while todo:
            for path, name, above in entries(*todo.pop()):
                if above is None:
                    found = stat_of(path, name, self.root)
                    if found:
                        yield found
                elif part.deep:
                    todo.append((path, above))


def entries(folder: str, above: tuple) -> Iterator[tuple[str, str, tuple | None]]:
    """Path, name and None of what is named as a supported file in a folder; and of the folders in it the path, name and real
    paths on the way down. above: those of folder itself and of what it was reached through; a folder among them is not
    entered again. Sizes and times are not looked at."""
    try:
        opened = os.scandir(folder)
    except OSError:
        return
    with opened:
        while True:
            try:
                e = next(opened, None)
                if e is None:
                    return
                if e.name.startswith("."):
                    continue
                if e.is_dir():
                    real = os.path.realpath(e.path)
                    if real not in above:
                        yield e.path, e.name, (*above, real)
                elif e.name.lower().endswith(EXTENSIONS):
                    yield e.path, e.name, None
            except OSError:
                if e is None:
                    return


def stat_of(path: str, name: str, root: str) -> tuple | None:
    """A row of "media_files"; None of what is no file, or cannot be read."""
    try:
        s = os.stat(path)
    except OSError:
        return None
    if not stat.S_ISREG(s.st_mode):
        return None
    born = getattr(s, "st_birthtime", 0.0)
    return path, path.removeprefix(root.rstrip("/") + "/"), name, s.st_size, born * 1000.0, s.st_mtime * 1000.0


#: Folders that a task of the first round visits; twice as many in each further round, up to MOST_VISITS. A task that has seen
#: so many entries visits no other folder.
VISITS, MOST_VISITS, ENTRIES = 64, 16_384, 10_000
_STEP = "path string, name string, above array<string>"


def round_of(frontier: DataFrame, root: str, visits: int) -> DataFrame:
    """One round of a walk over frontier (path, above), dealt to all tasks: names of files, and folders (above is not null)
    that are left when a task has visited so many, or has seen ENTRIES."""
    spark = frontier.sparkSession
    find_package(spark)
    most, types = ENTRIES, [pa.string(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [(p, tuple(a)) for b in batches for p, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows, left, seen = [], visits, 0
        while todo and left and seen < most:
            for path, name, above in entries(*todo.pop()):
                seen += 1
                if above is None:
                    rows.append((path, name, None))
                else:
                    todo.append((path, above))
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
            left -= 1
        yield batch(rows + [(p, None, list(a)) for p, a in todo])

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "name", "above"])

    return frontier.repartition(max(2, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, _STEP)


def stats(names: DataFrame, root: str) -> DataFrame:
    """The rows of "media_files" of files (path, name), dealt to all tasks whatever folders they are in."""
    spark = names.sparkSession
    find_package(spark)
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
    columns = ["path", "relative_path", "name", "size", "created_ms", "modified_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (r := stat_of(p, n, root))]
            cols = list(zip(*found, strict=True)) if found else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=columns)

    return names.select("path", "name").repartitionByRange(max(2, 4 * spark.sparkContext.defaultParallelism), "path").mapInArrow(run, Discovery.schema(None))


def discover(spark: SparkSession, folder: str, visits: int = VISITS) -> DataFrame:
    """The rows of "media_files", found in rounds: tasks visit a bounded number of folders each, and what folders are left
    then is dealt out anew, at whatever depth it lies. Rounds give names; sizes and times are then read by all tasks, so that
    a folder of very many files is no task of its own but for its list. What is found is kept: the files are those of one
    walk."""
    root = os.path.abspath(folder)
    reader = _Walk(root)
    if not reader.partitions():
        return spark.createDataFrame([], Discovery.schema(None))
    frontier = spark.createDataFrame([(root, [os.path.realpath(root)])], "path string, above array<string>")
    names = None
    while True:
        step = checkpointed(round_of(frontier, root, visits))
        found = step.where("above IS NULL").select("path", "name")
        names = found if names is None else names.unionByName(found)
        frontier = step.where("above IS NOT NULL").select("path", "above")
        if frontier.isEmpty():
            return checkpointed(stats(names, root))
        visits = min(2 * visits, MOST_VISITS)


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the data source: lazily, a task for each child of the folder."""
    spark.dataSource.register(Discovery)
    return spark.read.format("media_files").option("path", folder).load()


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The same by Spark's file listing, for stores that only Spark reads. It hides names that begin with an underscore."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return found.where(media.is_supported(F.col("path"))).select(
        "path", media.basename(F.col("path")).alias("name"), F.col("length").alias("size"),
        F.lit(0.0).alias("created_ms"), F.unix_millis("modificationTime").cast("double").alias("modified_ms"),
    )


def supported(rows: DataFrame, column: str = "path") -> DataFrame:
    return rows.where(media.is_supported(F.col(column)))


def extensions(spark: SparkSession) -> DataFrame:
    """The supported extensions, one a row."""
    return spark.range(1).select(F.explode(media.supported_extensions()).alias("extension"))


def read_bytes(path: str, most: int | None = None) -> bytes:
    with open(path, "rb") as f:
        return f.read() if most is None else f.read(most)


def _with(rows: DataFrame, name: str, kind: str) -> T.StructType:
    return T.StructType(list(rows.schema.fields)).add(name, kind)


def heads(files: DataFrame, size: int = 12) -> DataFrame:
    """files with the first bytes of each as column head; null if it cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("path")
        for b in batches:
            out = []
            for p in b.column(at).to_pylist():
                try:
                    out.append(read_bytes(p, size))
                except (OSError, TypeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*names, "head"])

    names = files.columns
    return files.mapInArrow(run, _with(files, "head", "binary"))


def pixels_by_spark(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Decoded pixels by Spark's image source (JPEG, PNG, GIF, BMP): origin, height, width, nChannels, mode, data."""
    return spark.read.format("image").option("dropInvalid", "true").load(paths).select("image.*")


ExifReader = Callable[[str], "str | None"]


def exiftool(path: str) -> str | None:
    """One file's tags as a JSON object, numeric; null if the tool is missing or fails."""
    tags = "Make Model LensMake LensModel FocalLength ISO FNumber ExposureTime ExposureCompensation DateTimeOriginal GPSLatitude GPSLongitude GPSAltitude Orientation"
    try:
        done = subprocess.run(["exiftool", "-json", "-n", *(f"-{t}" for t in tags.split()), path], capture_output=True, timeout=60, check=True)
        return json.dumps(json.loads(done.stdout)[0])
    except (OSError, ValueError, IndexError, subprocess.SubprocessError):
        return None


def with_exif(files: DataFrame, reader: ExifReader = exiftool) -> DataFrame:
    """files with the EXIF of each: the reader's JSON (exif_json) and the catalog's struct (exif)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("path")
        for b in batches:
            found = [reader(p) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*names, "exif_json"])

    names = files.columns
    read = files.mapInArrow(run, _with(files, "exif_json", "string"))
    return read.withColumn("exif", media.exif_from_json(F.col("exif_json")))


def exiftool_binary(path: str, tag: str) -> bytes | None:
    try:
        return subprocess.run(["exiftool", "-b", f"-{tag}", path], capture_output=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def raw_preview(path: str, extract: Callable[[str, str], "bytes | None"] = exiftool_binary) -> bytes | None:
    """The JPEG that a raw file carries: its preview, else its full-size one."""
    for tag in ("PreviewImage", "JpgFromRaw"):
        data = extract(path, tag)
        if data is not None and len(data) > 2 and data[:2] == b"\xff\xd8":
            return data
    return None
