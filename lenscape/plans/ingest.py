"""The ingest plan: discovered files to results, results to the catalog and its sidecars, pending files to embeddings.
Decoders, the EXIF reader and the embedder are parameters; none of them ships with this package beyond PNG and BMP."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, media
from ..operators import catalog as queries
from ..operators import upsert
from ..schema import PHOTO_EMBEDDING, PHOTO_EXIF, PHOTO_PHASH, PHOTOS, RESULT
from ..sources import files
from ..workers import checkpointed

Decoder = Callable[[bytes], np.ndarray]
Embedder = Callable[[list[str]], "list[list[float] | None]"]
BATCH = 16


def no_decoder(_: bytes) -> np.ndarray:
    raise ValueError("no decoder for this format here")


@dataclass(frozen=True)
class Tools:
    """What reads files. Each is called on the executors."""

    standard: Decoder = images.decode_standard
    heif: Decoder = no_decoder
    exif: files.ExifReader = files.exiftool
    preview: Callable[[str], "bytes | None"] = files.raw_preview
    encode: Callable[[np.ndarray], bytes] = images.encode_png


def processed(found: DataFrame, tools: Tools = Tools(), thumbnails: str | None = None) -> DataFrame:
    """schema.RESULT for discovered files. A file that cannot be read or decoded gives a row with an error. thumbnails: a
    folder that executors share; sizes are written below it, each file by rename, so a lost task leaves no part."""
    rows = files.heads(files.with_exif(found, tools.exif))
    orientation = media.json_count(F.col("exif_json"), "Orientation")
    rows = rows.select(
        "path", "relative_path", "name", "size", "created_ms", "modified_ms", "exif",
        orientation.cast("int").alias("orientation"),
        media.decoder(F.col("path"), F.col("head")).alias("decoder"),
    )
    rows = checkpointed(rows)  # both sides of the join below need it, and the reader is to see a file once
    carried = rows.select("path", "exif")
    pixels = rows.drop("exif").mapInPandas(lambda it: _pixels(it, tools, thumbnails), "path string, relative_path string, name string, size long, created_ms double, modified_ms double, decoder string, width int, height int, phash string, error string")
    joined = pixels.join(carried, "path", "left")
    raw, good = media.is_raw_file(F.col("path")), F.col("error").isNull()
    kind = F.when(F.col("decoder") == "heif", "image/heic").otherwise(media.mime_type(F.col("path"), good))
    return joined.select(
        F.col("relative_path").alias("path"), "name", "size", "created_ms", "modified_ms", "width", "height",
        F.when(raw, media.mime_type(F.col("path"))).otherwise(kind).alias("mime_type"),
        "phash", "exif", raw.alias("is_raw"), media.raw_format(F.col("path")).alias("raw_format"),
        F.when(raw, F.when(good, "converted").otherwise("failed")).alias("raw_status"),
        F.when(raw & ~good, F.col("error")).alias("raw_error"),
        good.alias("success"), "error",
    ).select(*(F.col(f.name).cast(f.dataType) for f in RESULT))


def _pixels(batches: Iterator[pd.DataFrame], tools: Tools, thumbnails: str | None) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            width = height = phash = error = None
            try:
                if r.decoder == "raw":
                    data = tools.preview(r.path)
                    if data is None:
                        raise ValueError("no preview in this raw file")
                    pixels = tools.standard(data)
                elif r.decoder == "heif":
                    pixels = tools.heif(files.read_bytes(r.path))
                elif r.decoder == "standard":
                    pixels = tools.standard(files.read_bytes(r.path))
                else:
                    raise ValueError("Unsupported file type")
                pixels = images.oriented(pixels, None if pd.isna(r.orientation) else int(r.orientation))
                height, width = pixels.shape[:2]
                phash = images.double_gradient(pixels)
                if thumbnails:
                    write_thumbnails(pixels, r.relative_path, thumbnails, tools.encode)
            except Exception as e:  # noqa: BLE001  whatever a decoder raises is that file's error
                error = str(e) or type(e).__name__
            out.append((r.path, r.relative_path, r.name, r.size, r.created_ms, r.modified_ms, r.decoder, width, height, phash, error))
        frame = pd.DataFrame(out, columns=["path", "relative_path", "name", "size", "created_ms", "modified_ms", "decoder", "width", "height", "phash", "error"])
        yield frame.astype({"width": "Int32", "height": "Int32"})


def write_thumbnails(pixels: np.ndarray, relative: str, base: str, encode: Callable[[np.ndarray], bytes]) -> None:
    stem = os.path.splitext(relative)[0] if not os.path.basename(relative).startswith(".") else relative
    for name, edge, _ in media.SIZES:
        target = os.path.join(base, name, f"{stem}.webp")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(encode(images.thumbnail(pixels, edge)))
        os.replace(part, target)


def embedded(rows: DataFrame, embed: Embedder, batch: int = BATCH) -> DataFrame:
    """photo_id and embedding for rows of id and path, so many paths at a time, places kept; null where there is none or
    a batch fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                try:
                    vectors = embed(list(part["path"]))
                except Exception:  # noqa: BLE001  a model's failure is that of the batch
                    vectors = [None] * len(part)
                yield pd.DataFrame({"photo_id": part["id"].to_numpy(), "embedding": vectors})

    return rows.select("id", "path").mapInPandas(run, "photo_id long, embedding array<float>")


class Catalog:
    """The four tables as versions in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.stores = {
            name: (upsert.Store(spark, f"{path}/{name}"), schema)
            for name, schema in (("photos", PHOTOS), ("photo_exif", PHOTO_EXIF), ("photo_embedding", PHOTO_EMBEDDING), ("photo_phash", PHOTO_PHASH))
        }

    def read(self, name: str) -> DataFrame:
        store, schema = self.stores[name]
        return store.read(schema)

    def write(self, name: str, rows: DataFrame) -> None:
        store, schema = self.stores[name]
        store.write(rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)))

    def save(self, results: DataFrame) -> None:
        """An upsert and the sidecars. results should be a stored table: it is read more than once."""
        self.write("photos", upsert.upsert(self.read("photos"), results))
        photos = self.read("photos")
        self.write("photo_exif", upsert.replaced(self.read("photo_exif"), upsert.exif_rows(photos, results)))
        self.write("photo_phash", upsert.replaced(self.read("photo_phash"), upsert.hash_rows(photos, results)))

    def embed_pending(self, embed: Embedder, folder: str = "") -> DataFrame:
        """Embeds all pending files (by their large thumbnails below folder). Gives the outcome, photo_id and ok."""
        photos = self.read("photos")
        ids = queries.pending(photos)
        thumb = media.thumbnail_path(F.col("path"), F.lit("large"))
        work = queries.by_ids(photos, ids).select("id", F.concat(F.lit(f"{folder}/"), thumb).alias("path"))
        made = checkpointed(embedded(work, embed))
        catalog, sidecar = upsert.save_embeddings(photos, self.read("photo_embedding"), made)
        self.write("photo_embedding", sidecar)
        self.write("photos", catalog)
        return made.select("photo_id", F.col("embedding").isNotNull().alias("ok"))


def ingest(spark: SparkSession, folder: str, catalog: Catalog, work: str, tools: Tools = Tools(), thumbnails: str | None = None) -> DataFrame:
    """Scans a folder into a catalog. work: a folder for the results, which outlive the run. Gives the results; those that
    failed are there too."""
    results = processed(files.discover(spark, folder), tools, thumbnails)
    results.write.mode("overwrite").parquet(work)
    stored = spark.read.schema(RESULT).parquet(work)
    catalog.save(stored)
    return stored
