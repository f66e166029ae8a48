"""What a request for a file or a thumbnail is answered with: status, path, content type and caching, for whole tables of
requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media


def _requested(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """id of a request is text, as it comes; the leading whole number counts."""
    number = F.regexp_extract("id", r"^\s*([+-]?\d+)", 1).try_cast("long")
    own = catalog.select(F.col("id").alias("_id"), "path", "mime_type", "is_raw", "raw_status")
    return requests.withColumn("_id", number).join(own, "_id", "left")


def files(requests: DataFrame, catalog: DataFrame, present: DataFrame) -> DataFrame:
    """requests: id (text). present: the listing of files there are (column path), originals by their path, thumbnails
    by size and path. Gives id, status, path, content_type, cache_control."""
    rows = _requested(requests, catalog)
    raw = F.coalesce("is_raw", F.lit(False))
    target = F.when(raw, media.thumbnail_path(F.col("path"), F.lit("large"))).otherwise(F.col("path"))
    rows = rows.withColumn("_target", target)
    listed = present.select(F.col("path").alias("_target"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(listed, "_target", "left")
    status = (
        F.when(F.col("_id").isNull(), 400)
        .when(F.col("path").isNull(), 404)
        .when(raw & ~F.col("raw_status").eqNullSafe(F.lit("converted")), 422)
        .when(F.col("_there").isNull(), 404)
        .otherwise(200)
    )
    good = status == 200
    branch = F.when(raw, "raw").otherwise("file")
    return rows.select(
        "id",
        status.alias("status"),
        F.when(good, F.col("_target")).alias("path"),
        F.when(good, media.content_type(branch, F.col("mime_type"))).alias("content_type"),
        F.when(good, media.cache_control(branch)).alias("cache_control"),
    )


def thumbnails(requests: DataFrame, catalog: DataFrame, present: DataFrame) -> DataFrame:
    """requests: id and size (text). A thumbnail that is missing redirects to the file. Gives id, size, status, path (or
    the address to go to), content_type, cache_control."""
    rows = _requested(requests, catalog)
    rows = rows.withColumn("_target", media.thumbnail_path(F.col("path"), F.col("size")))
    listed = present.select(F.col("path").alias("_target"), F.lit(True).alias("_there")).distinct()
    rows = rows.join(listed, "_target", "left")
    valid = F.coalesce(F.col("size").isin([n for n, *_ in media.SIZES]), F.lit(False))
    status = (
        F.when(F.col("_id").isNull() | ~valid, 400).when(F.col("path").isNull(), 404).when(F.col("_there").isNull(), 302).otherwise(200)
    )
    good = status == 200
    return rows.select(
        "id",
        "size",
        status.alias("status"),
        F.when(good, F.col("_target")).when(status == 302, media.full_url(F.col("_id"))).alias("path"),
        F.when(good, "image/webp").alias("content_type"),
        F.when(good, media.cache_control(F.lit("thumbnail"))).alias("cache_control"),
    )
