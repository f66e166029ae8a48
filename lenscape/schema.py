"""The catalog's tables: one row per media file, and sidecars with at most one row per file."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

PHOTOS = _struct(
    ("id", _L, False), ("path", _S, False), ("name", _S, False), ("size", _L, False), ("created_at", _TS, False),
    ("modified_at", _TS, False), ("width", _I, True), ("height", _I, True), ("mime_type", _S, True), ("is_raw", _B, True),
    ("raw_format", _S, True), ("raw_status", _S, True), ("raw_error", _S, True), ("thumbnail_status", _S, True),
    ("embedding_status", _S, True), ("phash_status", _S, True),
)

EXIF_FIELDS = _struct(
    ("camera_make", _S, True), ("camera_model", _S, True), ("lens_make", _S, True), ("lens_model", _S, True),
    ("focal_length", _L, True), ("iso", _L, True), ("aperture", _S, True), ("shutter_speed", _S, True),
    ("exposure_bias", _S, True), ("date_taken", _S, True), ("gps_latitude", _S, True), ("gps_longitude", _S, True),
    ("gps_altitude", _S, True),
)

PHOTO_EXIF = T.StructType([T.StructField("photo_id", _L, False), *EXIF_FIELDS.fields])
PHOTO_EMBEDDING = _struct(
    ("photo_id", _L, False), ("embedding", T.ArrayType(T.FloatType()), False), ("model_version", _S, True), ("created_at", _TS, True)
)
PHOTO_PHASH = _struct(("photo_id", _L, False), ("hash", _S, False), ("algorithm", _S, True), ("created_at", _TS, True))

#: What processing a file gives: metadata and features, or an error.
RESULT = T.StructType([
    T.StructField("path", _S, False), T.StructField("name", _S, False), T.StructField("size", _L, True),
    T.StructField("created_ms", T.DoubleType(), True), T.StructField("modified_ms", T.DoubleType(), True),
    T.StructField("width", _I, True), T.StructField("height", _I, True), T.StructField("mime_type", _S, True),
    T.StructField("phash", _S, True), T.StructField("exif", EXIF_FIELDS, True), T.StructField("is_raw", _B, True),
    T.StructField("raw_format", _S, True), T.StructField("raw_status", _S, True), T.StructField("raw_error", _S, True),
    T.StructField("success", _B, False), T.StructField("error", _S, True),
])

#: A progress event: the queue it came from, its kind and its payload.
EVENT = _struct(
    ("task_type", _S, True), ("event_type", _S, True), ("job_id", _S, True), ("ts", _TS, True), ("seq", _L, True),
    ("phase", _S, True), ("current", _L, True), ("total", _L, True), ("photo_id", _L, True), ("path", _S, True),
    ("status", _S, True), ("error", _S, True),
)

TABLES = {"photos": PHOTOS, "photo_exif": PHOTO_EXIF, "photo_embedding": PHOTO_EMBEDDING, "photo_phash": PHOTO_PHASH}
TASKS = ("scan", "phash", "embedding")
STATES = ("active", "waiting", "completed", "failed")
KINDS = ("progress", "completed", "failed", "active")


def create_tables(spark, database: str | None = None, location: str | None = None) -> list[str]:
    """The migration runner: creates the tables that are missing, and leaves the others as they are. Gives the names."""
    made = []
    for name, schema in TABLES.items():
        full = f"{database}.{name}" if database else name
        if spark.catalog.tableExists(full):
            continue
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
        where = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE {full} ({columns}) USING parquet{where}")
        made.append(name)
    return made
