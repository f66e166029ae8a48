"""The driver's tables as a media catalog. The expressions are SQL that Spark and DuckDB read alike, so the oracle's
common table expressions are made of the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..workers import find_package


def _case(of: str, *values: str, n: int | None = None) -> str:
    n = n or len(values)
    return f"CASE {of} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_EXT = _case("doc_id", "'jpg'", "'png'", "'cr2'", "'heic'", "'nef'")
_RAW = "doc_id % 5 IN (2, 4)"

ASSETS = {
    "id": "doc_id",
    "name": f"CAST(doc_id AS VARCHAR(20)) || '.' || {_EXT}",
    "path": f"CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN lang || '/' ELSE lang || '/' || source || '/' END || CAST(doc_id AS VARCHAR(20)) || '.' || {_EXT}",
    "size": "n_chars * (doc_id % 13 + 1) * (CASE WHEN doc_id % 7 = 0 THEN 90001 WHEN doc_id % 3 = 0 THEN 997 ELSE 1 END)",
    "width": "CAST(400 + doc_id * 37 % 4000 AS INT)",
    "height": "CAST(300 + doc_id * 53 % 3000 AS INT)",
    "is_raw": f"CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {_RAW} END",
    "raw_format": f"CASE WHEN {_RAW} THEN upper({_EXT}) END",
    "raw_status": f"CASE WHEN {_RAW} THEN {_case('doc_id', chr(39) + 'converted' + chr(39), chr(39) + 'failed' + chr(39), n=3)} END",
    "raw_error": f"CASE WHEN {_RAW} AND doc_id % 3 = 1 THEN 'no preview' END",
    "mime_type": "CASE WHEN doc_id % 5 = 0 THEN 'image/jpeg' WHEN doc_id % 5 = 1 THEN 'image/png' END",
    "thumbnail_status": "'completed'",
    "embedding_status": _case("doc_id", "'pending'", "'completed'", "'completed'", "'failed'"),
    "phash_status": _case("doc_id", "'completed'", "'failed'", "'completed'"),
    "orientation": "CASE WHEN doc_id % 10 = 9 THEN NULL ELSE CAST(doc_id % 10 AS INT) END",
    "created_ms": "CAST(1600000000123 + doc_id * 3600777 AS DOUBLE)",
    "modified_ms": "CAST(1650000000456 + doc_id * 7200333 AS DOUBLE)",
}

EXIF = {
    "photo_id": "doc_id",
    "camera_make": _case("doc_id", "'Canon'", "'Nikon'", "''", "'Sony'"),
    "camera_model": _case("doc_id", "'R5'", "CAST(NULL AS VARCHAR(9))", "'Z9'"),
    "lens_make": _case("doc_id", "'Canon'", "''", "CAST(NULL AS VARCHAR(9))"),
    "lens_model": _case("doc_id", "'RF 50'", "CAST(NULL AS VARCHAR(9))"),
    "focal_length": _case("doc_id", "50", "35", "0", "CAST(NULL AS INT)"),
    "iso": _case("doc_id", "100", "400", "CAST(NULL AS INT)", "3200", "0"),
    "aperture": _case("doc_id", "'f/2.8'", "CAST(NULL AS VARCHAR(9))", "'f/11.0'"),
    "shutter_speed": _case("doc_id", "'1/250'", "''", "CAST(NULL AS VARCHAR(9))"),
    "exposure_bias": _case("doc_id", "'0 EV'", "CAST(NULL AS VARCHAR(9))"),
    "date_taken": "'20' || CAST(10 + doc_id % 14 AS VARCHAR(4)) || ':0' || CAST(1 + doc_id % 9 AS VARCHAR(2)) || ':1' || CAST(doc_id % 9 AS VARCHAR(2)) || ' 10:00:00'",
    "gps_latitude": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 90 AS VARCHAR(4)) || '.5' END",
    "gps_longitude": "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '0' ELSE CAST(doc_id % 180 AS VARCHAR(4)) || '.25' END",
}

TAGS = {
    "id": "doc_id",
    "doc": "'{\"Make\":' || " + _case("doc_id", "'\"Canon\"'", "'\"Nik\\u00f6n\"'", "'null'", "'7'")
    + " || ',\"FocalLength\":' || " + _case("doc_id", "'50'", "'35.7'", "'-3.5'", "'\"50\"'", "'5000000000'")
    + " || ',\"ISO\":' || " + _case("doc_id", "'100'", "'320.0'", "'\"400\"'", "'-1'")
    + " || ',\"FNumber\":' || " + _case("doc_id", "'2.8'", "'1.25'", "'0.35'", "'11'")
    + " || ',\"ExposureTime\":' || " + _case("doc_id", "'0.004'", "'1'", "'2.5'", "'0'", "'-1'", "'0.3'")
    + " || ',\"ExposureCompensation\":' || " + _case("doc_id", "'-0.3'", "'0'", "'0.25'", "'1'", "'-0.05'") + " || '}'",
    "f_number": _case("doc_id", "CAST(2.8 AS DOUBLE)", "CAST(1.25 AS DOUBLE)", "CAST(0.35 AS DOUBLE)", "CAST(11 AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    "exposure": _case("doc_id", "CAST(0.004 AS DOUBLE)", "CAST(1 AS DOUBLE)", "CAST(2.5 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(-1 AS DOUBLE)", "CAST(0.3 AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(0.0000000001 AS DOUBLE)"),
    "bias": _case("doc_id", "CAST(-0.3 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(0.25 AS DOUBLE)", "CAST(1 AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    "focal": _case("doc_id", "CAST(50 AS DOUBLE)", "CAST(35.7 AS DOUBLE)", "CAST(-3.5 AS DOUBLE)", "CAST(5000000000 AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
}

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_TASK = _case("user_id", "'scan'", "'phash'", "'embedding'")
EVENTS = {
    "seq": "event_id",
    "ts": "ts",
    "task_type": _TASK,
    "event_type": "CASE event_type WHEN 'view' THEN 'progress' WHEN 'signup' THEN 'progress' WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'completed' ELSE 'failed' END",
    "job_id": f"{_TASK} || '-' || CAST(user_id AS VARCHAR(20))",
    "phase": "CASE WHEN event_id % 6 = 0 THEN 'discovery' ELSE 'processing' END",
    "current": f"CASE WHEN user_id % 3 <> 1 AND event_id % 5 <> 1 THEN {_K} END",
    "total": f"CASE WHEN user_id % 3 = 0 AND event_id % 4 = 0 THEN {_K} + 50 WHEN user_id % 3 = 2 AND event_id % 16 = 0 THEN {_K} + 7 END",
    "photo_id": "CASE WHEN user_id % 3 = 1 OR (user_id % 3 = 2 AND event_id % 3 = 0) THEN (user_id * 7 + event_id) % 400 WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN event_id % 600 END",
    "path": "CAST(NULL AS VARCHAR(20))",
    "status": "CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END",
    "error": "CAST(NULL AS VARCHAR(20))",
}

SIDECAR = {"photo_id": "vec_id", "embedding": "embedding"}

_SOURCES = {
    "assets": (ASSETS, "documents"),
    "exif": (EXIF, "labels"),
    "tags": (TAGS, "documents"),
    "jobs": (EVENTS, "events"),
    "sidecar": (SIDECAR, "embeddings"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    columns, source = _SOURCES[name]
    # VARCHAR of a length is how both engines cast to text; Spark keeps it as plain text
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return table.selectExpr(*(f"{e.replace('\\', '\\\\')} AS {c}" for c, e in columns.items()))


def cte(*names: str) -> str:
    """WITH and the common table expressions of these names, for DuckDB."""
    parts = []
    for name in names:
        columns, source = _SOURCES[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})")
    return "WITH " + ",\n".join(parts)
