"""Media functions on columns: what a file is, how it is named, and how its values are shown. All of them are built-in
expressions but for `one_decimal`, where no built-in rounds a double by its exact value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The supported extensions, what they decode with, and their types.
STANDARD = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif")
RAW = ("cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2", "pef", "srw", "x3f", "3fr", "iiq", "rwl")
HEIF = ("heic", "heif")
BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1", "avif")
SIZES = (("tiny", 150, 80), ("small", 400, 85), ("medium", 800, 85), ("large", 1600, 90))
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}
U32 = 4294967295


def _ends(path: Column, extensions) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(extensions)})$")


def is_supported(path: Column) -> Column:
    return _ends(path, STANDARD + RAW + HEIF)


def supported_extensions() -> Column:
    return F.array(*(F.lit(e) for e in STANDARD + RAW + HEIF))


def is_raw_file(path: Column) -> Column:
    return _ends(path, RAW)


def raw_format(path: Column) -> Column:
    return F.when(is_raw_file(path), F.upper(F.substring_index(path, ".", -1)))


def is_heif_file(path: Column) -> Column:
    return _ends(path, HEIF)


def is_heif_content(head: Column) -> Column:
    """By the first bytes of a file: a box named ftyp and one of the brands."""
    brand = F.hex(F.substring(head, 9, 4)).isin([b.encode().hex().upper() for b in BRANDS])
    return (F.length(head) >= 12) & (F.hex(F.substring(head, 5, 4)) == "66747970") & brand


def decoder(path: Column, head: Column | None = None) -> Column:
    """HEIF by name or content comes before raw, and raw before the standard formats; null: unsupported."""
    heif = is_heif_file(path) if head is None else is_heif_file(path) | F.coalesce(is_heif_content(head), F.lit(False))
    return F.when(heif, "heif").when(is_raw_file(path), "raw").when(_ends(path, STANDARD), "standard")


def mime_type(path: Column, decoded: Column | None = None) -> Column:
    """decoded: whether the file could be decoded; if not, only raw and HEIF files have a type."""
    known = F.lit("image/unknown")
    for extension, mime in MIME.items():
        known = F.when(_ends(path, (extension,)), mime).otherwise(known)
    if decoded is not None:
        known = F.when(decoded, known)
    raw = F.concat(F.lit("image/x-"), F.lower(raw_format(path)))
    return F.when(is_raw_file(path), raw).when(is_heif_file(path), "image/heic").otherwise(known)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, base: Column) -> Column:
    """path below base, or path as it is if it does not lie there."""
    prefix = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def thumbnail_path(path: Column, size: Column) -> Column:
    return F.concat(size, F.lit("/"), F.regexp_replace(path, r"\.[^/.]+$", ""), F.lit(".webp"))


def native_stem(path: Column) -> Column:
    """As the native writer strips extensions: a trailing dot goes as well, a leading one begins no extension."""
    return F.regexp_replace(path, r"([^/])\.[^/.]*$", "$1")


def thumbnail_sizes() -> Column:
    """An array of name, edge and quality."""
    return F.array(*(F.struct(F.lit(n).alias("size"), F.lit(m).alias("edge"), F.lit(q).alias("quality")) for n, m, q in SIZES))


def fitted(width: Column, height: Column, edge: Column) -> Column:
    """Width and height of an image that fits a square, in single precision; small images stay as they are."""
    f = lambda c: c.cast("float")
    wide = F.struct(edge.cast("int").alias("width"), F.floor(f(f(edge) / f(f(width) / f(height)))).cast("int").alias("height"))
    high = F.struct(F.floor(f(f(edge) / f(f(height) / f(width)))).cast("int").alias("width"), edge.cast("int").alias("height"))
    same = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.when((width <= edge) & (height <= edge), same).when(width > height, wide).otherwise(high)


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height after the orientation transform: 5 to 8 turn the image on its side."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(
        F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height")
    )


@F.pandas_udf(T.StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """The double's exact value rounded to one decimal, ties to even."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


def file_size(size: Column) -> Column:
    """1023 B, 1.0 KB, ... GB; ties are rounded up, in whole numbers so that no double blurs them."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB")):
        tenths = F.shiftright(size * 10 + (1 << (power - 1)), power)
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= 1 << power, text).otherwise(out)
    return out


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")


def aperture(f_number: Column) -> Column:
    return F.concat(F.lit("f/"), one_decimal(f_number))


def shutter_speed(seconds: Column) -> Column:
    """Seconds from 1 up, else a fraction; the divisor is rounded, ties away from zero, and kept in 32 bits."""
    divisor = F.when(seconds == 0, U32).when(seconds < 0, 0).otherwise(F.least(F.round(1 / F.when(seconds > 0, seconds)), F.lit(float(U32))).cast("long"))
    return F.when(seconds >= 1, F.concat(one_decimal(seconds), F.lit("s"))).when(
        seconds.isNotNull(), F.concat(F.lit("1/"), divisor.cast("string"))
    )


def exposure_bias(ev: Column) -> Column:
    shown = F.concat(F.when(ev > 0, "+").otherwise(""), one_decimal(ev), F.lit(" EV"))
    return F.when(ev == 0, "0 EV").otherwise(shown)


def saturated(x: Column) -> Column:
    """A double as an unsigned 32-bit number: cut off towards zero, kept in range, 0 for NaN."""
    inside = F.least(F.greatest(x, F.lit(0.0)), F.lit(float(U32)))
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x.isNotNull(), F.floor(inside))


def _json(document: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant")


def json_kind(document: Column, key: str) -> Column:
    return F.when(_json(document, key).isNotNull(), F.schema_of_variant(_json(document, key)))


def json_number(document: Column, key: str) -> Column:
    """A number of a JSON object as a double; null if the value is none."""
    kind = json_kind(document, key)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(number, F.try_variant_get(F.try_parse_json(document), f"$.{key}", "double"))


def json_count(document: Column, key: str) -> Column:
    """A value that is a whole number from 0 up, in 32 bits; null for 320.0 or text."""
    value = F.when(json_kind(document, key) == "BIGINT", F.try_variant_get(F.try_parse_json(document), f"$.{key}", "long"))
    return F.when(value >= 0, value % (U32 + 1))


def json_text(document: Column, key: str) -> Column:
    """Text as it is, other values written out; JSON's null is null."""
    value = F.get_json_object(document, f"$.{key}")
    return F.when(json_kind(document, key) != "VOID", value)


def exif_from_json(document: Column) -> Column:
    """The struct of schema.EXIF_FIELDS from a reader's JSON object with numeric values."""
    text = lambda key: json_text(document, key)
    number = lambda key: json_number(document, key)
    return F.when(
        F.try_parse_json(document).isNotNull(),
        F.struct(
            text("Make").alias("camera_make"),
            text("Model").alias("camera_model"),
            text("LensMake").alias("lens_make"),
            text("LensModel").alias("lens_model"),
            saturated(number("FocalLength")).alias("focal_length"),
            json_count(document, "ISO").alias("iso"),
            aperture(number("FNumber")).alias("aperture"),
            shutter_speed(number("ExposureTime")).alias("shutter_speed"),
            exposure_bias(number("ExposureCompensation")).alias("exposure_bias"),
            text("DateTimeOriginal").alias("date_taken"),
            number("GPSLatitude").cast("string").alias("gps_latitude"),
            number("GPSLongitude").cast("string").alias("gps_longitude"),
            number("GPSAltitude").cast("string").alias("gps_altitude"),
        ),
    )


def thumbnail_url(id_: Column, size: str, server: str = "") -> Column:
    return F.concat(F.lit(f"{server}/api/photos/"), id_.cast("string"), F.lit(f"/thumbnail/{size}"))


def source_set(id_: Column, server: str = "") -> Column:
    return F.concat_ws(", ", *(F.concat(thumbnail_url(id_, n, server), F.lit(f" {m}w")) for n, m, _ in SIZES))


def full_url(id_: Column, server: str = "") -> Column:
    return F.concat(F.lit(f"{server}/api/photos/"), id_.cast("string"), F.lit("/file"))


def failed_raw(is_raw: Column, raw_status: Column) -> Column:
    """Raw files that are not converted; an unknown status counts as failed."""
    return F.coalesce(is_raw, F.lit(False)) & ~raw_status.eqNullSafe(F.lit("converted"))


def raw_label(raw_status: Column, default: str = "Unknown") -> Column:
    return (
        F.when(raw_status == "converted", "Converted").when(raw_status == "failed", "Failed")
        .when(raw_status == "no_converter", "No Converter").otherwise(default)
    )


def joined_label(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def exposure_label(focal_length: Column, aperture_: Column, shutter: Column, iso: Column) -> Column:
    """The settings that are known, in this order, joined by a space."""
    return F.concat_ws(
        " ",
        F.when(focal_length > 0, F.concat(focal_length.cast("string"), F.lit("mm"))),
        F.nullif(aperture_, F.lit("")),
        F.nullif(shutter, F.lit("")),
        F.when(iso > 0, F.concat(F.lit("ISO "), iso.cast("string"))),
    )


def present(c: Column) -> Column:
    """Not null and not empty: what a client shows. "0" is present."""
    return F.coalesce(c != "", F.lit(False))


def gps_label(lat: Column, lon: Column) -> Column:
    return F.when(present(lat) & present(lon), F.concat(lat, F.lit(", "), lon))


def dimensions_label(width: Column, height: Column) -> Column:
    return F.when((width != 0) & (height != 0), F.concat_ws(" x ", width.cast("string"), height.cast("string")))


def cache_control(branch: Column) -> Column:
    """Thumbnails never change; files are kept an hour."""
    return F.when(branch == "thumbnail", "public, max-age=31536000, immutable").otherwise("public, max-age=3600")


def content_type(branch: Column, mime: Column) -> Column:
    """Thumbnails and converted raw files are WebP."""
    return F.when(branch.isin("thumbnail", "raw"), "image/webp").otherwise(F.coalesce(F.nullif(mime, F.lit("")), F.lit("application/octet-stream")))


def float_blob(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""
    return _to_blob(vector)


def blob_floats(blob: Column) -> Column:
    return _from_blob(blob)


@F.pandas_udf(T.BinaryType())
def _to_blob(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _from_blob(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))


def job_id(task: str, at_ms: Column | None = None, photo_id: Column | None = None) -> Column:
    """scan-<ms>, phash-<photo> (one job per photo) or batch-embedding-<ms>."""
    name = {"scan": "scan", "phash": "phash", "embedding": "batch-embedding"}[task]
    return F.concat(F.lit(f"{name}-"), (photo_id if task == "phash" else at_ms).cast("string"))
