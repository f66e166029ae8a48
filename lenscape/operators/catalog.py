"""Catalog queries: filters, the sidecar join, look-ups and counts. Everything is one declarative plan, so predicates and
columns reach the scan; nothing is fetched in between."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class NotFound(LookupError):
    pass


def raw_condition(which: str = "all") -> Column | None:
    """all, raw or standard; a file of which it is not known whether it is raw is neither raw nor standard."""
    if which not in ("all", "raw", "standard"):
        raise ValueError(f"all, raw or standard, not {which}")
    return None if which == "all" else F.col("is_raw") == (which == "raw")


def folder_condition(folder: str | None, sqlite_like: bool = False) -> Column | None:
    """Below a folder, at any depth. An empty name filters nothing. sqlite_like: as that database's LIKE has it: letters
    A-Z match in either case, and _ and % of the name are wildcards; else the name is taken literally."""
    if not folder:
        return None
    if not sqlite_like:
        return F.startswith(F.col("path"), F.lit(f"{folder}/"))
    pattern = f"{folder.translate(str.maketrans(UPPER, LOWER))}/%".replace("!", "!!").replace("'", "''")
    return F.expr(f"translate(path, '{UPPER}', '{LOWER}') LIKE r'{pattern}' ESCAPE '!'")


def child_condition(folder: str | None) -> Column | None:
    """Directly in a folder: no further slash behind its name."""
    if not folder:
        return None
    return F.instr(F.substr(F.col("path"), F.lit(len(folder) + 2)), "/") == 0


def conjunction(*conditions: Column | None) -> Column | None:
    """All of the conditions that are given; None if none is."""
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else None


def filtered(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    every = conjunction(*conditions)
    return rows if every is None else rows.where(every)


def with_sidecar(photos: DataFrame, sidecar: DataFrame, name: str = "exif") -> DataFrame:
    """Each photo with its row of a one-to-one table as a struct, null where it has none."""
    columns = [c for c in sidecar.columns if c != "photo_id"]
    nested = sidecar.select(F.col("photo_id").alias("id"), F.struct(*columns).alias(name))
    return photos.join(nested, "id", "left")


def photos(
    catalog: DataFrame, exif: DataFrame | None = None, which: str = "all", folder: str | None = None, sqlite_like: bool = False
) -> DataFrame:
    """The files directly in a folder (or all), raw or not, with their EXIF."""
    rows = filtered(catalog, raw_condition(which), folder_condition(folder, sqlite_like), child_condition(folder))
    return rows if exif is None else with_sidecar(rows, exif)


def ordered(rows: DataFrame) -> DataFrame:
    """The catalog's order, which the reference leaves to its database: by id."""
    return rows.orderBy("id")


def counts(rows: DataFrame) -> DataFrame:
    """total and raw_count of rows, one row."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_raw").alias("raw_count"))


def photo(catalog: DataFrame, id_: int, exif: DataFrame | None = None) -> DataFrame:
    """The row of an id (one at most)."""
    row = catalog.where(F.col("id") == id_).limit(1)
    return row if exif is None else with_sidecar(row, exif)


def photo_or_error(catalog: DataFrame, id_: int, exif: DataFrame | None = None):
    found = photo(catalog, id_, exif).first()
    if found is None:
        raise NotFound("Photo not found")
    return found


def by_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in a table of ids, of any size."""
    return catalog.join(ids.select("id"), "id", "left_semi")


def by_path(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """id and path of the files of given paths."""
    return catalog.select("id", "path").join(paths.select("path"), "path", "left_semi")


def path_of(catalog: DataFrame, id_: int) -> str:
    found = catalog.where(F.col("id") == id_).select("path").limit(1).first()
    if found is None:
        raise NotFound("Photo not found")
    return found.path


def missing_thumbnails(catalog: DataFrame, present: DataFrame, size: str) -> DataFrame:
    """id and thumbnail path of files that have no thumbnail in a listing (column path)."""
    from ..functions import media

    wanted = catalog.select("id", media.thumbnail_path(F.col("path"), F.lit(size)).alias("thumbnail"))
    return wanted.join(present.select(F.col("path").alias("thumbnail")), "thumbnail", "left_anti").select("id", "thumbnail")


def pending(catalog: DataFrame, column: str = "embedding_status") -> DataFrame:
    """Ids of all pending rows; failed ones return only when a rescan makes them pending."""
    return catalog.where(F.col(column) == "pending").select("id")


def duplicates_by(catalog: DataFrame, *columns: str) -> DataFrame:
    """Groups of files that agree in columns, with more than one file."""
    return (
        catalog.groupBy(*columns).agg(F.count(F.lit(1)).alias("files"), F.min("id").alias("first_id")).where("files > 1")
    )


def completeness(rows: DataFrame) -> DataFrame:
    """Which sections of metadata each file (with its EXIF struct) has."""
    from ..functions.media import present

    e = lambda c: F.col(f"exif.{c}")
    number = lambda c: F.coalesce(e(c) != 0, F.lit(False))
    return rows.select(
        "id",
        (present(e("camera_make")) | present(e("camera_model"))).alias("has_camera"),
        (present(e("lens_make")) | present(e("lens_model"))).alias("has_lens"),
        (number("focal_length") | number("iso") | present(e("aperture")) | present(e("shutter_speed")) | present(e("exposure_bias"))).alias("has_settings"),
        present(e("date_taken")).alias("has_date"),
        (present(e("gps_latitude")) | present(e("gps_longitude"))).alias("has_location"),
    )
