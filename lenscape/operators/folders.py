"""The folder tree as a flat table: one row per folder, which Spark can hold at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(rows: DataFrame) -> DataFrame:
    """path, name, parent_path, depth (from 1) and photo_count (files directly inside) of every folder that holds files
    or lies above one that does.

    A file's folder is what stands before its last slash, if that is not the first character. Files are counted by
    folder first, so that only folders, not files, are taken apart into prefixes."""
    folder = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
    inside = F.length("path") - F.length(F.substring_index("path", "/", -1)) > 1
    direct = rows.where(inside).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    parts = direct.select(F.split("folder", "/").alias("p"), "n")
    each = parts.select("p", "n", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    nodes = each.groupBy(F.concat_ws("/", F.slice("p", 1, F.col("i"))).alias("path"), F.col("i").alias("depth")).agg(
        F.sum(F.when(F.col("i") == F.size("p"), F.col("n")).otherwise(0)).alias("photo_count")
    )
    cut = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
    return nodes.select(
        "path",
        F.substring_index("path", "/", -1).alias("name"),
        F.when(F.col("depth") > 1, cut).alias("parent_path"),
        "depth",
        "photo_count",
    )


def children(nodes: DataFrame) -> DataFrame:
    """Parent and child rows joined by path: parent, child, child_count; roots have no parent."""
    parent = nodes.select(F.col("path").alias("parent_path"), F.col("photo_count").alias("parent_count"))
    return nodes.join(parent, "parent_path", "left").select(
        F.col("parent_path").alias("parent"), F.col("path").alias("child"), F.col("photo_count").alias("child_count"), "parent_count"
    )


def ordered(nodes: DataFrame, locale: str = "UNICODE") -> DataFrame:
    """Siblings by name, as the locale collates."""
    return nodes.orderBy("parent_path", F.collate("name", locale), "name")


def ranked(nodes: DataFrame, locale: str = "UNICODE") -> DataFrame:
    """The place of every folder among its siblings, from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy("parent_path").orderBy(F.collate("name", locale), "name")
    return nodes.withColumn("place", F.row_number().over(order))


def nested(nodes: DataFrame, most: int = 100_000) -> list[dict]:
    """The tree as nested dictionaries, for a client. Trees of more than `most` folders stay tables."""
    rows = ordered(nodes).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} folders")
    by_path = {r.path: {"name": r.name, "path": r.path, "photo_count": r.photo_count, "children": []} for r in rows}
    roots = []
    for r in rows:
        (by_path[r.parent_path]["children"] if r.parent_path in by_path else roots).append(by_path[r.path])
    return roots


def totals(nodes: DataFrame) -> DataFrame:
    """total_count: files in a folder and all below it."""
    own = nodes.select(F.col("path").alias("p"), F.col("photo_count").alias("n"))
    above = own.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("p", "/"))), lambda i: F.concat_ws("/", F.slice(F.split("p", "/"), 1, i)))).alias("path"))
    return nodes.join(above.groupBy("path").agg(F.sum("n").alias("total_count")), "path")


def walked(nodes: DataFrame, locale: str = "UNICODE") -> DataFrame:
    """nodes in the order of the whole tree, siblings by name: pre (place when a folder comes before those below it, from
    0), last (pre of the last folder below it, or its own) and post (place when it comes after them).

    Whole paths, as lists of names, sort like a walk from the roots, so one range sort numbers the tree at any depth; a
    folder and all below it are the folders with pre to last."""
    from .navigation import numbered

    names = F.split("path", "/")
    keyed = nodes.withColumn("_key", F.transform(names, lambda x: F.struct(F.collate(x, locale).alias("c"), x.alias("x"))))
    above = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat_ws("/", F.slice(names, 1, i)))).alias("path"))
    sizes = above.groupBy("path").agg(F.count(F.lit(1)).alias("_size"))
    placed = numbered(keyed, "_key").join(sizes, "path")
    return placed.select(
        *nodes.columns, F.col("index").alias("pre"), (F.col("index") + F.col("_size") - 1).alias("last"), (F.col("index") + F.col("_size") - F.size(names)).alias("post")
    )


def subtree(walk: DataFrame, path: str) -> DataFrame:
    """The rows of `walked` for a folder and all below it, in its order."""
    top = walk.where(F.col("path") == path).select(F.col("pre").alias("_from"), F.col("last").alias("_to"))
    return walk.join(F.broadcast(top), (F.col("pre") >= F.col("_from")) & (F.col("pre") <= F.col("_to"))).drop("_from", "_to").orderBy("pre")
