"""Density clusters of vectors (DBSCAN), such as the faces of one person.

A vector is a core if at least `least` vectors, itself among them, lie within `eps` of it; cores within eps of each other
share a cluster, and any other vector within eps of a core belongs to the nearest one's (ties: the smallest id). Equal
vectors are one point with a count, so groups of copies make no pairs.

Points are dealt to the cell of their nearest centroid, and sent also to every cell whose points can lie within eps of them:
those whose centroid is at most 2 * eps further than their own's. So each cell sees all neighbours of its points. Where that
rules little out (a wide eps), there is one cell. A cell is compared in blocks of bounded size, however many points it has,
two blocks a group: first those with themselves, then, with the clusters these give as names, different ones. Groups report
counts, and then a spanning forest of the clusters they join in place of all links, which are merged as components.

Distances are products of matrices in single precision, with a bound of their error; what lies within it of eps is measured
again in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import checkpointed, find_package
from .hashing import connected, merged
from .vector_index import SAMPLE, k_means
from .vectors import _matrix

#: Points of a block at most, and at least where a cell has fewer than FEW blocks; cells at most.
BLOCK, LEAST_BLOCK, FEW, MOST_CELLS = 16_384, 2_000, 8, 1_024
#: Rows that are sent to cells at once; pairs that are compared at once, and measured again at once; sample points that cells are judged by.
SENT, TILE, AGAIN, JUDGED = 4_096, 1 << 20, 10_000, 2_048


def clusters(rows: DataFrame, eps: float, least: int, cells: int | None = None, id_column: str = "photo_id") -> DataFrame:
    """photo_id, core and cluster (the smallest id of its cores; null: noise) of every row with an id and a vector of the
    length that most have."""
    spark = rows.sparkSession
    find_package(spark)
    own = rows.select(F.col(id_column).cast("long").alias("photo_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("photo_id IS NOT NULL AND embedding IS NOT NULL")
    top = own.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if top is None or not top.dim:
        return own.select("photo_id", F.lit(False).alias("core"), F.lit(None).cast("long").alias("cluster")).where(F.lit(False))
    dim = top.dim
    own = own.where(F.size("embedding") == dim)
    points = checkpointed(own.groupBy("embedding").agg(F.min("photo_id").alias("point"), F.count(F.lit(1)).alias("n")))
    total = points.count()
    made = _centres(points, total, dim, max(1, min(cells or round(total**0.5), MOST_CELLS)))
    if len(made) < 2 or (not cells and _share(points, dim, made, eps) > 0.25):  # of all pairs; a half is compared without cells
        sent = points.select("point", "embedding", "n", F.lit(0).alias("cell"), F.lit(True).alias("home"))
    else:
        sent = _sent(points, dim, made, eps)
    sizes = {r.cell: (r.own, r.n - r.own) for r in sent.groupBy("cell").agg(F.count_if("home").alias("own"), F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    named = sent.select("*", F.lit(False).alias("core"), F.col("point").alias("root"))
    counted = _in_blocks(named, sizes, dim, eps, "i <= j", False).groupBy("point").agg(F.sum("to").alias("near"))
    cores = checkpointed(counted.select("point", (F.col("near") >= least).alias("core")))
    named = checkpointed(sent.join(cores, "point").withColumn("root", F.col("point")))
    met = checkpointed(_in_blocks(named, sizes, dim, eps, "i = j", True))
    roots = checkpointed(_roots(met))
    named = checkpointed(named.drop("root").join(roots.toDF("point", "root"), "point", "left").withColumn("root", F.coalesce("root", "point")))
    apart = checkpointed(_in_blocks(named, sizes, dim, eps, "i < j", True))
    own_core = cores.where("core").join(roots.toDF("point", "first"), "point", "left").withColumn("first", F.coalesce("first", "point"))
    own_core = own_core.join(_roots(apart).toDF("first", "root"), "first", "left").select("point", F.coalesce("root", "first").alias("root"))
    order = Window.partitionBy("point").orderBy("distance", "to")
    border = met.unionByName(apart).where("distance IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    border = border.select(F.col("point").alias("edge"), F.col("to").alias("point")).join(own_core, "point").select(F.col("edge").alias("point"), "root")
    named = cores.join(own_core.unionByName(border), "point", "left")
    return own.join(points.select("embedding", "point"), "embedding").join(named, "point").select("photo_id", "core", F.col("root").alias("cluster"))


def _roots(met: DataFrame) -> DataFrame:
    return connected(met.where("distance IS NULL").select(F.col("point").alias("a"), F.col("to").alias("b")))


def _some(points: DataFrame, total: int, dim: int, most: int) -> np.ndarray:
    """So many points, those of the least hashes."""
    h, share = F.xxhash64("point"), 2 * most / max(1, total)
    some = points.where(h < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else points
    return np.array([r.embedding for r in some.orderBy(h, "point").limit(most).toLocalIterator()], np.float64).reshape(-1, dim)


def _centres(points: DataFrame, total: int, dim: int, cells: int) -> np.ndarray:
    sample = _some(points, total, dim, SAMPLE * cells)
    return k_means(sample, cells) if len(sample) and cells > 1 else np.zeros((1, dim))


def _reached(point: np.ndarray, made: np.ndarray, eps: float) -> tuple[np.ndarray, int]:
    """The cells that a point is sent to, and its own."""
    d = np.sqrt(((made - point) ** 2).sum(axis=1))
    return np.flatnonzero(d <= d.min() + 2 * eps * (1 + 1e-9) + 1e-9), int(d.argmin())


def _share(points: DataFrame, dim: int, made: np.ndarray, eps: float) -> float:
    """The share of all ordered pairs of points that cells compare, by a sample."""
    sample = _some(points, points.count(), dim, JUDGED)
    own, seen = np.zeros(len(made)), np.zeros(len(made))
    for p in sample:
        to, home = _reached(p, made, eps)
        seen[to] += 1
        own[home] += 1
    return float((own * (seen - own / 2)).sum() / max(1, len(sample)) ** 2)


def _sent(points: DataFrame, dim: int, made: np.ndarray, eps: float) -> DataFrame:
    """point, embedding, n, cell, home: a row for each cell that a point is sent to."""
    centres = points.sparkSession.sparkContext.broadcast(made)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = centres.value
        for b in batches:
            fit, matrix = _matrix(b.column(1), dim)
            at, cell, home = [], [], []
            for i, p in zip(fit.tolist(), matrix, strict=True):
                to, nearest = _reached(p, made, eps)
                at += [i] * len(to)
                cell += to.tolist()
                home += (to == nearest).tolist()
                if len(at) >= SENT:
                    yield batch(b, at, cell, home)
                    at, cell, home = [], [], []
            yield batch(b, at, cell, home)

    def batch(b: pa.RecordBatch, at: list, cell: list, home: list) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(cell, pa.int32()), pa.array(home, pa.bool_())], names=["point", "embedding", "n", "cell", "home"])

    return checkpointed(points.select("point", "embedding", "n").mapInArrow(send, "point long, embedding array<float>, n long, cell int, home boolean"))


def near_pairs(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a and b that lie within eps of each other, in pieces."""
    with np.errstate(all="ignore"):
        middle = b.mean(axis=0)
        middle = np.where(np.isfinite(middle), middle, 0.0)
        x, y = (a - middle).astype(np.float32), (b - middle).astype(np.float32)
        na, nb = (x * x).sum(axis=1), (y * y).sum(axis=1)
        limit = eps * eps
        slack = (a.shape[1] + 8) * 2.0**-22 * (float(na.max()) + float(nb.max())) + 1e-6 * limit
        left = np.column_stack([-2 * x, na, np.ones_like(na)])  # its products with right are squared distances
        right = np.column_stack([y, np.ones_like(nb), nb])
        step = max(1, TILE // len(b))
        for at in range(0, len(a), step):
            d = (left[at : at + step] @ right.T).ravel()
            found = np.flatnonzero(~(d > limit + slack))  # what is no number is measured again
            row, column = np.divmod(found, len(b))
            row += at
            keep = d[found] < limit - slack
            unsure = np.flatnonzero(~keep)
            for k in range(0, len(unsure), AGAIN):
                part = unsure[k : k + AGAIN]
                keep[part] = distances(a[row[part]], b[column[part]]) <= eps
            if keep.any():
                yield row[keep], column[keep]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((b - a) ** 2).sum(axis=1))


def _in_blocks(sent: DataFrame, sizes: dict, dim: int, eps: float, which: str, link: bool) -> DataFrame:
    """point, to, distance, from the groups of two blocks i and j of a cell for which `which` holds. Without link: the number
    (in `to`) of rows within eps that a group adds to a point of its cell. With it: links between the roots of cores (distance
    is null), a forest for each group; and of every other point of the cell the nearest core.

    Blocks of a cell's own points come first, then those of the points sent to it, which meet only the former."""
    most = max(sizes, default=0) + 1
    cut = lambda n: max(-(-n // BLOCK), min(FEW, -(-n // LEAST_BLOCK)))
    counts = [(max(1, cut(own)), cut(guests)) for own, guests in (sizes.get(c, (0, 0)) for c in range(most))]
    groups = sum(p * (p + 1) // 2 + p * q for p, q in counts)
    parts = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in counts)), F.col("cell") + 1)
    own, guests, h = parts(0), parts(1), F.xxhash64("point")
    place = F.when(F.col("home"), F.pmod(h, own)).otherwise(own + F.pmod(h, F.greatest(guests, F.lit(1)))).cast("int")
    last = F.when(F.col("home"), own + guests).otherwise(own) - 1
    dealt = sent.select("*", place.alias("place"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select(
        "point", "embedding", "n", "core", "root", "home", (F.col("other") >= F.col("place")).alias("left"), "cell",
        F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"),
    ).where(which)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, vectors, alone = [], [], False
        for b in batches:
            vectors.append(_matrix(b.column("embedding"), dim)[1].astype(np.float32))
            parts.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("point", "n", "core", "root", "home", "left")])
            alone = b.column("i")[0] == b.column("j")[0]
        *rows, left = (np.concatenate(c) for c in zip(*parts, strict=True))
        vectors = np.concatenate(vectors)
        sides = [(vectors[m].astype(np.float64), *(c[m] for c in rows)) for m in ((left,) if alone else (left, ~left))]
        a, b = sides[0], sides[-1]
        if not (len(a[0]) and len(b[0])):
            return
        yield (_linked if link else _counted)(a, b, alone, eps)

    spark = sent.sparkSession
    tasks = max(1, min(groups, max(4 * spark.sparkContext.defaultParallelism, groups // 16)))
    key = ("cell", "i", "j")
    return dealt.repartition(tasks, *key).groupBy(*key).applyInArrow(meet, "point long, to long, distance double")


def _batch(point: np.ndarray, to: np.ndarray, distance: pa.Array | None = None) -> pa.RecordBatch:
    distance = pa.nulls(len(point), pa.float64()) if distance is None else distance
    return pa.RecordBatch.from_arrays([pa.array(point, pa.int64()), pa.array(to, pa.int64()), distance], names=["point", "to", "distance"])


def _counted(a: tuple, b: tuple, alone: bool, eps: float) -> pa.RecordBatch:
    left, right = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
    for x, y in near_pairs(a[0], b[0], eps):
        left += np.bincount(x, b[2][y], len(left)).astype(np.int64)
        if not alone:
            right += np.bincount(y, a[2][x], len(right)).astype(np.int64)
    ids, counts, home = np.concatenate([a[1], b[1]]), np.concatenate([left, right]), np.concatenate([a[5], b[5]])
    keep = home & (np.arange(len(ids)) < (len(left) if alone else len(ids)))
    return _batch(ids[keep], counts[keep])


def _linked(a: tuple, b: tuple, alone: bool, eps: float) -> pa.RecordBatch:
    names, at = np.unique(np.concatenate([a[4], b[4]]), return_inverse=True)
    u, v = at[: len(a[4])], at[len(a[4]) :]
    label = np.arange(len(names))
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # point, core, distance
    for x, y in near_pairs(a[0], b[0], eps):
        p, q = a[3][x], b[3][y]
        label = merged(label, u[x[p & q]], v[y[p & q]])
        for edge, core, i, j, only in ((a, b, x, y, ~p & q), (b, a, y, x, ~q & p)):
            only = only & edge[5][i]
            if (edge is a or not alone) and only.any():
                i, j = i[only], j[only]
                d = np.concatenate([distances(edge[0][i[k : k + AGAIN]], core[0][j[k : k + AGAIN]]) for k in range(0, len(i), AGAIN)])
                best = [np.concatenate(c) for c in zip(best, (edge[1][i], core[1][j], d), strict=True)]
                order = np.lexsort((best[1], best[2], best[0]))
                first = order[np.r_[True, np.diff(best[0][order]) != 0]]
                best = [c[first] for c in best]
    moved = np.flatnonzero(label != np.arange(len(names)))
    distance = np.concatenate([np.zeros(len(moved)), best[2]])
    return _batch(
        np.concatenate([names[moved], best[0]]), np.concatenate([names[label[moved]], best[1]]),
        pa.array(distance, mask=np.arange(len(distance)) < len(moved)),
    )
