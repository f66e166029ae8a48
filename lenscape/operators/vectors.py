"""Exact nearest vectors by Euclidean distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """In double precision. Built-in and compiled, but for the lambda; vectors of other lengths have no distance."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    same = F.size(a) == F.size(b)
    return F.when(same, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def _matrix(vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of that length, and these vectors in double precision, from the batch's own buffer."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(lengths == dim)
    if len(fit) == len(lengths):
        own = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(fit), dim)
    else:
        own = np.array([vectors[int(i)].as_py() for i in fit]).reshape(len(fit), dim)
    return fit, own.astype(np.float64)


def top_k(embeddings: DataFrame, query: Sequence[float], k: int = 10, id_column: str = "photo_id") -> DataFrame:
    """id and distance of the k nearest vectors; equal distances by id. A scan that keeps k rows for each task and merges
    them: nothing else is shuffled. The distances of a batch are one product of arrays."""
    if not 1 <= k:
        raise ValueError("k must be 1 or more")
    q = np.asarray(query, dtype=np.float64)

    def nearest(batches):
        for b in batches:
            fit, matrix = _matrix(b.column(1), len(q))
            if not len(fit):
                continue
            d = np.sqrt(((matrix - q) ** 2).sum(axis=1))
            own = b.column(0).to_numpy(zero_copy_only=False)[fit]
            best = np.lexsort((own, d))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(own[best], pa.int64()), pa.array(d[best])], names=["id", "distance"])

    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), "embedding").where("id is not null and embedding is not null")
    found = rows.mapInArrow(nearest, "id long, distance double").orderBy("distance", "id").limit(k)
    return found.withColumnRenamed("id", id_column)


def top_k_builtin(embeddings: DataFrame, query: Sequence[float], k: int = 10, id_column: str = "photo_id") -> DataFrame:
    """The same by built-in functions only."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = embeddings.select(id_column, l2(F.col("embedding"), q).alias("distance")).where("distance is not null")
    return d.orderBy("distance", id_column).limit(k)


def search(
    catalog: DataFrame, embeddings: DataFrame, query: Sequence[float], k: int = 20, fresh_only: bool = False
) -> DataFrame:
    """Catalog rows of the k nearest vectors with rank and distance, in order. The k nearest are found first, then
    joined; vectors without a catalog row drop out, so fewer may be left. A vector stays searchable while its file waits
    for a new one, unless fresh_only."""
    if not 1 <= k <= 100:
        raise ValueError("1 to 100 results")
    if fresh_only:
        done = catalog.where("embedding_status = 'completed'").select(F.col("id").alias("photo_id"))
        embeddings = embeddings.join(done, "photo_id", "left_semi")
    from pyspark.sql import Window

    nearest = top_k(embeddings, query, k)
    ranked = nearest.select(
        F.col("photo_id").alias("id"), "distance", F.row_number().over(Window.orderBy("distance", "photo_id")).alias("rank")
    )
    return catalog.join(F.broadcast(ranked), "id").orderBy("rank")


def search_text(catalog: DataFrame, embeddings: DataFrame, text: str, embed, k: int = 20) -> DataFrame:
    """embed: text -> vector, a model's text tower."""
    if not text or not text.strip():
        raise ValueError("an empty query")
    return search(catalog, embeddings, embed(text), k)


def vector_of(embeddings: DataFrame, photo_id: int) -> list[float] | None:
    row = embeddings.where(F.col("photo_id") == photo_id).select("embedding").first()
    return row and row.embedding


def search_like(catalog: DataFrame, embeddings: DataFrame, photo_id: int, k: int = 20) -> DataFrame:
    """Search by a stored picture."""
    vector = vector_of(embeddings, photo_id)
    if vector is None:
        raise LookupError("no vector for this photo")
    return search(catalog, embeddings, vector, k)


def all_distances(embeddings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, photo_id, distance of every pair of a small table of queries (checked: QUERIES at most) and all vectors."""
    rows = queries.select(F.col("query_id").cast("long"), "embedding").limit(QUERIES + 1).collect()
    if len(rows) > QUERIES:
        raise ValueError(f"more than {QUERIES} queries: use nearest_of_many")
    return _blocks(embeddings, [(r[0], r[1]) for r in rows], None)


#: Queries that one pass over the vectors answers.
QUERIES = 1_024


#: Vectors that meet a block of queries in one group, about.
ROWS = 20_000


def nearest_of_many(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, photo_id, distance, rank: the k nearest vectors of each query. Up to QUERIES queries go to the tasks that
    scan the vectors, which keep the k best of each; more are dealt out in blocks, each of which meets all parts of the
    vectors. Vectors of another length than a query's have no distance."""
    from pyspark.sql import Window

    own = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding IS NOT NULL")
    few = own.limit(QUERIES + 1).collect()
    if len(few) <= QUERIES and len({len(r[1]) for r in few}) <= 1:
        found = _blocks(embeddings, [(r[0], r[1]) for r in few], k)
    else:
        found = _dealt(embeddings, own, k)
    order = Window.partitionBy("query_id").orderBy("distance", "photo_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dealt(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = embeddings.select(F.col("photo_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"), F.size("embedding").alias("dim"))
    rows = rows.where("embedding IS NOT NULL AND photo_id IS NOT NULL")
    queries = queries.withColumn("dim", F.size("embedding"))
    blocks, parts = max(1, -(-queries.count() // QUERIES)), max(1, -(-rows.count() // ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "embedding", "dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    right = rows.select("photo_id", "embedding", "dim", every(blocks).alias("block"), F.pmod(F.xxhash64("photo_id"), F.lit(parts)).cast("int").alias("part"))
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    key = ("dim", "block", "part")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if a.num_rows and b.num_rows:
            points, vectors = (np.stack(t.column(c).to_numpy()).astype(np.float64) for t, c in ((a, "embedding"), (b, "r_embedding")))
            own = b.column("r_photo_id").to_numpy()
            for name, q in zip(a.column("query_id").to_numpy(), points, strict=True):
                d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
                best = np.lexsort((own, d))[:k]
                for column, x in zip(out, (np.full(len(best), name), own[best], d[best]), strict=True):
                    column.append(x)
        return pa.table(dict(zip(("query_id", "photo_id", "distance"), map(np.concatenate, out), strict=True)))

    return left.groupBy(*key).cogroup(right.groupBy(*(f"r_{c}" for c in key))).applyInArrow(meet, "query_id long, photo_id long, distance double")


def _blocks(embeddings: DataFrame, queries: list, k: int | None) -> DataFrame:
    names = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64) if queries else np.zeros((0, 0))

    def run(batches):
        for b in batches:
            if not len(names):
                continue
            fit, rows = _matrix(b.column(1), matrix.shape[1])
            ids = b.column(0).to_numpy(zero_copy_only=False)[fit]
            for at in range(0, len(rows), 1024):
                part, own = rows[at : at + 1024], ids[at : at + 1024]
                d = np.stack([np.sqrt(((part - q) ** 2).sum(axis=1)) for q in matrix])
                if k is None or k >= d.shape[1]:
                    take = np.tile(np.arange(d.shape[1]), (len(names), 1))
                else:
                    take = np.stack([np.lexsort((own, row))[:k] for row in d])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, take.shape[1])), pa.array(own[take].ravel()), pa.array(np.take_along_axis(d, take, 1).ravel())],
                    names=["query_id", "photo_id", "distance"],
                )

    rows = embeddings.select(F.col("photo_id").cast("long"), "embedding").where("embedding is not null and photo_id is not null")
    return rows.mapInArrow(run, "query_id long, photo_id long, distance double")
