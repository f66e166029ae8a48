"""A persisted index for nearest vectors: cells around centroids, with codes of what is left over.

Vectors are dealt to the cell of their nearest centroid and kept in a Parquet table partitioned by cell, in order of id, with
a code of a few bytes: the residual's parts, each as its nearest entry of a code book. A search looks at the cells nearest
to the query only (partition pruning), ranks their rows by codes (one narrow column), and reads the vectors of the best
candidates for exact distances. With `exact`, cells are visited until the triangle inequality rules the others out: no
vector of a cell is nearer than the distance to its centroid less the cell's radius.

Centroids and code books are fitted on a bounded sample (`SAMPLE` vectors a cell, the smallest hashes of ids); every vector
is indexed. There are `MOST_CELLS` cells at most, so what a search or a task holds of the model is bounded. Vectors of
another length than the index's have no distance and are left out, as are nulls, like in the exact scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import checkpointed, find_package
from .vectors import _matrix, l2, top_k

MOST_CELLS = 1024
SAMPLE = 64
#: Dimensions that one byte of a code stands for, and entries of a code book at most.
PART = 4
ENTRIES = 256
#: Vectors and queries that meet in one group at most, about.
ROWS, QUERIES = 20_000, 1_000


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the place of the nearest centre, and the distance."""
    out, far = np.empty(len(points), np.int64), np.empty(len(points))
    norms = (centres**2).sum(axis=1)
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        d = norms - 2 * part @ centres.T
        out[at : at + 4096] = best = d.argmin(axis=1)
        far[at : at + 4096] = np.sqrt(((part - centres[best]) ** 2).sum(axis=1))
    return out, far


def k_means(points: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """k centres at most; one that loses all its points moves to the point that is worst off."""
    rng = np.random.default_rng(seed)
    different = np.unique(points, axis=0)
    k = min(k, len(different))
    centres = different[rng.choice(len(different), k, replace=False)].copy() if k else points[:0]
    for _ in range(rounds if k else 0):
        own, far = nearest(points, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        for empty, worst in zip(np.flatnonzero(~filled), np.argsort(-far), strict=False):
            centres[empty] = points[worst]
    return centres


class Model:
    """Centroids (cells x dim) and code books (parts x entries x PART); the last part may be padded with zeros."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray):
        self.centroids, self.books = centroids, books

    @classmethod
    def fitted(cls, points: np.ndarray, cells: int) -> Model:
        centroids = k_means(points, cells)
        own, _ = nearest(points, centroids) if len(points) else (np.zeros(0, int), None)
        parts = _parts(points - centroids[own] if len(points) else points)
        books = [k_means(parts[:, j], ENTRIES, rounds=8, seed=j) for j in range(parts.shape[1])]
        most = max((len(b) for b in books), default=0)
        padded = [np.concatenate([b, np.full((most - len(b), PART), np.inf)]) for b in books]
        return cls(centroids, np.array(padded).reshape(len(books), most, PART))

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        parts = _parts(residuals)
        return np.stack([nearest(parts[:, j], self.entries(j))[0] for j in range(parts.shape[1])], axis=1).astype(np.uint8)

    def entries(self, j: int) -> np.ndarray:
        return self.books[j][np.isfinite(self.books[j][:, 0])]

    def table(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of a residual's parts to the entries of all books."""
        return ((_parts(residual[None])[0][:, None] - self.books) ** 2).sum(axis=2)


def _parts(points: np.ndarray) -> np.ndarray:
    """points x parts x PART, padded with zeros."""
    n, dim = points.shape
    out = np.zeros((n, -(-dim // PART) * PART))
    out[:, :dim] = points
    return out.reshape(n, -1, PART)


def _vectors(embeddings: DataFrame, id_column: str) -> DataFrame:
    return embeddings.select(F.col(id_column).cast("long").alias("photo_id"), "embedding").where("photo_id is not null and embedding is not null")


def build(embeddings: DataFrame, path: str, cells: int | None = None, id_column: str = "photo_id", sample: int = SAMPLE) -> VectorIndex:
    """Writes the index to a new folder that all executors share, and opens it. cells: by default the square root of the
    number of vectors. A cell of many vectors is dealt to several tasks and files."""
    spark = embeddings.sparkSession
    find_package(spark)
    rows = _vectors(embeddings, id_column)
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("embedding")).count().orderBy(F.desc("count"), F.col("size(embedding)")).limit(1).collect()}
    dim, total = next(iter(lengths.items()), (0, 0))
    cells = max(1, min(cells or round(total**0.5), MOST_CELLS))
    rows = rows.where(F.size("embedding") == dim)
    h, most = F.xxhash64("photo_id"), sample * cells
    share = 2 * most / max(total, 1)
    some = rows.where(h < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else rows
    found = [r.embedding for r in some.orderBy(h, "photo_id").limit(most).toLocalIterator()]
    points = np.array(found, np.float64).reshape(len(found), dim)
    model = Model.fitted(points, cells) if dim and total else Model(np.zeros((0, dim)), np.zeros((0, 0, PART)))
    own = np.bincount(nearest(points, model.centroids)[0], minlength=cells) if dim and total else np.zeros(1, int)
    files = np.maximum(1, np.ceil(own / max(len(points), 1) * total / ROWS)).astype(int).tolist()  # by its share of the sample
    held = spark.sparkContext.broadcast(model)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            fit, matrix = _matrix(b.column(1), dim)
            cell, far = nearest(matrix, m.centroids)
            codes = m.codes(matrix - m.centroids[cell])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(fit)), pa.array(cell, pa.int32()), pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1).take(pa.array(fit)).cast(pa.list_(pa.float32()))],
                names=["photo_id", "cell", "far", "code", "embedding"],
            )

    columns = "photo_id long, cell int, far double, code binary, embedding array<float>"
    dealt = rows.mapInArrow(deal, columns) if dim and total else spark.createDataFrame([], columns)
    slot = F.pmod(F.xxhash64("photo_id"), F.element_at(F.array(*map(F.lit, files)), F.col("cell") + 1))
    dealt.repartition("cell", slot).sortWithinPartitions("cell", "photo_id").write.partitionBy("cell").parquet(f"{path}/vectors")
    stats = _table(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    stats.write.parquet(f"{path}/cells")
    kept = [(0, i, c.tolist()) for i, c in enumerate(model.centroids)] + [
        (1 + j, i, e.tolist()) for j in range(len(model.books)) for i, e in enumerate(model.entries(j))
    ]
    spark.createDataFrame(kept, "book int, entry int, vector array<double>").coalesce(1).write.parquet(f"{path}/model")
    return VectorIndex(spark, path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    schema = "photo_id long, far double, code binary, embedding array<float>, cell int"
    return spark.read.schema(schema).parquet(f"{path}/vectors")


class VectorIndex:
    """An index that `build` wrote, whichever session did."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        find_package(spark)
        by_book: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/model").orderBy("book", "entry").collect():  # bounded by cells and entries
            by_book.setdefault(r.book, []).append(r.vector)
        vectors = by_book.pop(0, [])
        centroids = np.array(vectors, np.float64).reshape(len(vectors), -1 if vectors else 0)
        most = max((len(b) for b in by_book.values()), default=0)
        books = [np.concatenate([np.array(b).reshape(-1, PART), np.full((most - len(b), PART), np.inf)]) for _, b in sorted(by_book.items())]
        self.model = Model(centroids, np.array(books).reshape(len(books), most, PART))
        self.counts, self.radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        for r in spark.read.parquet(f"{path}/cells").collect():
            self.counts[r.cell], self.radius[r.cell] = r.n, r.radius
        self._held = spark.sparkContext.broadcast((centroids, self.counts > 0, self.radius))
        self._model = spark.sparkContext.broadcast(self.model)

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The indexed vectors of some cells; of all for None."""
        table = _table(self.spark, self.path)
        return table if cells is None else table.where(F.col("cell").isin([int(c) for c in cells]))

    def _by_distance(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(((self.model.centroids - query) ** 2).sum(axis=1)) if len(self.model.centroids) else np.zeros(0)
        full = np.flatnonzero(self.counts)
        return full[np.argsort(d[full], kind="stable")], d

    def probed(self, query: Sequence[float], probes: int) -> list[int]:
        return self._by_distance(np.asarray(query, np.float64))[0][:probes].tolist()

    def search(self, query: Sequence[float], k: int = 20, probes: int = 8, candidates: int | None = None, exact: bool = False) -> DataFrame:
        """photo_id and distance of the k nearest vectors of the `probes` nearest cells, ranked by codes and then, the
        best `candidates` of them (10 * k), by their vectors; equal distances by id. exact: of all vectors."""
        if k < 1:
            raise ValueError("k must be 1 or more")
        q = np.asarray(query, np.float64)
        if len(self.model.centroids) and len(q) != self.model.centroids.shape[1]:
            return top_k(self.rows([]), q, k)
        cells, d = self._by_distance(q)
        best = self._candidates(q, cells[:probes].tolist(), candidates or 10 * k)
        found = self.rows({r.cell for r in best}).where(F.col("photo_id").isin([r.photo_id for r in best]))
        if not exact:
            return top_k(found, q, k)
        so_far = [r.distance for r in top_k(found, q, k).collect()]
        bound = so_far[-1] if len(so_far) == k else np.inf
        return top_k(self.rows([c for c in cells.tolist() if d[c] - self.radius[c] <= bound + 1e-6 * (1 + d[c])]), q, k)

    def _candidates(self, q: np.ndarray, cells: list[int], most: int) -> list:
        model = self.model
        tables = {c: model.table(q - model.centroids[c]) for c in cells}

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(2).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                d = np.empty(b.num_rows)
                for c in np.unique(own).tolist():
                    at = own == c
                    d[at] = tables[c][np.arange(codes.shape[1]), codes[at]].sum(axis=1)
                best = pa.array(np.argsort(d, kind="stable")[:most])
                yield pa.RecordBatch.from_arrays([b.column(0).take(best), b.column(2).take(best), pa.array(d).take(best)], names=["photo_id", "cell", "near"])

        ranked = self.rows(cells).select("photo_id", "code", "cell").mapInArrow(rank, "photo_id long, cell int, near double")
        return ranked.orderBy("near", "photo_id").limit(most).collect()  # `most` rows

    def search_many(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, candidates: int | None = None) -> DataFrame:
        """query_id, photo_id, distance, rank of the k nearest vectors of each row of queries (query_id, embedding). Queries
        meet the vectors of a cell in groups of bounded size, however many of either a cell has. candidates: they meet
        codes first, and only so many vectors a query are looked at. exact: the cells that the triangle inequality does
        not rule out by then are searched too, by their vectors."""
        own = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<float>")).where("embedding is not null")
        sent = self._sent(own.withColumn("bound", F.lit(None).cast("double")), probes)
        first = self._met(sent, k, None) if candidates is None else self._refined(self._met(sent, candidates, "code"), own, candidates)
        order = Window.partitionBy("query_id").orderBy("distance", "photo_id")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not exact:
            return ranked(first)
        first = checkpointed(ranked(first))
        bounds = first.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
        rest = own.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        if candidates is not None:  # codes may have passed a vector of any cell over
            return ranked(self._met(self._sent(rest, 0), k, None))
        return ranked(first.drop("rank").unionByName(self._met(self._sent(rest, probes), k, None)))

    def _refined(self, found: DataFrame, queries: DataFrame, most: int) -> DataFrame:
        """Exact distances of the best candidates (column distance: by codes) of each query."""
        order = Window.partitionBy("query_id").orderBy("distance", "photo_id")
        best = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("query_id", "photo_id", "cell")
        both = best.join(self.rows().select("photo_id", "cell", F.col("embedding").alias("_v")), ["photo_id", "cell"]).join(queries, "query_id")
        return both.select("query_id", "photo_id", l2(F.col("_v"), F.col("embedding")).alias("distance"))

    def _sent(self, queries: DataFrame, probes: int) -> DataFrame:
        """A row for each query and cell to look at: the `probes` nearest, or with a bound all further ones within it."""
        held, dim = self._held, self.model.centroids.shape[1] if len(self.model.centroids) else 0

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, full, radius = held.value
            for b in batches:
                fit, matrix = _matrix(b.column(1), dim)
                rows, cells = [], []
                for i, q in zip(fit.tolist(), matrix, strict=True):
                    d = np.where(full, np.sqrt(((centroids - q) ** 2).sum(axis=1)), np.inf)
                    order = np.argsort(d, kind="stable")[: int(full.sum())]
                    bound = b.column(2)[i].as_py()
                    take = order[:probes] if bound is None else (rest := order[probes:])[d[rest] - radius[rest] <= bound + 1e-6 * (1 + d[rest])]
                    rows += [i] * len(take)
                    cells += take.tolist()
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cells, pa.int32())], names=["query_id", "embedding", "cell"])

        return queries.select("query_id", "embedding", "bound").mapInArrow(send, "query_id long, embedding array<float>, cell int")

    def _met(self, sent: DataFrame, k: int, by: str | None) -> DataFrame:
        """query_id, photo_id, distance (and cell, if by codes) of the k best of each group that a query meets."""
        sent = checkpointed(sent)
        asked = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
        salts = [max(1, -(-int(n) // ROWS)) for n in self.counts]
        blocks = [max(1, -(-asked.get(c, 0) // QUERIES)) for c in range(len(self.counts))]
        of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers or [1])), F.col("cell") + 1)
        spread = lambda numbers, name: F.explode(F.sequence(F.lit(0), of(numbers) - 1)).alias(name)
        dealt = lambda name, numbers: F.pmod(F.xxhash64(name), of(numbers)).cast("int")
        left = sent.select("query_id", "embedding", "cell", dealt("query_id", blocks).alias("block"), spread(salts, "salt"))
        what = by or "embedding"
        rows = self.rows(sorted(asked)).select("photo_id", what, "cell", dealt("photo_id", salts).alias("salt"), spread(blocks, "block"))
        held = self._model

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if a.num_rows and b.num_rows:
                points = np.stack(a.column("embedding").to_numpy()).astype(np.float64)
                own, cell = b.column("photo_id").to_numpy(), a.column("cell")[0].as_py()
                if by:
                    codes = np.frombuffer(b"".join(b.column(by).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    m, places = held.value, np.arange(codes.shape[1])
                    far = lambda q: np.sqrt(m.table(q - m.centroids[cell])[places, codes].sum(axis=1))
                else:
                    vectors = np.stack(b.column(what).to_numpy()).astype(np.float64)
                    far = lambda q: np.sqrt(((vectors - q) ** 2).sum(axis=1))
                for name, q in zip(a.column("query_id").to_numpy(), points, strict=True):
                    d = far(q)
                    best = np.lexsort((own, d))[:k]
                    for column, x in zip(out, (np.full(len(best), name), own[best], d[best], np.full(len(best), cell)), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
            columns = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types, strict=True)]
            return pa.Table.from_arrays(columns, names=["query_id", "photo_id", "distance", "cell"])

        key = ("cell", "salt", "block")
        met = left.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, "query_id long, photo_id long, distance double, cell int")
        return met if by else met.drop("cell")

    def share_read(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id and the share of all indexed rows that lie in the cells a search looks at."""
        counts = F.array(*(F.lit(int(n)) for n in self.counts)) if len(self.counts) else F.array(F.lit(0))
        sent = self._sent(queries.select("query_id", "embedding", F.lit(None).cast("double").alias("bound")), probes)
        return sent.groupBy("query_id").agg((F.sum(F.element_at(counts, F.col("cell") + 1)) / float(max(self.counts.sum(), 1))).alias("share"))
