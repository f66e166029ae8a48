"""Queries of what the library keeps between runs: indexes, stores and layouts, each made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import density, geo, kept, kept_list, timed, vector_index, vectors
from ..workers import checkpointed, remove, shared_folder
from .assets import cte, read
from .queries import _RESULTS, _TREE, SQL, _catalog, _nearest_sql, _results, _vector, query

col, lit = F.col, F.lit

# --- vectors -------------------------------------------------------------------------------------------------------


def _with_index(spark: SparkSession, sf: str, use) -> DataFrame:
    """What use(index, vectors, queries) gives, computed while the index is there. Queries: vectors whose id is divisible by
    100."""
    folder = shared_folder(spark, "vectors")
    try:
        rows = read(spark, sf, "sidecar")
        vector_index.build(rows, folder)
        asked = rows.where("photo_id % 100 = 0").select(col("photo_id").alias("query_id"), "embedding")
        opened = vector_index.VectorIndex(spark, folder)  # by what its folder holds, as another session would
        return checkpointed(use(opened, rows, asked))
    finally:
        remove(spark, folder)


_MANY = """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS photo_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, photo_id) AS rank FROM d)"""


@query("k1_index_exact", f"{_MANY} SELECT query_id, photo_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def _(spark, sf):
    """The index's own exact way: cells are searched until the triangle inequality rules the others out."""
    return _with_index(spark, sf, lambda index, _, asked: index.search_many(asked, 20, probes=4, exact=True).withColumn("distance", F.round("distance", 6)))


@query("k1_index_recall", "SELECT vec_id AS query_id, TRUE AS recalled, TRUE AS few_read FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, sf):
    """Whether the 20 nearest by codes hold at least 0.95 of the exact ones, over all queries, while less than a fifth of the
    vectors are read for each."""

    def use(index, rows, asked):
        total = int(index.counts.sum())
        most = min(200, total * 19 // 100)
        found = index.search_many(asked, 20, probes=len(index.counts), candidates=most).select("query_id", "photo_id", lit(1).alias("hit"))
        want = vectors.nearest_of_many(rows, asked, 20).select("query_id", "photo_id")
        recall = want.join(found, ["query_id", "photo_id"], "left").agg(F.avg(F.coalesce("hit", lit(0))).alias("recall"))
        return asked.crossJoin(F.broadcast(recall)).select("query_id", (col("recall") >= 0.95).alias("recalled"), lit(5 * most < total).alias("few_read"))

    return _with_index(spark, sf, use)


@query("k3_index_search", f"{cte('sidecar')}{_nearest_sql(7, 10)} SELECT photo_id, round(d, 6) AS distance FROM top")
def _(spark, sf):
    """One stored picture's nearest: cells by partition, codes, then vectors; exact."""
    at = _vector(spark, sf, 7)
    return _with_index(spark, sf, lambda index, *_: index.search(at, 10, exact=True).withColumn("distance", F.round("distance", 6)))

# --- the catalog and the folder tree, changed in place ----------------------------------------------------------------


def _with_store(spark: SparkSession, sf: str, use) -> DataFrame:
    """What use(catalog, tree) gives after the assets were loaded and a scan's results were taken in."""
    folder = shared_folder(spark, "store")
    store, tree = kept.Catalog(spark, folder, slots=8, buckets=4), kept.Tree(spark, folder, slots=8, buckets=4)  # of a small library
    try:
        tree.apply(store.load(_catalog(spark, sf)))
        tree.apply(store.upsert(_results(spark, sf)))
        return checkpointed(use(store, tree))
    finally:
        store.close()
        tree.close()
        remove(spark, folder)


@query("snk1_upsert_in_place", SQL["snk1_upsert"])
def _(spark, sf):
    """The same upsert, into a table of slots and buckets of which only the touched ones are rewritten."""
    rows = lambda store, _: store.rows().select("id", "path", "size", "embedding_status", "phash_status", F.unix_seconds("created_at").alias("created_s"))
    return _with_store(spark, sf, rows)


_AFTER = f"""{cte('assets')}{_RESULTS}, g AS (SELECT path, is_raw FROM results WHERE success),
after AS (SELECT a.path, CASE WHEN g.path IS NULL THEN coalesce(a.is_raw, FALSE) ELSE g.is_raw END AS is_raw FROM assets a LEFT JOIN g ON g.path = a.path
 UNION ALL SELECT path, is_raw FROM g WHERE path NOT IN (SELECT path FROM assets))"""
_TREE_AFTER = f"""{_AFTER}{_TREE.replace('FROM assets', 'FROM after')}
SELECT path, name, parent_path, CAST(depth AS INT) AS depth, photo_count, (SELECT count(*) FROM after x WHERE starts_with(x.path, t.path || '/')) AS total_count,
 (SELECT count(*) FROM after x WHERE x.is_raw AND starts_with(x.path, t.path || '/')) AS raw_count FROM tree t"""


@query("a1_tree_by_changes", _TREE_AFTER)
def _(spark, sf):
    """The folder tree after a scan, kept by the differences that the scan made."""
    return _with_store(spark, sf, lambda _, tree: tree.folders())


@query("a3_library_by_changes", f"{_AFTER} SELECT count(*) AS photos, count(*) FILTER (is_raw) AS raws FROM after")
def _(spark, sf):
    return _with_store(spark, sf, lambda _, tree: tree.library())

# --- ordered lists -------------------------------------------------------------------------------------------------


def _with_list(spark: SparkSession, sf: str, use) -> DataFrame:
    folder = shared_folder(spark, "list")
    try:
        return checkpointed(use(kept_list.build(read(spark, sf, "assets").select("path", "id"), folder, "path", "id", ranges=8)))
    finally:
        remove(spark, folder)


_PLACES = f"{cte('assets')}, o AS (SELECT id, path, row_number() OVER (ORDER BY path, id) - 1 AS index, count(*) OVER () AS n FROM assets)"


@query("w1_kept_places", f"{_PLACES} SELECT id, index FROM o")
def _(spark, sf):
    return _with_list(spark, sf, lambda kept_one: kept_one.rows().select("id", "index"))


@query("w4_kept_range", f"{_PLACES} SELECT id, index FROM o WHERE index BETWEEN n // 3 AND 2 * n // 3")
def _(spark, sf):
    return _with_list(spark, sf, lambda kept_one: kept_one.between(2 * len(kept_one) // 3, len(kept_one) // 3).select("id", "index"))


@query("w2_kept_neighbours", f"{_PLACES} SELECT id, index FROM o WHERE abs(index - n // 2) <= 1")
def _(spark, sf):
    """Before, at and after the row in the middle, found by its place."""
    return _with_list(spark, sf, lambda kept_one: kept_one.neighbours(len(kept_one) // 2).select("id", "index"))

# --- joins by time -------------------------------------------------------------------------------------------------

_STATES = "e AS (SELECT seq, job_id, event_type FROM jobs WHERE event_type <> 'progress'), p AS (SELECT seq, job_id FROM jobs WHERE event_type = 'progress')"


def _events_and_states(spark, sf) -> tuple[DataFrame, DataFrame]:
    j = read(spark, sf, "jobs")
    return j.where("event_type = 'progress'").select("seq", "job_id"), j.where("event_type <> 'progress'").select("seq", "job_id", "event_type")


@query("j8_as_of_state", f"{cte('jobs')}, {_STATES} SELECT p.seq, p.job_id, e.seq AS state_seq, e.event_type AS state FROM p ASOF LEFT JOIN e ON p.job_id = e.job_id AND p.seq >= e.seq")
def _(spark, sf):
    """Each progress event with the last state of its job."""
    p, e = _events_and_states(spark, sf)
    found = timed.as_of(p, e, "job_id", "seq", prefix="state_", parts=8)
    return found.select("seq", "job_id", "state_seq", col("state_event_type").alias("state"))


@query("j9_interval_join", f"""{cte('jobs')}, {_STATES}, i AS (SELECT job_id, event_type, seq AS since, lead(seq) OVER (PARTITION BY job_id ORDER BY seq) AS until FROM e)
SELECT p.seq, p.job_id, i.since, i.event_type AS state FROM p JOIN i ON p.job_id = i.job_id AND p.seq >= i.since AND p.seq < i.until""")
def _(spark, sf):
    """Progress events with the spans between two states of their job that they fall into."""
    p, e = _events_and_states(spark, sf)
    order = Window.partitionBy("job_id").orderBy("seq")
    spans = e.select("job_id", col("event_type").alias("state"), col("seq").alias("since"), F.lead("seq").over(order).alias("until"))
    return timed.within(p, spans, "job_id", "seq", "since", "until").select("seq", "job_id", "since", "state")

# --- density clusters ----------------------------------------------------------------------------------------------

_EPS, _LEAST = 1.1, 3


@query("d_vector_clusters", f"""WITH RECURSIVE d AS (SELECT x.vec_id AS a, y.vec_id AS b, list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d FROM embeddings x, embeddings y),
n AS (SELECT * FROM d WHERE d <= {_EPS}), c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= {_LEAST}),
l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
r(id, root) AS (SELECT id, id FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
k AS (SELECT id, min(root) AS cluster FROM r GROUP BY id),
e AS (SELECT a AS id, arg_min(k.cluster, n.d) AS cluster FROM n JOIN k ON k.id = n.b WHERE a NOT IN (SELECT id FROM c) GROUP BY a)
SELECT v.vec_id AS photo_id, k.id IS NOT NULL AS core, coalesce(k.cluster, e.cluster) AS cluster FROM embeddings v LEFT JOIN k ON k.id = v.vec_id LEFT JOIN e ON e.id = v.vec_id""")
def _(spark, sf):
    """Photos of similar content, as faces of a person would be grouped."""
    return density.clusters(read(spark, sf, "sidecar"), _EPS, _LEAST)

# --- the map -------------------------------------------------------------------------------------------------------

_POINTS = f"{cte('exif')}, q AS (SELECT photo_id, try_cast(gps_latitude AS DOUBLE) AS lat, try_cast(gps_longitude AS DOUBLE) AS lon FROM exif), pt AS (SELECT photo_id, lat, CASE WHEN lon = 180 THEN -180 ELSE lon END AS lon FROM q WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"


@query("d_map_cells", f"""{_POINTS}, z AS (SELECT unnest(range(0, 9)) AS zoom)
SELECT CAST(zoom AS INT) AS zoom, CAST(floor((lon + 180) / 360 * (1 << zoom)) AS INT) AS x, CAST(least(floor((lat + 90) / 180 * (1 << zoom)), (1 << zoom) - 1) AS INT) AS y, count(*) AS photos FROM pt, z GROUP BY ALL""")
def _(spark, sf):
    return geo.counts(geo.located(read(spark, sf, "exif")), 8)


@query("d_photos_near", f"""{_POINTS}, k AS (SELECT photo_id, 2 * 6371.0088 * asin(sqrt(least(1, sin(radians(lat - 40) / 2) ** 2 + cos(radians(lat)) * cos(radians(40)) * sin(radians(lon - 20) / 2) ** 2))) AS km FROM pt)
SELECT photo_id, round(km, 6) AS km FROM k WHERE km <= 2500""")
def _(spark, sf):
    folder = shared_folder(spark, "map")
    try:
        geo.write(geo.located(read(spark, sf, "exif")), folder)
        return checkpointed(geo.within(spark, folder, 40.0, 20.0, 2500.0).select("photo_id", F.round("km", 6).alias("km")))
    finally:
        remove(spark, folder)
