import numpy as np
import pytest
from pyspark.sql import functions as F

from lenscape.operators import vector_index as vi
from lenscape.operators import vectors

SCHEMA = "photo_id long, embedding array<float>"


def brute(rows, queries, k):
    """{query: [(id, distance)]} by comparing all."""
    out = {}
    for name, q in queries:
        d = [(float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(q, np.float32).astype(float)) ** 2).sum())), i) for i, v in rows if i is not None and v and len(v) == len(q)]
        out[name] = [(i, round(x, 9)) for x, i in sorted(d)[:k]]
    return out


def many(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.photo_id, round(r.distance, 9)))
    return out


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """20 clusters, one of which holds a third of all rows; copies, nulls, and vectors of another length."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 12))
    own = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 20, 3000))
    points = centres[own] + rng.normal(scale=0.15, size=(3000, 12))
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    rows += [(5000 + i, rows[17][1]) for i in range(300)] + [(9001, None), (None, rows[3][1]), (9002, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA + ", cell string").repartition(5)
    path = f"file://{tmp_path_factory.mktemp('index')}/ix"
    vi.build(df, path, cells=32)
    return rows, path


def test_recall_and_exact_search(spark, clustered):
    rows, path = clustered
    queries = [(i, v) for i, v in rows if i is not None and i % 100 == 0 and v and len(v) == 12]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    index = vi.VectorIndex(spark, path)
    assert index.counts.sum() == 3300 and len(index.counts) <= 32
    want = brute(rows, queries, 20)
    assert many(index.search_many(asked, 20, probes=3, exact=True)) == want
    assert many(index.search_many(asked, 20, probes=3, exact=True, candidates=30)) == want
    ids = lambda found: {(q, i) for q, one in found.items() for i, _ in one}
    for how in ({"probes": 8}, {"probes": 8, "candidates": 120}):
        assert len(ids(many(index.search_many(asked, 20, **how))) & ids(want)) >= 0.95 * len(ids(want)), how
    shares = index.share_read(asked, 3).agg(F.max("share"), F.avg("share")).first()
    assert 0 < shares[1] <= shares[0] < 1


def test_groups_are_cut(spark, clustered, monkeypatch):
    rows, path = clustered
    queries = [(i, v) for i, v in rows[:40]]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    monkeypatch.setattr(vi, "ROWS", 50)
    monkeypatch.setattr(vi, "QUERIES", 3)
    assert many(vi.VectorIndex(spark, path).search_many(asked, 7, probes=2, exact=True)) == brute(rows, queries, 7)


def test_one_query(spark, clustered):
    rows, path = clustered
    index = vi.VectorIndex(spark.newSession(), path)  # reopened
    q = rows[17][1]
    want = brute(rows, [(0, q)], 25)[0]
    assert [(r.photo_id, round(r.distance, 9)) for r in index.search(q, 25, exact=True).collect()] == want
    assert [(r.photo_id, round(r.distance, 9)) for r in index.search(q, 25, probes=6, candidates=400).collect()] == want
    assert index.search([0.0] * 5, 3).collect() == [] and len(index.search(q, 5000, exact=True).collect()) == 3300
    with pytest.raises(ValueError):
        index.search(q, 0)


def test_cells_prune_files_and_columns(spark, clustered):
    _, path = clustered
    index = vi.VectorIndex(spark, path)
    cells = index.probed([0.0] * 12, 2)
    plan = index.rows(cells).select("photo_id", "code", "cell")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "embedding" not in plan.split("ReadSchema")[1]
    assert len(index.rows(cells).inputFiles()) >= 2 and len(index.rows().inputFiles()) > len(index.rows(cells).select("code").where("photo_id >= 0").inputFiles()) - 1


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0])], [(i, [1.0, 2.0]) for i in range(30)], [(1, None), (None, [1.0])]])
def test_small_tables(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    index = vi.build(df, f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "query_id long, embedding array<float>")
    want = brute(rows, [(7, [1.0, 1.0])], 3)
    assert many(index.search_many(asked, 3, exact=True)) == {k: v for k, v in want.items() if v}
    assert [r.photo_id for r in index.search([1.0, 1.0], 3).collect()] == [i for i, _ in want[7]]


def test_code_distances_are_near(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 10))
    model = vi.Model.fitted(points, 16)
    own, _ = vi.nearest(points, model.centroids)
    codes = model.codes(points - model.centroids[own])
    q = rng.normal(size=10)
    near = np.sqrt([model.table(q - model.centroids[c])[np.arange(3), code].sum() for c, code in zip(own, codes, strict=True)])
    exact = np.sqrt(((points - q) ** 2).sum(axis=1))
    assert np.corrcoef(near, exact)[0, 1] > 0.95
    assert vectors.top_k  # the scan that the index is compared with


def test_many_queries_are_dealt_out(spark, clustered, monkeypatch):
    rows, _ = clustered
    queries = [(i, v) for i, v in rows[:60]] + [(9100, [1.0] * 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    want = brute(rows, queries, 6)
    assert many(vectors.nearest_of_many(df, asked, 6)) == want
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "ROWS", 400)
    assert many(vectors.nearest_of_many(df, asked, 6)) == want
    assert vectors.nearest_of_many(df.limit(0), asked, 6).count() == 0 and vectors.nearest_of_many(df, asked.limit(0), 6).count() == 0
