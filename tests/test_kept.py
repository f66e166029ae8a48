import os
import random

import pytest
from pyspark.sql import functions as F

from lenscape.operators import folders, kept, upsert
from lenscape.schema import PHOTOS, RESULT

NAMES = [f.name for f in PHOTOS]


def results(spark, rows):
    """rows: path, size, is_raw, success."""
    full = [
        dict(zip((f.name for f in RESULT), [None] * len(RESULT))) | {"path": p, "name": p.rsplit("/", 1)[-1], "size": s, "created_ms": 1000.0 * s, "modified_ms": 2000.0 * s, "is_raw": r, "success": ok, "phash": "h" if s % 2 else None}
        for p, s, r, ok in rows
    ]
    return spark.createDataFrame([tuple(r[f.name] for f in RESULT) for r in full], RESULT)


def seen(df):
    return sorted(df.select(*NAMES).collect(), key=lambda r: r.id)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def random_rows(rng, n):
    deep = lambda: "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5)))
    return [(f"{deep()}/{rng.randrange(40)}.jpg".lstrip("/"), rng.randrange(1, 99), rng.choice((True, False, None)), rng.random() < 0.9) for _ in range(n)]


def rebuilt(photos):
    tree = folders.totals(folders.tree(photos)).select("path", "depth", "photo_count", "total_count")
    return sorted(map(tuple, tree.collect()))


@pytest.fixture
def store(spark, tmp_path):
    made = kept.Catalog(spark, f"file://{tmp_path}/store", slots=16, buckets=4), kept.Tree(spark, f"file://{tmp_path}/store", slots=16, buckets=4)
    yield made
    for one in made:
        one.close()


def test_batches_equal_a_whole_upsert_and_a_rebuilt_tree(spark, store):
    catalog, tree = store
    rng = random.Random(5)
    whole = spark.createDataFrame([], PHOTOS)
    for n in (40, 1, 25, 0, 3):
        batch = results(spark, random_rows(rng, n))
        whole = spark.createDataFrame(upsert.upsert(whole, batch).select(*NAMES).collect(), PHOTOS)
        tree.apply(catalog.upsert(batch))
        assert seen(catalog.rows()) == seen(whole)
        got = tree.folders()
        assert sorted(map(tuple, got.select("path", "depth", "photo_count", "total_count").collect())) == rebuilt(whole)
        raw_paths = [r.path for r in whole.where("is_raw").collect()]
        assert all(r.raw_count == sum(p.startswith(r.path + "/") for p in raw_paths) for r in got.collect())
        assert tuple(tree.library().first() or (0, 0)) == (whole.count(), whole.where("is_raw").count())


def test_removed_folders_leave_the_tree(spark, store):
    catalog, tree = store
    tree.apply(catalog.upsert(results(spark, [("a/b/1.jpg", 1, True, True), ("a/2.jpg", 2, False, True), ("3.jpg", 3, None, True)])))
    left = catalog.rows().where("path <> 'a/b/1.jpg'")
    tree.apply(catalog.load(spark.createDataFrame(left.collect(), PHOTOS)))
    assert [tuple(r)[:1] + tuple(r)[4:] for r in tree.folders().collect()] == [("a", 1, 1, 0)]
    assert tuple(tree.library().first()) == (2, 0) and catalog.rows().count() == 2


def test_untouched_files_stay_and_ids_follow_all(spark, store, tmp_path):
    catalog, tree = store
    tree.apply(catalog.upsert(results(spark, [(f"d{i % 7}/{i}.jpg", 5, False, True) for i in range(300)])))
    before = files(tmp_path / "store/photos/rows")
    touched = catalog.table.touched(spark.createDataFrame([("d1/new.jpg",)], "path string"))
    tree_before = files(tmp_path / "store/folders/rows")
    tree.apply(catalog.upsert(results(spark, [("d1/new.jpg", 7, True, True)])))
    after = files(tmp_path / "store/photos/rows")
    changed = {p for p in before if after.get(p) != before[p]} | (set(after) - set(before))
    assert len(touched) == 1 and changed and all(f"/slot={touched[0]}/" in p for p in changed)
    kept_folders = {p for p in tree_before if files(tmp_path / "store/folders/rows").get(p) == tree_before[p]}
    assert kept_folders and len(kept_folders) < len(tree_before)
    assert catalog.rows().agg(F.max("id")).first()[0] == 301 == catalog.rows().where("path = 'd1/new.jpg'").first().id


def test_no_exchange_on_the_catalog_side(spark, store):
    catalog, _ = store
    catalog.upsert(results(spark, [(f"{i}.jpg", 5, False, True) for i in range(50)]))
    batch = spark.createDataFrame([("1.jpg", 1)], "path string, n int")
    plan = catalog.table.rows([1, 2, 3]).join(batch.hint("merge"), "path", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "PartitionFilters: [slot" in plan.replace("isnotnull(slot#", "slot#") + plan
    assert plan.count("Exchange hashpartitioning") == 1  # the batch's


def test_a_journal_is_finished_when_the_table_is_opened(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    first = kept.Catalog(spark, root, slots=4, buckets=2)
    first.upsert(results(spark, [("a/1.jpg", 1, True, True)]))
    monkeypatch.setattr(kept.KeptTable, "_finish", lambda self: None)
    first.table.publish(first.rows().withColumn("size", F.lit(99)), list(range(4)))  # the driver is lost before the overwrite
    assert first.rows().first().size == 1
    monkeypatch.undo()
    first.close()
    again = kept.Catalog(spark, root, slots=32, buckets=7)
    assert (again.table.slots, again.table.buckets) == (4, 2)
    assert again.rows().first().size == 99 and not (tmp_path / "store/photos/journal").exists()
    again.upsert(results(spark, [("a/2.jpg", 1, True, True)]))
    assert {r.path: r.id for r in again.rows().collect()} == {"a/1.jpg": 1, "a/2.jpg": 2}
    again.close()
