import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lenscape.functions import media
from lenscape.operators import catalog, folders, hashing, navigation, progress, serving, upsert, vectors
from lenscape.schema import PHOTO_EMBEDDING, PHOTO_EXIF, PHOTOS, RESULT, create_tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(spark, column, rows, schema):
    return [r[0] for r in frame(spark, [(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_file_size(spark):
    sizes = [0, 1023, 1024, 1280, 1048575, 1048576, 1073741824, 5 * 2**40]
    assert values(spark, media.file_size(F.col("x")), sizes, "x long") == [
        "0 B", "1023 B", "1.0 KB", "1.3 KB", "1024.0 KB", "1.0 MB", "1.0 GB", "5120.0 GB",
    ]


def test_exposure_formats(spark):
    got = values(spark, media.shutter_speed(F.col("x")), [0.004, 1.0, 2.5, 0.0, -1.0, None, 1e-12], "x double")
    assert got == ["1/250", "1.0s", "2.5s", "1/4294967295", "1/0", None, "1/4294967295"]
    got = values(spark, media.exposure_bias(F.col("x")), [-0.3, 0.0, 0.25, 1.0, None], "x double")
    assert got == ["-0.3 EV", "0 EV", "+0.2 EV", "+1.0 EV", None]
    assert values(spark, media.aperture(F.col("x")), [2.8, 0.35, None], "x double") == ["f/2.8", "f/0.3", None]
    assert values(spark, media.saturated(F.col("x")), [-1.0, 3.9, 5e9, None, float("nan")], "x double") == [0, 3, 2**32 - 1, None, 0]


def test_heif_predicates(spark):
    names = ["photo.HEIC", "photo.heic", "photo.HEIF", "photo.heif", "photo.jpg", "photo.png"]
    assert values(spark, media.is_heif_file(F.col("x")), names, "x string") == [True] * 4 + [False] * 2
    heads = [b"\0\0\0\x24ftypheic", b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01", b"\0\0\0\x24ftyp", b"\0\0\0\x24ftypmp42"]
    assert values(spark, media.is_heif_content(F.col("x")), heads, "x binary") == [True, False, False, False]


def test_exif_json(spark):
    rows = ['{"Make": "A\\"B", "ISO": 100, "FNumber": 2.8}', '{"ISO": 320.0, "Make": null, "FocalLength": "50"}', '{"Make": 7}', "broken", None]
    got = values(spark, media.exif_from_json(F.col("x")), rows, "x string")
    assert (got[0].camera_make, got[0].iso, got[0].aperture) == ('A"B', 100, "f/2.8")
    assert (got[1].iso, got[1].camera_make, got[1].focal_length) == (None, None, None)
    assert got[2].camera_make == "7" and got[3] is None and got[4] is None


def test_paths(spark):
    paths = ["a/b.c/d.JPG", "x", "a.b/c", ".h", "foo."]
    assert values(spark, media.thumbnail_path(F.col("x"), F.lit("tiny")), paths, "x string") == [
        "tiny/a/b.c/d.webp", "tiny/x.webp", "tiny/a.b/c.webp", "tiny/.webp", "tiny/foo..webp",
    ]
    assert values(spark, media.native_stem(F.col("x")), paths, "x string") == ["a/b.c/d", "x", "a.b/c", ".h", "foo"]
    base = F.lit("/base/")
    assert values(spark, media.relative_path(F.col("x"), base), ["/base/a", "/basement/a"], "x string") == ["a", "/basement/a"]


def slow_tree(paths):
    nodes = {}
    for p in paths:
        cut = p.rfind("/")
        if cut <= 0:
            continue
        parts = p[:cut].split("/")
        for i in range(1, len(parts) + 1):
            key = "/".join(parts[:i])
            nodes.setdefault(key, 0)
        nodes[p[:cut]] += 1
    return nodes


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab/.é", min_size=1, max_size=9), max_size=12))
def test_folder_tree(spark, paths):
    got = folders.tree(frame(spark, [(p,) for p in paths], "path string")).collect()
    assert {r.path: r.photo_count for r in got} == slow_tree(paths)


def test_folder_edges(spark):
    paths = ["a/b/c.jpg", "x.jpg", "/x.jpg", "/a/b.jpg", "a//b.jpg"]
    nodes = folders.tree(frame(spark, [(p,) for p in paths], "path string"))
    by = {r.path: r for r in nodes.collect()}
    assert set(by) == {"a", "a/b", "", "/a", "a/"}
    assert by["a"].photo_count == 0 and by["/a"].photo_count == 1 and by["a/"].name == "" and by["/a"].parent_path == ""
    tree = folders.nested(nodes)
    assert [n["path"] for n in tree] == ["", "a"] and [c["path"] for c in tree[1]["children"]] == ["a/", "a/b"]
    with pytest.raises(ValueError, match="more than"):
        folders.nested(nodes, 2)
    assert {r.path: r.total_count for r in folders.totals(nodes).collect()}["a"] == 2


def test_folder_filters(spark):
    rows = [(1, "A/x.jpg", True), (2, "a/x.jpg", None), (3, "a/b/y.jpg", False), (4, "aXb/z.jpg", True), (5, "a_b/z.jpg", False), (6, "É/x", True)]
    a = frame(spark, rows, "id long, path string, is_raw boolean")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(catalog.photos(a, folder="a")) == [2]
    assert ids(catalog.photos(a, folder="a", sqlite_like=True)) == [1, 2]
    assert ids(catalog.photos(a, folder="a_b")) == [5] and ids(catalog.photos(a, folder="a_b", sqlite_like=True)) == [3, 4, 5]
    assert ids(catalog.photos(a, folder="é", sqlite_like=True)) == [] and ids(catalog.photos(a, folder="")) == [1, 2, 3, 4, 5, 6]
    assert ids(catalog.photos(a, folder="x!y'z", sqlite_like=True)) == []
    assert ids(catalog.photos(a, which="standard")) == [3, 5]
    with pytest.raises(ValueError):
        catalog.photos(a, which="other")
    with pytest.raises(catalog.NotFound):
        catalog.photo_or_error(a, 99)
    assert catalog.photo_or_error(a, 4).path == "aXb/z.jpg" and catalog.path_of(a, 5) == "a_b/z.jpg"


def result(path, size, phash="h", exif=None, ok=True, at=1500.0):
    return (path, path.rsplit("/", 1)[-1], size, 0.0, at, 4, 3, "image/png", phash, exif, False, None, None, None, ok, None if ok else "broken")


CAMERA = ("Canon",) + (None,) * 12


def test_upsert(spark):
    empty = frame(spark, [], PHOTOS)
    first = frame(spark, [result("b.png", 1, exif=CAMERA), result("a.png", 2, phash=None), result("bad.png", 3, ok=False)], RESULT)
    one = upsert.upsert(empty, first).checkpoint()
    rows = {r.path: r for r in one.collect()}
    assert {p: r.id for p, r in rows.items()} == {"a.png": 1, "b.png": 2}
    assert rows["a.png"].phash_status == "failed" and rows["b.png"].phash_status == "completed"
    assert rows["b.png"].created_at == datetime.datetime(1970, 1, 1) and rows["b.png"].modified_at == datetime.datetime(1970, 1, 1, 0, 0, 1)
    assert sorted(upsert.upsert(one, first).collect()) == sorted(one.collect())  # once more changes nothing
    done = one.withColumn("embedding_status", F.lit("completed"))
    second = frame(spark, [result("b.png", 9), result("b.png", 7, at=9000.0), result("c.png", 5)], RESULT)
    two = {r.path: r for r in upsert.upsert(done, second).collect()}
    assert (two["b.png"].id, two["b.png"].size, two["b.png"].embedding_status) == (2, 7, "pending")
    assert two["a.png"].embedding_status == "completed" and two["c.png"].id == 3
    exif = upsert.replaced(frame(spark, [], PHOTO_EXIF), upsert.exif_rows(one, first))
    kept = upsert.replaced(exif, upsert.exif_rows(one, second)).collect()
    assert [(r.photo_id, r.camera_make) for r in kept] == [(2, "Canon")]  # a scan without EXIF keeps the old row
    assert [r.error for r in upsert.rejected(first).collect()] == ["broken"]


def test_save_embeddings(spark):
    a = frame(spark, [(1, "pending"), (2, "pending"), (3, "completed")], "id long, embedding_status string")
    now = datetime.datetime(2024, 1, 1)
    old = frame(spark, [(2, [9.0], "m", now), (3, [8.0], "m", now)], PHOTO_EMBEDDING)
    batch = frame(spark, [(1, [1.0]), (2, None)], "photo_id long, embedding array<float>")
    new, side = upsert.save_embeddings(a, old, batch)
    assert dict(map(tuple, new.collect())) == {1: "completed", 2: "failed", 3: "completed"}
    assert {r.photo_id: r.embedding for r in side.collect()} == {1: [1.0], 2: [9.0], 3: [8.0]}


def test_store(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "t"))
    assert store.read("id long").count() == 0
    assert store.write(spark.range(3)) == 1 and store.write(spark.range(5)) == 2
    (tmp_path / "t" / "v000003").mkdir()  # a write that did not end
    assert store.read("id long").count() == 5


def test_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [1.0, 0.0])]
    e = frame(spark, rows, "photo_id long, embedding array<float>").repartition(3)
    a = frame(spark, [(1, "pending"), (2, "completed"), (6, "completed")], "id long, embedding_status string")
    got = [(r.photo_id, r.distance) for r in vectors.top_k(e, [0.0, 0.0], 10).collect()]
    assert got == [(1, 0.0), (3, 0.0), (6, 1.0), (2, 5.0)]
    assert [(r.photo_id, r.distance) for r in vectors.top_k_builtin(e, [0.0, 0.0], 10).collect()] == got
    assert [(r.id, r["rank"]) for r in vectors.search(a, e, [0.0, 0.0], 3).collect()] == [(1, 1), (6, 3)]
    assert [r.id for r in vectors.search(a, e, [0.0, 0.0], 3, fresh_only=True).collect()] == [6, 2]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            vectors.search(a, e, [0.0], bad)
    with pytest.raises(ValueError):
        vectors.search_text(a, e, "  ", lambda t: [0.0])
    with pytest.raises(LookupError):
        vectors.search_like(a, e, 77)


def test_nearest_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 2)
    rows = [(i, [float(i), 0.0]) for i in range(20)]
    e = frame(spark, rows, "photo_id long, embedding array<float>").repartition(4)
    q = e.where("photo_id % 4 = 0").select(F.col("photo_id").alias("query_id"), "embedding")
    got = vectors.nearest_of_many(e, q, 3).collect()
    for i in range(0, 20, 4):
        best = sorted(range(20), key=lambda j: (abs(i - j), j))[:3]
        assert [r.photo_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == best
    with pytest.raises(ValueError):
        vectors.all_distances(e, q)


@pytest.mark.parametrize("threshold", [0, 1, 3, 9])
def test_hamming_pairs(spark, threshold):
    import random

    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(15)]
    hashes = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:4]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = frame(spark, list(enumerate(signed)), "id long, hash long")
    want = {(a, b): bin(hashes[a] ^ hashes[b]).count("1") for b in range(len(hashes)) for a in range(b)}
    want = sorted((a, b, d) for (a, b), d in want.items() if d <= threshold)
    got = sorted(tuple(r) for r in hashing.close_pairs(df, threshold).collect())
    assert got == want
    root = list(range(len(hashes)))
    for _ in hashes:
        for a, b, _d in want:
            root[b] = root[a] = min(root[a], root[b])
    linked = {x for a, b, _ in want for x in (a, b)}
    groups = {r.id: r.group_id for r in hashing.duplicate_groups(df, threshold).collect()}
    assert groups == {i: root[i] for i in linked}


def test_navigation(spark):
    a = frame(spark, [(i, f"p{i * 7 % 10}") for i in range(10)], "id long, path string").repartition(3)
    order = [r.id for r in sorted(a.collect(), key=lambda r: r.path)]
    got = {r.id: r for r in navigation.neighbours(a, "path").collect()}
    for i, x in enumerate(order):
        r = got[x]
        assert (r["index"], r.prev_id, r.next_id) == (i, order[max(i - 1, 0)], order[min(i + 1, 9)])
        assert (r.has_prev, r.has_next, r.position) == (i > 0, i < 9, f"{i + 1} / 10")
    one = lambda df: [r.id for r in df.collect()]
    assert one(navigation.navigate(a, order[9], "next", "path")) == [order[9]] and one(navigation.navigate(a, order[0], "prev", "path")) == [order[0]]
    assert one(navigation.navigate(a, None, "next", "path")) == [order[0]] and one(navigation.navigate(a, None, "prev", "path")) == [order[9]]
    assert one(navigation.at_index(a, 99, "path")) == [] and sorted(one(navigation.ranged(a, 7, 4, "path"))) == sorted(order[4:8])
    assert one(navigation.default_active(a, a.limit(0), "path")) == [order[0]]
    assert sorted(one(navigation.toggled(a.where("id < 3"), a.where("id in (2, 5)")))) == [0, 1, 5]
    assert navigation.numbered(a.limit(0)).count() == 0


def test_serving(spark):
    a = frame(spark, [(1, "a.jpg", "image/jpeg", False, None), (2, "r.cr2", None, True, "converted"), (3, "s.cr2", None, True, "failed")],
              "id long, path string, mime_type string, is_raw boolean, raw_status string")
    there = frame(spark, [("a.jpg",), ("large/r.webp",), ("tiny/a.webp",)], "path string")
    asked = frame(spark, [("1",), ("2",), ("3",), ("9",), ("x",), ("1abc",)], "id string")
    got = {r.id: r for r in serving.files(asked, a, there).collect()}
    assert {k: r.status for k, r in got.items()} == {"1": 200, "2": 200, "3": 422, "9": 404, "x": 400, "1abc": 200}
    assert (got["2"].path, got["2"].content_type) == ("large/r.webp", "image/webp")
    sized = asked.select("id", F.explode(F.array(F.lit("tiny"), F.lit("vast"))).alias("size"))
    got = {(r.id, r.size): (r.status, r.path) for r in serving.thumbnails(sized, a, there).collect()}
    assert got["1", "tiny"] == (200, "tiny/a.webp") and got["2", "tiny"] == (302, "/api/photos/2/file") and got["1", "vast"][0] == 400


def test_retained_and_retries(spark):
    jobs = frame(spark, [(i, "scan", s) for i, s in enumerate(["completed", "failed", "active"] * 10)], "seq long, task_type string, state string")
    got = progress.retained(jobs, 3, 2).collect()
    assert sorted(r.seq for r in got if r.state == "completed") == [21, 24, 27] and sum(r.state == "failed" for r in got) == 2
    assert sum(r.state == "active" for r in got) == 10 and progress.retry_delays() == [1000, 2000]


def test_create_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS migrated")
    assert sorted(create_tables(spark, "migrated")) == ["photo_embedding", "photo_exif", "photo_phash", "photos"]
    assert create_tables(spark, "migrated") == []
    spark.sql("DROP DATABASE migrated CASCADE")


def test_many_queries_skip_vectors_of_other_lengths(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [1.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [0.0, 1.0])]
    e = spark.createDataFrame(rows, "photo_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.photo_id, r.distance) for r in vectors.nearest_of_many(e, q, 5).orderBy("rank").collect()]
    assert got == [(1, 0.0), (6, 1.0), (2, 5.0)]
    assert [(r.photo_id, r.distance) for r in vectors.top_k(e, [0.0, 0.0], 5).collect()] == got
