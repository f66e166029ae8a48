import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lenscape.functions import images
from lenscape.operators import vectors
from lenscape.plans import ingest
from lenscape.sources import files


def picture(seed, height=40, width=60):
    return images.encode_png(np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8))


@pytest.fixture()
def library(tmp_path):
    root = tmp_path / "library"
    for path, data in {
        "a/one.png": picture(1), "a/_DSC1.png": picture(2), "_und/u.PNG": picture(3), "sp ace/x%20.png": picture(4),
        ".hidden.png": picture(5), ".hid/z.png": picture(6), "notes.txt": b"text", "a/broken.jpg": b"no picture",
        "raw/r.cr2": b"raw", "raw/s.nef": b"raw", "a/really_heif.jpg": b"\0\0\0\x18ftypheic more",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    os.symlink(root / "a", root / "link")
    os.symlink(root, root / "a" / "loop")
    return str(root)


def tags(path):
    return json.dumps({"Make": "Canon", "ISO": 100, "Orientation": 6}) if path.endswith("one.png") else None


def preview(path):
    return picture(7) if path.endswith(".cr2") else None


TOOLS = ingest.Tools(exif=tags, preview=preview)


def test_discovery(spark, library):
    got = files.discover(spark, library).collect()
    own = {r.relative_path for r in got if not r.relative_path.startswith(("link/", "a/loop/"))}
    assert own == {"a/one.png", "a/_DSC1.png", "_und/u.PNG", "sp ace/x%20.png", "a/broken.jpg", "raw/r.cr2", "raw/s.nef", "a/really_heif.jpg"}
    assert any(r.relative_path == "link/one.png" for r in got)  # links are followed
    one = next(r for r in got if r.relative_path == "a/one.png")
    assert one.size == os.path.getsize(one.path) and one.name == "one.png" and one.modified_ms > 1e12
    assert files.discover(spark, library + "/.hid").count() == 0 and files.discover(spark, library + "/none").count() == 0
    assert files.extensions(spark).count() == 24
    os.remove(f"{library}/a/loop")  # Spark's listing follows a loop without end
    seen = {r.name for r in files.listed(spark, library).collect()}
    assert "one.png" in seen and "_DSC1.png" not in seen  # why the walk exists


def test_raw_preview():
    tried = []

    def extract(path, tag):
        tried.append(tag)
        return b"\xff\xd8\xff" if tag == "JpgFromRaw" else b""

    assert files.raw_preview("x.cr2", extract) == b"\xff\xd8\xff" and tried == ["PreviewImage", "JpgFromRaw"]
    assert files.raw_preview("x.cr2", lambda p, t: None) is None
    assert files.exiftool("/nowhere/x.jpg") is None and files.exiftool_binary("/nowhere/x", "PreviewImage") is None


def test_ingest(spark, library, tmp_path):
    os.remove(f"{library}/a/loop")
    os.remove(f"{library}/link")
    thumbs = str(tmp_path / "thumbs")
    catalog = ingest.Catalog(spark, f"file://{tmp_path}/catalog")
    results = ingest.ingest(spark, library, catalog, f"file://{tmp_path}/work", TOOLS, thumbs)
    by = {r.path: r for r in results.collect()}
    assert {p for p, r in by.items() if not r.success} == {"a/broken.jpg", "raw/s.nef", "a/really_heif.jpg"}
    assert by["raw/s.nef"].raw_status == "failed" and by["raw/s.nef"].mime_type == "image/x-nef" and by["a/really_heif.jpg"].mime_type == "image/heic"
    photos = {r.path: r for r in catalog.read("photos").collect()}
    assert set(photos) == {"a/one.png", "a/_DSC1.png", "_und/u.PNG", "sp ace/x%20.png", "raw/r.cr2"}
    assert (photos["a/one.png"].width, photos["a/one.png"].height) == (40, 60)  # after orientation 6
    assert photos["raw/r.cr2"].raw_format == "CR2" and photos["raw/r.cr2"].raw_status == "converted"
    assert [r.camera_make for r in catalog.read("photo_exif").collect()] == ["Canon"]
    assert catalog.read("photo_phash").count() == 5
    assert os.path.exists(f"{thumbs}/tiny/a/one.webp") and not [f for _, _, fs in os.walk(thumbs) for f in fs if f.endswith(".part")]

    def embed(paths):
        assert len(paths) <= 16 and all(p.startswith("thumbs/large/") for p in paths)
        return [None if "u.webp" in p else [float(len(p)), 1.0] for p in paths]

    outcome = {r.photo_id: r.ok for r in catalog.embed_pending(embed, "thumbs").collect()}
    assert sorted(outcome.values()) == [False, True, True, True, True]
    status = {r.path: r.embedding_status for r in catalog.read("photos").collect()}
    assert status["_und/u.PNG"] == "failed" and status["a/one.png"] == "completed"
    found = vectors.search(catalog.read("photos"), catalog.read("photo_embedding"), [0.0, 1.0], 2).collect()
    assert len(found) == 2
    # a second scan of the same files keeps ids and vectors, and makes all files pending
    ids = {r.path: r.id for r in catalog.read("photos").collect()}
    ingest.ingest(spark, library, catalog, f"file://{tmp_path}/work", TOOLS)
    again = catalog.read("photos").collect()
    assert {r.path: r.id for r in again} == ids and {r.embedding_status for r in again} == {"pending"}
    assert catalog.read("photo_embedding").count() == 4 and catalog.read("photo_exif").count() == 1


def test_failing_model(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, path string").coalesce(1)

    def embed(paths):
        if "p20" in paths:
            raise RuntimeError("out of memory")
        return [[1.0]] * len(paths)

    got = ingest.embedded(rows, embed).where(F.col("embedding").isNull())
    assert sorted(r.photo_id for r in got.collect()) == list(range(16, 32))  # its whole batch


def test_pixels_by_spark(spark, library):
    got = files.pixels_by_spark(spark, [f"{library}/a/one.png"]).first()
    assert (got.height, got.width, got.nChannels) == (40, 60, 3)


def test_a_deep_walk_is_dealt_out(spark, tmp_path):
    root = tmp_path / "lib"
    for i in range(60):
        folder = root / "only" / f"f{i % 7}" / "x" / str(i)
        folder.mkdir(parents=True)
        (folder / f"{i}.jpg").write_bytes(b"x" * i)
        (folder / "notes.txt").write_text("no")
    (root / "only" / "loop").symlink_to(root / "only")
    (root / "only" / "other").symlink_to(root / "only" / "f0")
    want = sorted(tuple(r) for r in files.discovered(spark, str(root)).collect())
    assert len(want) == 60 + 9 and {len(r) for r in want} == {6}
    for visits in (1, 3, 1000):
        assert sorted(tuple(r) for r in files.discover(spark, str(root), visits).collect()) == want
    start = spark.createDataFrame([(str(root), [str(root)])], "path string, above array<string>")
    left = files.round_of(start, str(root), 4).where("above IS NOT NULL")
    assert left.count() > 4
    step = files.round_of(left.select("path", "above"), str(root), 2)
    parts = step.where("above IS NULL").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1  # folders below the only child are visited by several tasks


def test_a_folder_of_many_files_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ENTRIES", 50)
    root = tmp_path / "lib"
    for i in range(20):
        (root / f"f{i}").mkdir(parents=True)
        (root / f"f{i}" / "z.jpg").write_bytes(b"xyz")
    for i in range(300):
        (root / f"{i}.jpg").write_bytes(b"x" * (i % 50))
    (root / "folder.jpg").mkdir()
    (root / "gone.jpg").symlink_to(root / "nothing")
    (root / "link.jpg").symlink_to(root / "7.jpg")
    start = spark.createDataFrame([(str(root), [str(root)])], "path string, above array<string>")
    assert files.round_of(start, str(root), 64).where("above IS NOT NULL").count() == 21  # none visited by the task that lists the many
    found = files.discover(spark, str(root))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = {r.relative_path: r.size for r in found.collect()}
    assert got == {f"{i}.jpg": i % 50 for i in range(300)} | {f"f{i}/z.jpg": 3 for i in range(20)} | {"link.jpg": 7}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, files.discovered(spark, str(root)).collect()))
