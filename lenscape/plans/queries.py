"""One query for each operator of the inventory over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media
from ..operators import catalog, folders, hashing, navigation, progress, serving, upsert, vectors
from ..sources import files
from ..workers import checkpointed, find_package, remove, shared_folder
from .assets import cte, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
col, lit = F.col, F.lit


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def scalar(name: str, table: str, exprs: dict, sql: str) -> None:
    """id and columns computed from a table's columns."""
    QUERIES[name] = lambda spark, sf, t=table, e=exprs: read(spark, sf, t).select("id", *(f().alias(k) for k, f in e.items()))
    SQL[name] = f"{cte(table)} SELECT id, {sql} FROM {table}"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ends(exts) -> str:
    return f"regexp_matches(lower(path), '\\.({'|'.join(exts)})$')"


ALL = media.STANDARD + media.RAW + media.HEIF
BASE = "/library/photos"

# --- sources -------------------------------------------------------------------------------------------------------


@query("src1_discover", f"{cte('assets')} SELECT path AS relative_path, name, CAST(length(path) AS BIGINT) AS size FROM assets WHERE {_ends(ALL)}")
def _(spark, sf):
    """A walk over files made for it: small ones named as all assets, among hidden and foreign ones."""
    return _walked(spark, sf, "walk").select("relative_path", "name", "size")


def _walked(spark, sf, name: str) -> DataFrame:
    """What the walk finds, and keeps, of files that executors write into the folder that all share, and delete."""
    from urllib.parse import urlparse

    folder = shared_folder(spark, name)
    root = urlparse(folder).path  # the walk is one of mounted file systems
    find_package(spark)
    odd = spark.createDataFrame([(p,) for p in (".hidden.jpg", ".hid/a.jpg", "notes.txt", "a/.b/c.png")], "path string")
    paths = read(spark, sf, "assets").select("path").unionByName(odd)
    paths = paths.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "path")  # few tasks in a folder at a time, as it takes in files one by one
    try:
        paths.mapInArrow(_each_path(root, _make_file), "n long").agg(F.sum("n")).first()
        return files.discover(spark, root)
    finally:
        paths.mapInArrow(_each_path(root, _delete_file), "n long").agg(F.sum("n")).first()
        remove(spark, folder)


def _each_path(root: str, do: Callable[[str, str, set], None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders: set = set()
        for b in batches:
            for p in b.column(0).to_pylist():
                do(root, p, folders)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return run


def _make_file(root: str, path: str, folders: set) -> None:
    """Its size and time are given by the length of its path."""
    folder = os.path.dirname(f"{root}/{path}")
    if folder not in folders:
        os.makedirs(folder, exist_ok=True)
        folders.add(folder)
    with open(f"{root}/{path}", "wb", buffering=0) as f:
        f.write(b"x" * len(path))
        os.utime(f.fileno(), (86400, 86400 * len(path)))


def _delete_file(root: str, path: str, _: set) -> None:
    try:
        os.unlink(f"{root}/{path}")
    except FileNotFoundError:
        pass


scalar(
    "src2_supported", "assets",
    {"supported": lambda: media.is_supported(F.upper("path")), "copy": lambda: media.is_supported(F.concat(col("path"), F.when(col("id") % 2 == 0, ".bak").otherwise(".JPG")))},
    f"{_ends(ALL)} AS supported, id % 2 = 1 AS copy",
)


@query("src3_extensions", f"SELECT unnest([{_list(ALL)}]) AS extension")
def _(spark, sf):
    return files.extensions(spark)


@query("src4_stat", f"{cte('assets')} SELECT path, size, CAST(floor(created_ms / 1000) AS BIGINT) AS created_s, CAST(floor(modified_ms / 1000) AS BIGINT) AS modified_s FROM assets")
def _(spark, sf):
    return read(spark, sf, "assets").select(
        "path", "size", F.unix_seconds(upsert.seconds(col("created_ms"))).alias("created_s"), F.unix_seconds(upsert.seconds(col("modified_ms"))).alias("modified_s")
    )


@query("src4_stat_files", f"{cte('assets')} SELECT path, CAST(length(path) AS BIGINT) AS size, 86400.0 * length(path) AS modified_s FROM assets")
def _(spark, sf):
    """Sizes and times as the walk reads them from files."""
    return _walked(spark, sf, "stat").select(col("relative_path").alias("path"), "size", F.unix_seconds(upsert.seconds(col("modified_ms"))).cast("double").alias("modified_s"))


@query("src5_paths", f"{cte('assets')} SELECT path FROM assets")
def _(spark, sf):
    return read(spark, sf, "assets").select("path")


@query("src6_catalog", f"{cte('assets', 'exif')} SELECT a.id, a.path, a.size, e.camera_make, e.iso FROM assets a LEFT JOIN exif e ON e.photo_id = a.id")
def _(spark, sf):
    rows = catalog.photos(read(spark, sf, "assets"), read(spark, sf, "exif"))
    return rows.select("id", "path", "size", "exif.camera_make", "exif.iso")


scalar(
    "src9_heif_magic", "assets",
    {"heif": lambda: media.is_heif_content(F.concat(F.to_binary(lit("00000024"), lit("hex")), F.element_at(F.array(lit("ftypheic"), lit("ftypavif"), lit("ftypmp42"), lit("JFIFheic"), lit("ftyp")), (col("id") % 5 + 1).cast("int")).cast("binary")))},
    "id % 5 IN (0, 1) AS heif",
)
scalar("src10_heif_name", "assets", {"heif": lambda: media.is_heif_file(col("path"))}, f"{_ends(media.HEIF)} AS heif")
scalar(
    "src11_raw_format", "assets", {"raw": lambda: media.is_raw_file(col("path")), "format": lambda: media.raw_format(col("path"))},
    f"{_ends(media.RAW)} AS raw, CASE WHEN {_ends(media.RAW)} THEN upper(regexp_extract(path, '[^.]*$')) END AS format",
)


@query("src7_decode_png", f"{cte('assets')} SELECT id, CAST(2 + id % 5 AS INT) AS width, CAST(3 + id % 4 AS INT) AS height, CAST((2 + id % 5) * (3 + id % 4) * (id % 200) AS BIGINT) AS sum FROM assets")
def _(spark, sf):
    """Plain pictures encoded and decoded again."""
    def run(batches):
        import numpy as np
        from ..functions import images

        for b in batches:
            out = []
            for i in b["id"]:
                p = images.decode_standard(images.encode_png(np.full((3 + i % 4, 2 + i % 5, 1), i % 200, np.uint8)))
                out.append((i, p.shape[1], p.shape[0], int(p.sum())))
            yield pd.DataFrame(out, columns=["id", "width", "height", "sum"])

    return read(spark, sf, "assets").select("id").mapInPandas(run, "id long, width int, height int, sum long")


@query("src12_raw_preview", f"{cte('assets')} SELECT id, CASE WHEN id % 3 = 0 THEN 'PreviewImage' WHEN id % 3 = 1 THEN 'JpgFromRaw' END AS tag FROM assets WHERE {_ends(media.RAW)}")
def _(spark, sf):
    """With an extractor that stands in for the tool: which tag gave the picture."""
    def extract(path: str, tag: str):
        i = int(path.rpartition("/")[2].partition(".")[0])
        want = {0: "PreviewImage", 1: "JpgFromRaw"}.get(i % 3)
        return b"\xff\xd8" + tag.encode() if tag == want else b"no picture"

    def run(batches):
        for b in batches:
            found = [files.raw_preview(p, extract) for p in b["path"]]
            yield pd.DataFrame({"id": b["id"], "tag": [x and x[2:].decode() for x in found]})

    return read(spark, sf, "assets").where(media.is_raw_file(col("path"))).select("id", "path").mapInPandas(run, "id long, tag string")


_TAG_SQL = {
    "camera_make": "CASE WHEN json_type(doc, '$.Make') <> 'NULL' THEN json_extract_string(doc, '$.Make') END",
    "iso": "CASE WHEN json_type(doc, '$.ISO') = 'UBIGINT' THEN CAST(json_extract(doc, '$.ISO') AS BIGINT) END",
    "focal_length": "CASE WHEN json_type(doc, '$.FocalLength') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(trunc(greatest(least(CAST(json_extract(doc, '$.FocalLength') AS DOUBLE), 4294967295), 0)) AS BIGINT) END",
}


@query("src13_exif_json", f"{cte('tags')} SELECT id, {', '.join(f'{e} AS {k}' for k, e in _TAG_SQL.items())} FROM tags")
def _(spark, sf):
    rows = read(spark, sf, "tags").select("id", media.exif_from_json(col("doc")).alias("e"))
    return rows.select("id", *(f"e.{k}" for k in _TAG_SQL))


@query("src14_pending", f"{cte('assets')} SELECT id FROM assets WHERE embedding_status = 'pending'")
def _(spark, sf):
    return catalog.pending(read(spark, sf, "assets"))


@query("src15_vectors", f"{cte('sidecar')} SELECT photo_id, len(embedding) AS dimensions FROM sidecar")
def _(spark, sf):
    return read(spark, sf, "sidecar").select("photo_id", F.size("embedding").cast("long").alias("dimensions"))


@query("src16_events", f"{cte('jobs')} SELECT task_type, count(*) AS events FROM jobs GROUP BY ALL")
def _(spark, sf):
    return read(spark, sf, "jobs").groupBy("task_type").agg(F.count(lit(1)).alias("events"))


# --- filters, look-ups, joins --------------------------------------------------------------------------------------


@query("f1_raw_filter", f"{cte('assets')} SELECT id, 'raw' AS which FROM assets WHERE is_raw UNION ALL SELECT id, 'standard' FROM assets WHERE NOT is_raw UNION ALL SELECT id, 'all' FROM assets")
def _(spark, sf):
    a = read(spark, sf, "assets")
    return reduce(DataFrame.unionByName, (catalog.photos(a, which=w).select("id", lit(w).alias("which")) for w in ("raw", "standard", "all")))


@query("f2_folder_prefix", f"{cte('assets')} SELECT id FROM assets WHERE lower(path) LIKE 'en/src1_/%'")
def _(spark, sf):
    """As SQLite matches: in either case, _ a wildcard."""
    return catalog.filtered(read(spark, sf, "assets"), catalog.folder_condition("EN/src1_", sqlite_like=True)).select("id")


@query("f3_direct_children", f"{cte('assets')} SELECT id FROM assets WHERE starts_with(path, 'en/') AND position('/' IN substr(path, 4)) = 0")
def _(spark, sf):
    return catalog.photos(read(spark, sf, "assets"), folder="en").select("id")


@query("f4_conjunction", f"{cte('assets')} SELECT id FROM assets WHERE is_raw AND starts_with(path, 'en/src4/') AND size > 1000")
def _(spark, sf):
    a = read(spark, sf, "assets")
    return catalog.filtered(a, catalog.raw_condition("raw"), catalog.folder_condition("en/src4"), None, col("size") > 1000).select("id")


@query("f5_point_lookup", f"{cte('assets', 'exif')} SELECT id, path, iso FROM assets LEFT JOIN exif ON photo_id = id WHERE id = 21")
def _(spark, sf):
    return catalog.photo(read(spark, sf, "assets"), 21, read(spark, sf, "exif")).select("id", "path", "exif.iso")


@query("f6_id_list", f"{cte('assets')} SELECT id, path FROM assets WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 1)")
def _(spark, sf):
    ids = spark.read.parquet(f"{sf}/embeddings.parquet").where("label = 1").select(col("vec_id").alias("id"))
    return catalog.by_ids(read(spark, sf, "assets"), ids).select("id", "path")


@query("f7_path_lookup", f"{cte('assets')} SELECT id, path FROM assets WHERE path IN (SELECT path FROM assets WHERE id % 9 = 4)")
def _(spark, sf):
    a = read(spark, sf, "assets")
    return catalog.by_path(a, a.where("id % 9 = 4")).select("id", "path")


@query("f8_path_of_id", f"{cte('assets')} SELECT path FROM assets WHERE id = 34")
def _(spark, sf):
    return spark.createDataFrame([(catalog.path_of(read(spark, sf, "assets"), 34),)], "path string")


scalar(
    "f9_failed_raw", "assets", {"failed": lambda: media.failed_raw(col("is_raw"), col("raw_status"))},
    "coalesce(is_raw, false) AND raw_status IS DISTINCT FROM 'converted' AS failed",
)
_STEM = r"regexp_replace(path, '\.[^/.]+$', '')"


@query("f10_missing_thumbnails", f"{cte('assets')} SELECT id, 'small/' || {_STEM} || '.webp' AS thumbnail FROM assets WHERE id % 4 = 0")
def _(spark, sf):
    a = read(spark, sf, "assets")
    there = a.where("id % 4 <> 0").select(media.thumbnail_path(col("path"), lit("small")).alias("path"))
    return catalog.missing_thumbnails(a, there, "small")


@query("f11_drop_unknown", f"{cte('assets', 'sidecar')} SELECT id FROM assets JOIN sidecar ON photo_id = id")
def _(spark, sf):
    return read(spark, sf, "assets").join(read(spark, sf, "sidecar").select(col("photo_id").alias("id")), "id").select("id")


def _results(spark, sf) -> DataFrame:
    """Results of a scan: a third of the assets changed, with and without EXIF, some failed, and some new files."""
    a = read(spark, sf, "assets").where("id % 3 <> 1")
    exif = F.struct(*(lit(v).cast(t).alias(c) for c, v, t in (("camera_make", "New", "string"), ("iso", 800, "long"))))
    return a.select(
        F.when(col("id") % 6 == 0, F.concat(lit("new/"), "path")).otherwise(col("path")).alias("path"),
        "name", (col("size") + 5).alias("size"), "created_ms", (col("modified_ms") + 1000).alias("modified_ms"), "width", "height", "mime_type",
        F.when(col("id") % 5 != 0, F.concat(lit("h"), col("id").cast("string"))).alias("phash"),
        F.when(col("id") % 4 == 0, exif).alias("exif"), F.coalesce("is_raw", lit(False)).alias("is_raw"), "raw_format", "raw_status", "raw_error",
        (col("id") % 10 != 3).alias("success"), F.when(col("id") % 10 == 3, "broken").alias("error"),
    )


_RESULTS = """, results AS (SELECT CASE WHEN id % 6 = 0 THEN 'new/' || path ELSE path END AS path, name, size + 5 AS size, created_ms,
 modified_ms + 1000 AS modified_ms, CASE WHEN id % 5 <> 0 THEN 'h' || id END AS phash, id % 4 = 0 AS has_exif, id % 10 <> 3 AS success, raw_error
 , raw_status, coalesce(is_raw, false) AS is_raw FROM assets WHERE id % 3 <> 1)"""


def _catalog(spark, sf) -> DataFrame:
    return read(spark, sf, "assets").select(
        "id", "path", "name", "size", upsert.seconds(col("created_ms")).alias("created_at"), upsert.seconds(col("modified_ms")).alias("modified_at"),
        "width", "height", "mime_type", "is_raw", "raw_format", "raw_status", "raw_error", "thumbnail_status", "embedding_status", "phash_status",
    )


@query("f12_success_filter", f"{cte('assets')}{_RESULTS} SELECT path FROM results WHERE success")
def _(spark, sf):
    return upsert.accepted(_results(spark, sf)).select("path")


@query("f13_narrow_projection", f"{cte('assets')} SELECT id, path FROM assets")
def _(spark, sf):
    return read(spark, sf, "assets").select("id", "path")


@query("f14_task_types", f"{cte('jobs')} SELECT seq, task_type FROM jobs WHERE task_type IN ('scan', 'embedding')")
def _(spark, sf):
    return progress.of_tasks(read(spark, sf, "jobs"), ["scan", "embedding"]).select("seq", "task_type")


@query("f15_query_gate", "SELECT trim(text) <> '' AS accepted, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.groupBy((F.trim("text") != "").alias("accepted")).agg(F.count(lit(1)).alias("n"))


@query("j1_exif_join", f"{cte('assets', 'exif')} SELECT id, photo_id IS NOT NULL AS has_exif, camera_make, aperture FROM assets LEFT JOIN exif ON photo_id = id")
def _(spark, sf):
    rows = catalog.with_sidecar(read(spark, sf, "assets"), read(spark, sf, "exif"))
    return rows.select("id", col("exif").isNotNull().alias("has_exif"), "exif.camera_make", "exif.aperture")


_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {})"
_DIST = "list_distance(CAST(embedding AS DOUBLE[]), {})"


def _vector(spark, sf, i: int) -> list[float]:
    return vectors.vector_of(read(spark, sf, "sidecar"), i)


def _nearest_sql(i: int, k: int, extra: str = "") -> str:
    return f""", near AS (SELECT photo_id, {_DIST.format(_Q.format(i))} AS d FROM sidecar {extra}),
top AS (SELECT photo_id, d, row_number() OVER (ORDER BY d, photo_id) AS rank FROM near ORDER BY d, photo_id LIMIT {k})"""


@query("j2_ranked_join", f"{cte('assets', 'sidecar')}{_nearest_sql(5, 15)} SELECT id, path, rank FROM top JOIN assets ON id = photo_id")
def _(spark, sf):
    a, s = read(spark, sf, "assets"), read(spark, sf, "sidecar")
    return vectors.search(a, s, _vector(spark, sf, 5), 15).select("id", "path", col("rank").cast("long").alias("rank"))


@query("j3_all_distances", "SELECT q.vec_id AS query_id, e.vec_id AS photo_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id IN (1, 2, 3)")
def _(spark, sf):
    s = read(spark, sf, "sidecar")
    q = s.where("photo_id IN (1, 2, 3)").select(col("photo_id").alias("query_id"), "embedding")
    return vectors.all_distances(s, q).withColumn("distance", F.round("distance", 6))


_TREE = """, f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder FROM assets WHERE length(path) - length(regexp_extract(path, '[^/]*$')) > 1),
p AS (SELECT string_split(folder, '/') AS parts FROM f),
n AS (SELECT unnest(range(1, len(parts) + 1)) AS i, parts FROM p),
tree AS (SELECT array_to_string(parts[1:i], '/') AS path, parts[i] AS name, i AS depth, CASE WHEN i > 1 THEN array_to_string(parts[1:i - 1], '/') END AS parent_path,
 count(*) FILTER (i = len(parts)) AS photo_count FROM n GROUP BY ALL)"""


def _tree(spark, sf) -> DataFrame:
    return folders.tree(read(spark, sf, "assets"))


@query("j4_parent_join", f"{cte('assets')}{_TREE} SELECT c.parent_path AS parent, c.path AS child, c.photo_count AS child_count, p.photo_count AS parent_count FROM tree c LEFT JOIN tree p ON p.path = c.parent_path")
def _(spark, sf):
    return folders.children(_tree(spark, sf))


@query("j5_zip", f"{cte('assets')} SELECT lang AS folder, CAST(sum(length(text)) AS BIGINT) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    """Two arrays zipped by place: names and their lengths."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    z = d.select("lang", F.explode(F.arrays_zip(F.array("doc_id").alias("id"), F.array(F.length("text")).alias("n"))).alias("z"))
    return z.groupBy(col("lang").alias("folder")).agg(F.sum("z.n").alias("n"))


@query("j6_sidecar_relation", f"{cte('assets', 'sidecar')} SELECT photo_id, path FROM sidecar LEFT JOIN assets ON id = photo_id")
def _(spark, sf):
    photo = read(spark, sf, "assets").select(col("id").alias("photo_id"), "path")
    return read(spark, sf, "sidecar").select("photo_id").join(photo, "photo_id", "left")


_BITS = ", ".join(f"(embedding[{i + 1}] > 0)::BIGINT << {i}" for i in range(62))
_HASH = f"h AS (SELECT vec_id AS id, list_sum([{_BITS}])::BIGINT AS hash FROM embeddings)"


def _hashes(spark, sf) -> DataFrame:
    return read(spark, sf, "sidecar").select(col("photo_id").alias("id"), hashing.sign_hash(col("embedding")).alias("hash"))


@query("j7_hamming_pairs", f"WITH {_HASH} SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INT) AS distance FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.hash, y.hash)) <= 18")
def _(spark, sf):
    return hashing.close_pairs(_hashes(spark, sf), 18, bits=62)


@query("j7_duplicate_groups", f"""WITH RECURSIVE {_HASH}, e AS (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.id <> y.id AND bit_count(xor(x.hash, y.hash)) <= 15),
r(id, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
SELECT id, min(g) AS group_id FROM r GROUP BY id""")
def _(spark, sf):
    return hashing.duplicate_groups(_hashes(spark, sf), 15, bits=62)


@query("j7_close_classes", f"""WITH {_HASH}, e AS (SELECT x.id, count(*) FILTER (x.id <> y.id) AS links, count(*) FILTER (x.hash = y.hash) AS copies, min(y.id) FILTER (x.hash = y.hash) AS representative
 FROM h x JOIN h y ON bit_count(xor(x.hash, y.hash)) <= 16 GROUP BY x.id) SELECT id, representative, copies, links FROM e""")
def _(spark, sf):
    return hashing.close_classes(_hashes(spark, sf), 16, bits=62)[0]


# --- aggregations --------------------------------------------------------------------------------------------------


@query("a1_folder_tree", f"{cte('assets')}{_TREE} SELECT path, name, photo_count FROM tree")
def _(spark, sf):
    return _tree(spark, sf).select("path", "name", "photo_count")


@query("a1_page_folders", """WITH assets AS (SELECT regexp_replace(url, '^[a-z]+://([^?#]*).*$', '\\1') AS path FROM pages)""" + _TREE + " SELECT path, CAST(depth AS INT) AS depth, photo_count FROM tree")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_replace("url", r"^[a-z]+://([^?#]*).*$", "$1").alias("path"))
    return folders.tree(p).select("path", "depth", "photo_count")


@query("a2_tree_parents", f"{cte('assets')}{_TREE} SELECT path, parent_path, CAST(depth AS INT) AS depth FROM tree")
def _(spark, sf):
    return _tree(spark, sf).select("path", "parent_path", "depth")


@query("a3_total_photos", f"{cte('assets')} SELECT count(*) AS total FROM assets")
def _(spark, sf):
    return catalog.counts(read(spark, sf, "assets")).select("total")


@query("a4_filtered_total", f"{cte('assets')} SELECT count(*) AS total FROM assets WHERE starts_with(path, 'fr/src3/')")
def _(spark, sf):
    return catalog.counts(catalog.photos(read(spark, sf, "assets"), folder="fr/src3")).select("total")


@query("a5_raw_count", f"{cte('assets')} SELECT count(*) FILTER (is_raw) AS raw_count FROM assets")
def _(spark, sf):
    return catalog.counts(read(spark, sf, "assets")).select("raw_count")


_JOBS = ", j AS (SELECT *, CASE event_type WHEN 'progress' THEN 'waiting' ELSE event_type END AS state FROM jobs)"


def _jobs(spark, sf) -> DataFrame:
    return read(spark, sf, "jobs").withColumn("state", F.when(col("event_type") == "progress", "waiting").otherwise(col("event_type")))


@query("a6_job_counts", f"{cte('jobs')}{_JOBS} SELECT task_type, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("active", "waiting", "completed", "failed")) + " FROM j GROUP BY task_type")
def _(spark, sf):
    return progress.job_counts(_jobs(spark, sf))


@query("a7_scan_counters", f"{cte('assets')}{_RESULTS} SELECT count(*) AS processed, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM results")
def _(spark, sf):
    return progress.outcomes(_results(spark, sf))


@query("a8_embedding_counters", f"{cte('assets')} SELECT count(*) AS processed, count(*) FILTER (embedding_status = 'completed') AS successful FROM assets WHERE embedding_status <> 'pending'")
def _(spark, sf):
    done = read(spark, sf, "assets").where("embedding_status <> 'pending'")
    return progress.outcomes(done.select((col("embedding_status") == "completed").alias("success"))).select("processed", "successful")


_FOLD = """, p AS (SELECT * FROM jobs WHERE event_type = 'progress'),
s AS (SELECT arg_max("current", seq) FILTER ("current" IS NOT NULL) AS c, arg_max(total, seq) FILTER (total IS NOT NULL) AS t,
 arg_max(total, seq) FILTER (total > 0) AS st, max(seq) FILTER (total > 0) AS sat FROM p WHERE task_type = 'scan'),
items AS (SELECT task_type, photo_id, min(seq) AS first_at, arg_min(status, seq) AS status FROM p WHERE task_type <> 'scan' AND photo_id <> 0 GROUP BY ALL),
i AS (SELECT task_type, count(*) AS items, count(*) FILTER (status = 'failed') AS failed, max(first_at) AS item_at FROM items GROUP BY ALL),
e AS (SELECT arg_max("current", seq) FILTER ("current" IS NOT NULL AND photo_id IS NULL) AS c, max(seq) FILTER ("current" IS NOT NULL AND photo_id IS NULL) AS cat,
 arg_max(total, seq) FILTER (total IS NOT NULL) AS t, max(seq) FILTER (total IS NOT NULL) AS tat FROM p WHERE task_type = 'embedding'),
fold AS (
 SELECT 'scan' AS task_type, coalesce(c, 0) AS "current", coalesce(t, 0) AS total, 0 AS items, 0 AS failed FROM s
 UNION ALL SELECT 'phash', coalesce(items, 0), coalesce((SELECT st FROM s), 0), coalesce(items, 0), coalesce(failed, 0) FROM (SELECT 1) LEFT JOIN i ON task_type = 'phash'
 UNION ALL SELECT 'embedding', coalesce(CASE WHEN item_at > coalesce(cat, -1) THEN items ELSE c END, 0),
  coalesce(CASE WHEN (SELECT sat FROM s) > coalesce(tat, -1) THEN (SELECT st FROM s) ELSE t END, 0), coalesce(items, 0), coalesce(failed, 0) FROM e LEFT JOIN i ON task_type = 'embedding')"""


def _fold(spark, sf) -> DataFrame:
    return progress.fold(read(spark, sf, "jobs"))


@query("a9_total_progress", f'{cte("jobs")}{_FOLD} SELECT CAST(sum("current") AS BIGINT) AS "current", CAST(sum(total) AS BIGINT) AS total FROM fold')
def _(spark, sf):
    return progress.totals(_fold(spark, sf)).select("current", "total")


@query("a10_has_active_jobs", f'{cte("jobs")}{_FOLD} SELECT bool_or(total > 0 AND "current" < total) AS active FROM fold')
def _(spark, sf):
    return progress.totals(_fold(spark, sf)).select("active")


@query("a11_failed_items", f"{cte('jobs')}{_FOLD} SELECT task_type, failed FROM fold")
def _(spark, sf):
    return _fold(spark, sf).select("task_type", "failed")


@query("a12_percent", f'{cte("jobs")}{_FOLD} SELECT task_type, CASE WHEN total > 0 THEN CAST(floor("current" * 100 / total + 0.5) AS BIGINT) ELSE 0 END AS percent FROM fold')
def _(spark, sf):
    return _fold(spark, sf).select("task_type", progress.percent(col("current"), col("total")).alias("percent"))


@query("a13_distinct_items", f"{cte('jobs')}{_FOLD} SELECT task_type, photo_id, CASE WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS status FROM items")
def _(spark, sf):
    return progress.distinct_items(read(spark, sf, "jobs"))


@query("a14_selection_counts", f"{cte('assets')} SELECT count(*) AS selected_count, count(*) > 0 AS has_selection FROM assets WHERE id % 6 = 1")
def _(spark, sf):
    a = read(spark, sf, "assets")
    return navigation.selection_counts(a, a.where("id % 6 = 1"))


@query("a15_active_jobs", f"{cte('jobs')}{_JOBS} SELECT task_type, state, job_id FROM j WHERE state IN ('active', 'waiting', 'delayed')")
def _(spark, sf):
    return progress.active_jobs(_jobs(spark, sf))


_TAKEN = "strptime(date_taken, '%Y:%m:%d %H:%M:%S')"
def taken():
    return F.try_to_timestamp(col("date_taken"), lit("yyyy:MM:dd HH:mm:ss"))



@query("a16_timeline", f"{cte('exif')} SELECT CAST(year({_TAKEN}) AS INT) AS year, CAST(month({_TAKEN}) AS INT) AS month, count(*) AS photos FROM exif GROUP BY ALL")
def _(spark, sf):
    return read(spark, sf, "exif").groupBy(F.year(taken()).alias("year"), F.month(taken()).alias("month")).agg(F.count(lit(1)).alias("photos"))


@query("a16_cameras", f"{cte('exif')} SELECT camera_make, camera_model, count(*) AS photos FROM exif WHERE camera_make <> '' GROUP BY ALL")
def _(spark, sf):
    return read(spark, sf, "exif").where("camera_make <> ''").groupBy("camera_make", "camera_model").agg(F.count(lit(1)).alias("photos"))


@query("a16_storage_by_folder", f"{cte('assets')} SELECT regexp_extract(path, '^(.*)/', 1) AS folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS photos FROM assets GROUP BY ALL")
def _(spark, sf):
    return read(spark, sf, "assets").groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.sum("size").alias("bytes"), F.count(lit(1)).alias("photos"))


# --- order, top-k, similarity --------------------------------------------------------------------------------------


@query("k1_vector_top_k", f"{cte('sidecar')}{_nearest_sql(0, 20)} SELECT photo_id, round(d, 6) AS distance FROM top")
def _(spark, sf):
    return vectors.top_k(read(spark, sf, "sidecar"), _vector(spark, sf, 0), 20).withColumn("distance", F.round("distance", 6))


@query("k1_vector_top_k_builtin", f"{cte('sidecar')}{_nearest_sql(0, 20)} SELECT photo_id, round(d, 6) AS distance FROM top")
def _(spark, sf):
    return vectors.top_k_builtin(read(spark, sf, "sidecar"), _vector(spark, sf, 0), 20).withColumn("distance", F.round("distance", 6))


@query("k1_nearest_of_many", """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS photo_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, photo_id) AS rank FROM d)
SELECT query_id, photo_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def _(spark, sf):
    s = read(spark, sf, "sidecar")
    q = s.where("photo_id % 50 = 0").select(col("photo_id").alias("query_id"), "embedding")
    return vectors.nearest_of_many(s, q, 5).withColumn("distance", F.round("distance", 6))


def toy_embedding(text: str) -> list[float]:
    """A stand-in for a text tower, the same in both engines: the first 64 letters' codes. It has no meaning."""
    return [((ord(text[i % len(text)]) * 7 + i * 3) % 29 - 14) / 100 for i in range(64)]


_TOY = "list_transform(range(0, 64), lambda i: ((ord(substr('sunset beach', CAST(i % 12 + 1 AS INT), 1)) * 7 + i * 3) % 29 - 14) / 100)"


@query("k2_text_search", f"{cte('assets', 'sidecar')}, near AS (SELECT photo_id, {_DIST.format(_TOY)} AS d FROM sidecar), top AS (SELECT photo_id, d, row_number() OVER (ORDER BY d, photo_id) AS rank FROM near ORDER BY d, photo_id LIMIT 50) SELECT id, path, rank FROM top JOIN assets ON id = photo_id")
def _(spark, sf):
    found = vectors.search_text(read(spark, sf, "assets"), read(spark, sf, "sidecar"), "sunset beach", toy_embedding, 50)
    return found.select("id", "path", col("rank").cast("long").alias("rank"))


@query("k3_search_by_photo", f"{cte('assets', 'sidecar')}{_nearest_sql(7, 10)} SELECT id, rank, round(d, 6) AS distance FROM top JOIN assets ON id = photo_id")
def _(spark, sf):
    found = vectors.search_like(read(spark, sf, "assets"), read(spark, sf, "sidecar"), 7, 10)
    return found.select("id", col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query("k4_sorted_folders", f"{cte('assets')}{_TREE} SELECT path, row_number() OVER (PARTITION BY parent_path ORDER BY name) AS place FROM tree")
def _(spark, sf):
    return folders.ranked(_tree(spark, sf)).select("path", col("place").cast("long").alias("place"))


@query("k4_tree_walk", f"""{cte('assets').replace('WITH', 'WITH RECURSIVE', 1)}{_TREE}, s AS (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY name) AS place FROM tree),
w AS (SELECT path, depth, [place] AS walk FROM s WHERE parent_path IS NULL UNION ALL SELECT s.path, s.depth, list_append(w.walk, s.place) FROM s JOIN w ON s.parent_path = w.path),
o AS (SELECT *, row_number() OVER (ORDER BY walk) - 1 AS pre FROM w)
SELECT path, pre, pre + n - 1 AS last, pre + n - depth AS post FROM (SELECT o.*, (SELECT count(*) FROM o x WHERE x.path = o.path OR starts_with(x.path, o.path || '/')) AS n FROM o)""")
def _(spark, sf):
    return folders.walked(_tree(spark, sf)).select("path", "pre", "last", "post")


@query("k5_rank_order", f"{cte('assets', 'sidecar')}{_nearest_sql(9, 12)}, f AS (SELECT id, rank FROM top JOIN assets ON id = photo_id) SELECT id, row_number() OVER (ORDER BY rank) AS place FROM f")
def _(spark, sf):
    found = vectors.search(read(spark, sf, "assets"), read(spark, sf, "sidecar"), _vector(spark, sf, 9), 12)
    return found.select("id", F.row_number().over(Window.orderBy("rank")).cast("long").alias("place"))


@query("k6_catalog_order", f"{cte('assets')} SELECT id, path, row_number() OVER (ORDER BY id) - 1 AS place FROM assets")
def _(spark, sf):
    return navigation.numbered(read(spark, sf, "assets").select("id", "path")).select("id", "path", col("index").alias("place"))


@query("k7_first", f"{cte('assets')} SELECT id, path FROM assets WHERE path LIKE 'es/%' ORDER BY id LIMIT 1")
def _(spark, sf):
    return catalog.ordered(catalog.filtered(read(spark, sf, "assets"), catalog.folder_condition("es"))).select("id", "path").limit(1)


# --- scalar functions ----------------------------------------------------------------------------------------------

def _size_sql(unit: int, name: str) -> str:
    t = f"((size * 10 + {unit // 2}) // {unit})"
    return f"({t} // 10) || '.' || ({t} % 10) || ' {name}'"


scalar(
    "s1_file_size", "assets", {"label": lambda: media.file_size(col("size")), "large": lambda: media.file_size(col("size") * 100000)},
    f"CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {_size_sql(1 << 10, 'KB')} WHEN size < 1073741824 THEN {_size_sql(1 << 20, 'MB')} ELSE {_size_sql(1 << 30, 'GB')} END AS label, "
    + f"CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN {_size_sql(1 << 10, 'KB')} WHEN size < 1073741824 THEN {_size_sql(1 << 20, 'MB')} ELSE {_size_sql(1 << 30, 'GB')} END".replace("size", "(size * 100000)") + " AS large",
)


@query("s2_date", "SELECT event_id AS id, strftime(ts, '%b %d, %Y, %I:%M %p') AS padded FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    label = media.date_label(col("ts").cast("timestamp"))
    return e.select(col("event_id").alias("id"), F.regexp_replace(label, r"^(\w+) (\d),", "$1 0$2,").alias("padded"))


scalar("s3_thumbnail_path", "assets", {"thumbnail": lambda: media.thumbnail_path(col("path"), lit("tiny"))}, f"'tiny/' || {_STEM} || '.webp' AS thumbnail")
scalar(
    "s4_native_stem", "assets", {"stem": lambda: media.native_stem(F.concat(F.element_at(F.array(lit("a/.h"), lit("b."), lit("")), (col("id") % 3 + 1).cast("int")), "name"))},
    r"regexp_replace((CASE id % 3 WHEN 0 THEN 'a/.h' WHEN 1 THEN 'b.' ELSE '' END) || name, '([^/])\.[^/.]*$', '\1') AS stem",
)
_SIZES = ", ".join(f"('{n}', {m}, {q})" for n, m, q in media.SIZES)


@query("s5_sizes", f"{cte('assets')} SELECT id, size_name, edge, quality FROM assets, (VALUES {_SIZES}) s(size_name, edge, quality)")
def _(spark, sf):
    return read(spark, sf, "assets").select("id", F.inline(media.thumbnail_sizes())).withColumnRenamed("size", "size_name")


scalar(
    "s6_fitted", "assets", {"w": lambda: media.fitted(col("width"), col("height"), lit(800))["width"], "h": lambda: media.fitted(col("width"), col("height"), lit(800))["height"]},
    """CASE WHEN width <= 800 AND height <= 800 THEN width WHEN width > height THEN 800 ELSE CAST(floor(CAST(800 AS FLOAT) / (CAST(height AS FLOAT) / CAST(width AS FLOAT))) AS INT) END AS w,
 CASE WHEN width <= 800 AND height <= 800 THEN height WHEN width > height THEN CAST(floor(CAST(800 AS FLOAT) / (CAST(width AS FLOAT) / CAST(height AS FLOAT))) AS INT) ELSE 800 END AS h""",
)
scalar("s7_aperture", "tags", {"aperture": lambda: media.aperture(col("f_number"))}, "'f/' || printf('%.1f', f_number) AS aperture")
scalar(
    "s8_shutter", "tags", {"shutter": lambda: media.shutter_speed(col("exposure"))},
    "CASE WHEN exposure >= 1 THEN printf('%.1f', exposure) || 's' WHEN exposure < 0 THEN '1/0' WHEN exposure = 0 THEN '1/4294967295' WHEN exposure IS NOT NULL THEN '1/' || CAST(least(round(1 / exposure), 4294967295) AS BIGINT) END AS shutter",
)
scalar(
    "s9_bias", "tags", {"label": lambda: media.exposure_bias(col("bias"))},
    "CASE WHEN bias > 0 THEN '+' || printf('%.1f', bias) || ' EV' WHEN bias < 0 THEN printf('%.1f', bias) || ' EV' WHEN bias = 0 THEN '0 EV' END AS label",
)
scalar("s10_focal_length", "tags", {"mm": lambda: media.saturated(col("focal"))}, "CASE WHEN focal IS NOT NULL THEN CAST(trunc(greatest(least(focal, 4294967295), 0)) AS BIGINT) END AS mm")
scalar("s11_iso", "tags", {"iso": lambda: media.json_count(col("doc"), "ISO")}, f"{_TAG_SQL['iso']} AS iso")
scalar("s12_text_tag", "tags", {"make": lambda: media.json_text(col("doc"), "Make")}, f"{_TAG_SQL['camera_make']} AS make")
scalar(
    "s13_number_tag", "tags", {"focal_length": lambda: media.json_number(col("doc"), "FocalLength")},
    "CASE WHEN json_type(doc, '$.FocalLength') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(doc, '$.FocalLength') AS DOUBLE) END AS focal_length",
)
_MIME = f"CASE WHEN {_ends(media.RAW)} THEN 'image/x-' || lower(regexp_extract(path, '[^.]*$')) WHEN {_ends(media.HEIF)} THEN 'image/heic' " + " ".join(f"WHEN {_ends((e,))} THEN '{m}'" for e, m in media.MIME.items()) + " ELSE 'image/unknown' END"
scalar(
    "s14_mime", "assets", {"mime": lambda: media.mime_type(col("path")), "undecoded": lambda: media.mime_type(col("path"), lit(False))},
    f"{_MIME} AS mime, CASE WHEN {_ends(media.RAW + media.HEIF)} THEN {_MIME} END AS undecoded",
)
scalar(
    "s15_decoder", "assets", {"decoder": lambda: media.decoder(F.concat("path", F.when(col("id") % 19 == 0, ".txt").otherwise("")), F.when(col("id") % 10 == 0, F.to_binary(lit("000000246674797068656963"), lit("hex"))))},
    f"CASE WHEN id % 10 = 0 THEN 'heif' WHEN id % 19 = 0 THEN NULL WHEN {_ends(media.HEIF)} THEN 'heif' WHEN {_ends(media.RAW)} THEN 'raw' ELSE 'standard' END AS decoder",
)
scalar(
    "s16_orientation", "assets", {"w": lambda: media.oriented(col("width"), col("height"), col("orientation"))["width"], "h": lambda: media.oriented(col("width"), col("height"), col("orientation"))["height"]},
    "CASE WHEN orientation BETWEEN 5 AND 8 THEN height ELSE width END AS w, CASE WHEN orientation BETWEEN 5 AND 8 THEN width ELSE height END AS h",
)


@query("s17_perceptual_hash")
def _(spark, sf):
    """Hashes of pictures made from vectors: 8 by 8 grey values."""
    def run(batches):
        import numpy as np
        from ..functions import images

        for b in batches:
            out = []
            for v in b["embedding"]:
                x = np.asarray(v, float)[:64].reshape(8, 8, 1)
                out.append(images.double_gradient(np.clip((x + 0.5) * 255, 0, 255)))
            yield pd.DataFrame({"photo_id": b["photo_id"], "hash": out})

    return read(spark, sf, "sidecar").mapInPandas(run, "photo_id long, hash string")


scalar(
    "s18_names", "assets", {"base": lambda: media.basename(col("path")), "relative": lambda: media.relative_path(F.concat(F.when(col("id") % 2 == 0, f"{BASE}/").otherwise("/other/"), "path"), lit(f"{BASE}/"))},
    "regexp_extract(path, '[^/]*$') AS base, CASE WHEN id % 2 = 0 THEN path ELSE '/other/' || path END AS relative",
)


@query("s19_vector_codec", f"{cte('sidecar')} SELECT photo_id, len(embedding) * 4 AS bytes, true AS same FROM sidecar")
def _(spark, sf):
    s = read(spark, sf, "sidecar").withColumn("blob", media.float_blob(col("embedding")))
    return s.select("photo_id", F.length("blob").cast("long").alias("bytes"), (media.blob_floats(col("blob")) == col("embedding")).alias("same"))


def toy_tower(text: "str | None") -> list[float]:
    """Another stand-in, of the whole text: 64 sums over every 64th letter's code and place. It has no meaning."""
    codes = np.fromiter(map(ord, text or ""), np.int64)
    values = (codes * 7 + np.arange(len(codes)) * 3) % 29
    return np.bincount(np.arange(len(codes)) % 64, values, 64).tolist()


_SUM = "coalesce(list_sum(list_transform(range(i, len(c), 64), lambda j: (unicode(c[CAST(j + 1 AS INT)]) * 7 + j * 3) % 29)), 0)"


@query("s20_text_embedding", f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).') AS c FROM documents)
SELECT doc_id AS id, sha256(array_to_string(list_transform(range(0, 64), lambda i: CAST({_SUM} AS BIGINT)), ',')) AS vector_sha256 FROM d""")
def _(spark, sf):
    """The stand-in text tower over every whole text, null counting as empty, as a vectorised function; of each vector a
    digest."""
    def tower(x: pd.Series) -> pd.Series:
        return x.map(toy_tower)

    d = spark.read.parquet(f"{sf}/documents.parquet").select(col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    vector = F.transform(F.pandas_udf(tower, "array<double>")("text"), lambda x: x.cast("long"))
    return d.select("id", F.sha2(F.array_join(vector, ",").cast("binary"), 256).alias("vector_sha256"))


@query("s21_image_embedding", f"{cte('assets')} SELECT id AS photo_id, id % 7 <> 3 AS ok FROM assets WHERE embedding_status = 'pending'")
def _(spark, sf):
    """A stand-in model that fails for some files; places are kept."""
    from .ingest import embedded

    def embed(paths: list[str]):
        ids = [int(p.rpartition("/")[2].partition(".")[0]) for p in paths]
        return [None if i % 7 == 3 else [float(i % 5), 1.0] for i in ids]

    a = read(spark, sf, "assets")
    work = catalog.by_ids(a, catalog.pending(a))
    return embedded(work, embed).select("photo_id", col("embedding").isNotNull().alias("ok"))


_SET = " || ', ' || ".join(f"'/api/photos/' || id || '/thumbnail/{n} {m}w'" for n, m, _ in media.SIZES)
scalar(
    "s22_urls", "assets", {"thumb": lambda: media.thumbnail_url(col("id"), "small"), "srcset": lambda: media.source_set(col("id")), "full": lambda: media.full_url(col("id"))},
    f"'/api/photos/' || id || '/thumbnail/small' AS thumb, {_SET} AS srcset, '/api/photos/' || id || '/file' AS \"full\"",
)
_BRANCH = "CASE id % 3 WHEN 0 THEN 'thumbnail' WHEN 1 THEN 'raw' ELSE 'file' END"
scalar(
    "s23_headers", "assets", {"cache": lambda: media.cache_control(F.expr(_BRANCH)), "type": lambda: media.content_type(F.expr(_BRANCH), col("mime_type"))},
    "CASE WHEN id % 3 = 0 THEN 'public, max-age=31536000, immutable' ELSE 'public, max-age=3600' END AS cache, CASE WHEN id % 3 < 2 THEN 'image/webp' ELSE coalesce(mime_type, 'application/octet-stream') END AS type",
)
scalar(
    "s24_raw_label", "assets", {"web": lambda: media.raw_label(col("raw_status")), "mobile": lambda: media.raw_label(col("raw_status"), "Pending")},
    "CASE raw_status WHEN 'converted' THEN 'Converted' WHEN 'failed' THEN 'Failed' ELSE 'Unknown' END AS web, CASE raw_status WHEN 'converted' THEN 'Converted' WHEN 'failed' THEN 'Failed' ELSE 'Pending' END AS mobile",
)


def sidecar_scalar(name: str, exprs: dict, sql: str) -> None:
    QUERIES[name] = lambda spark, sf, e=exprs: read(spark, sf, "exif").select("photo_id", *(f().alias(k) for k, f in e.items()))
    SQL[name] = f"{cte('exif')} SELECT photo_id, {sql} FROM exif"


sidecar_scalar(
    "s25_camera_label", {"camera": lambda: media.joined_label(col("camera_make"), col("camera_model")), "lens": lambda: media.joined_label(col("lens_make"), col("lens_model"))},
    "concat_ws(' ', nullif(camera_make, ''), nullif(camera_model, '')) AS camera, concat_ws(' ', nullif(lens_make, ''), nullif(lens_model, '')) AS lens",
)
sidecar_scalar(
    "s26_exposure_label", {"exposure": lambda: media.exposure_label(col("focal_length"), col("aperture"), col("shutter_speed"), col("iso"))},
    "concat_ws(' ', CASE WHEN focal_length > 0 THEN focal_length || 'mm' END, nullif(aperture, ''), nullif(shutter_speed, ''), CASE WHEN iso > 0 THEN 'ISO ' || iso END) AS exposure",
)
sidecar_scalar("s27_gps_label", {"gps": lambda: media.gps_label(col("gps_latitude"), col("gps_longitude"))}, "gps_latitude || ', ' || gps_longitude AS gps")
scalar(
    "s28_dimensions", "assets", {"dimensions": lambda: media.dimensions_label(col("width"), F.when(col("id") % 8 == 0, 0).otherwise(col("height")))},
    "CASE WHEN id % 8 <> 0 THEN width || ' x ' || height END AS dimensions",
)


@query("s29_sections", f"""{cte('assets', 'exif')}, p AS (SELECT a.id, e.* FROM assets a LEFT JOIN exif e ON photo_id = id)
SELECT id, coalesce(camera_make <> '', false) OR coalesce(camera_model <> '', false) AS has_camera, coalesce(lens_make <> '', false) OR coalesce(lens_model <> '', false) AS has_lens,
coalesce(focal_length <> 0, false) OR coalesce(iso <> 0, false) OR coalesce(aperture <> '', false) OR coalesce(shutter_speed <> '', false) OR coalesce(exposure_bias <> '', false) AS has_settings,
coalesce(date_taken <> '', false) AS has_date, coalesce(gps_latitude <> '', false) OR coalesce(gps_longitude <> '', false) AS has_location FROM p""")
def _(spark, sf):
    return catalog.completeness(catalog.with_sidecar(read(spark, sf, "assets"), read(spark, sf, "exif")))


@query("s30_debounce", """WITH e AS (SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, ts FROM events)
SELECT event_id FROM e WHERE after IS NULL OR epoch_ms(after) - epoch_ms(ts) >= 600000""")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("seq", col("event_id")).withColumn("ts", col("ts").cast("timestamp"))
    return progress.debounced(e, 600_000, "user_id").select("event_id")


@query("s31_empty_progress", "SELECT unnest(['scan', 'phash', 'embedding']) AS task_type, 0::BIGINT AS \"current\", 0::BIGINT AS total, 0::BIGINT AS items")
def _(spark, sf):
    return progress.empty(spark).drop("failed")


scalar(
    "s32_job_ids", "assets", {"scan": lambda: media.job_id("scan", at_ms=col("created_ms").cast("long")), "phash": lambda: media.job_id("phash", photo_id=col("id")), "embedding": lambda: media.job_id("embedding", at_ms=col("modified_ms").cast("long"))},
    "'scan-' || CAST(created_ms AS BIGINT) AS scan, 'phash-' || id AS phash, 'batch-embedding-' || CAST(modified_ms AS BIGINT) AS embedding",
)

# --- ordered lists -------------------------------------------------------------------------------------------------

_LIST = """, l AS (SELECT id, row_number() OVER (ORDER BY path) - 1 AS index, count(*) OVER () AS n,
 lag(id) OVER (ORDER BY path) AS p, lead(id) OVER (ORDER BY path) AS x FROM assets)"""


@query("w1_index", f"{cte('assets')}{_LIST} SELECT id, index FROM l")
def _(spark, sf):
    return navigation.numbered(read(spark, sf, "assets"), "path").select("id", "index")


@query("w2_neighbours", f"{cte('assets')}{_LIST} SELECT id, coalesce(p, id) AS prev_id, coalesce(x, id) AS next_id FROM l")
def _(spark, sf):
    return navigation.neighbours(read(spark, sf, "assets"), "path").select("id", "prev_id", "next_id")


@query("w2_navigate", f"{cte('assets')}{_LIST} SELECT 'next' AS direction, x AS id FROM l WHERE id = 20 UNION ALL SELECT 'prev', p FROM l WHERE id = 20 UNION ALL (SELECT 'last', id FROM l ORDER BY index DESC LIMIT 1)")
def _(spark, sf):
    a = read(spark, sf, "assets")
    steps = (("next", 20, "next"), ("prev", 20, "prev"), ("last", None, "prev"))
    return reduce(DataFrame.unionByName, (navigation.navigate(a, i, d, "path").select(lit(n).alias("direction"), "id") for n, i, d in steps))


@query("w3_has_neighbours", f"{cte('assets')}{_LIST} SELECT id, p IS NOT NULL AS has_prev, x IS NOT NULL AS has_next FROM l")
def _(spark, sf):
    return navigation.neighbours(read(spark, sf, "assets"), "path").select("id", "has_prev", "has_next")


@query("w4_range", f"{cte('assets')}{_LIST} SELECT id FROM l WHERE index BETWEEN 12 AND 40")
def _(spark, sf):
    return navigation.ranged(read(spark, sf, "assets"), 40, 12, "path").select("id")


@query("w5_toggle", f"{cte('assets')} SELECT id FROM assets WHERE (id % 4 = 0) <> (id % 6 = 0)")
def _(spark, sf):
    a = read(spark, sf, "assets")
    return navigation.toggled(a.where("id % 4 = 0"), a.where("id % 6 = 0"))


@query("w6_select", f"{cte('assets')} SELECT id, 'all' AS how FROM assets UNION ALL SELECT 5, 'single'")
def _(spark, sf):
    a = read(spark, sf, "assets")
    return reduce(DataFrame.unionByName, (navigation.select(a, h, 5).withColumn("how", lit(h)) for h in ("all", "single", "clear")))


@query("w7_jump", f"{cte('assets')}{_LIST} SELECT id FROM l WHERE index = 17")
def _(spark, sf):
    return navigation.at_index(read(spark, sf, "assets"), 17, "path").select("id")


@query("w8_default_active", f"{cte('assets')} SELECT id FROM assets WHERE id % 10 = 7 ORDER BY path LIMIT 1")
def _(spark, sf):
    a = read(spark, sf, "assets")
    return navigation.default_active(a, a.where("id % 10 = 7"), "path").select("id")


@query("w9_position", f"{cte('assets')}{_LIST} SELECT id, (index + 1) || ' / ' || n AS position FROM l")
def _(spark, sf):
    return navigation.neighbours(read(spark, sf, "assets"), "path").select("id", "position")


# --- writes --------------------------------------------------------------------------------------------------------


@query("snk1_upsert", f"""{cte('assets')}{_RESULTS}, g AS (SELECT * FROM results WHERE success),
fresh AS (SELECT g.*, row_number() OVER (ORDER BY g.path) AS rn FROM g WHERE g.path NOT IN (SELECT path FROM assets))
SELECT a.id, a.path, coalesce(g.size, a.size) AS size, CASE WHEN g.path IS NULL THEN a.embedding_status ELSE 'pending' END AS embedding_status,
 CASE WHEN g.path IS NULL THEN a.phash_status WHEN g.phash IS NOT NULL THEN 'completed' ELSE 'failed' END AS phash_status, CAST(floor(a.created_ms / 1000) AS BIGINT) AS created_s
FROM assets a LEFT JOIN g ON g.path = a.path
UNION ALL SELECT (SELECT max(id) FROM assets) + rn, path, size, 'pending', CASE WHEN phash IS NOT NULL THEN 'completed' ELSE 'failed' END, CAST(floor(created_ms / 1000) AS BIGINT) FROM fresh""")
def _(spark, sf):
    new = upsert.upsert(_catalog(spark, sf), _results(spark, sf))
    return new.select("id", "path", "size", "embedding_status", "phash_status", F.unix_seconds("created_at").alias("created_s"))


@query("snk2_exif_replace", f"""{cte('assets', 'exif')}{_RESULTS}, k AS (SELECT a.id FROM results r JOIN assets a USING (path) WHERE r.success AND r.has_exif)
SELECT photo_id, camera_make, CAST(iso AS BIGINT) AS iso FROM exif WHERE photo_id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'New', 800 FROM k""")
def _(spark, sf):
    old = read(spark, sf, "exif").select("photo_id", "camera_make", col("iso").cast("long").alias("iso"))
    return upsert.replaced(old, upsert.exif_rows(read(spark, sf, "assets"), _results(spark, sf)))


@query("snk3_hash_replace", f"{cte('assets')}{_RESULTS} SELECT a.id AS photo_id, r.phash AS hash, 'double_gradient_8x8' AS algorithm FROM results r JOIN assets a USING (path) WHERE r.success AND r.phash IS NOT NULL")
def _(spark, sf):
    return upsert.hash_rows(read(spark, sf, "assets"), _results(spark, sf)).drop("created_at")


_MADE = ", m AS (SELECT id AS photo_id, id % 7 <> 3 AS ok FROM assets WHERE embedding_status = 'pending')"


@query("snk4_save_embeddings", f"""{cte('assets', 'sidecar')}{_MADE}
SELECT a.id, coalesce(CASE WHEN m.ok THEN 'completed' WHEN NOT m.ok THEN 'failed' END, a.embedding_status) AS status,
 CASE WHEN m.ok THEN 2 ELSE len(s.embedding) END AS dimensions FROM assets a LEFT JOIN m ON m.photo_id = a.id LEFT JOIN sidecar s ON s.photo_id = a.id""")
def _(spark, sf):
    a = read(spark, sf, "assets")
    made = catalog.pending(a).select(col("id").alias("photo_id"), F.when(col("id") % 7 != 3, F.array(lit(1.0), lit(2.0)).cast("array<float>")).alias("embedding"))
    old = read(spark, sf, "sidecar").select("photo_id", "embedding", lit("old").alias("model_version"), F.current_timestamp().alias("created_at"))
    new, side = upsert.save_embeddings(a, old, made)
    n = side.select(col("photo_id").alias("id"), F.size("embedding").cast("long").alias("dimensions"))
    return new.join(n, "id", "left").select("id", col("embedding_status").alias("status"), "dimensions")


@query("snk5_save_hash", f"{cte('assets')} SELECT id, CASE WHEN id % 9 = 0 THEN 'completed' WHEN id % 9 = 1 THEN 'failed' ELSE phash_status END AS status FROM assets")
def _(spark, sf):
    a = read(spark, sf, "assets")
    batch = a.where("id % 9 < 2").select(col("id").alias("photo_id"), F.when(col("id") % 9 == 0, lit("h")).alias("hash"))
    none = spark.createDataFrame([], "photo_id long, hash string, algorithm string, created_at timestamp")
    return upsert.save_hashes(a, none, batch)[0].select("id", col("phash_status").alias("status"))


@query("snk6_thumbnail_plan", f"{cte('assets')} SELECT id, size_name || '/' || {_STEM} || '.webp' AS target, size_name FROM assets, (VALUES {_SIZES}) s(size_name, edge, quality)")
def _(spark, sf):
    a = read(spark, sf, "assets").select("id", "path", F.inline(media.thumbnail_sizes()))
    return a.select("id", media.thumbnail_path(col("path"), col("size")).alias("target"), col("size").alias("size_name"))


@query("snk7_saved_rows", f"{cte('assets')}{_RESULTS} SELECT a.id, r.path, CASE WHEN r.is_raw THEN 'converted' END AS raw_status, r.has_exif FROM results r JOIN assets a USING (path) WHERE r.success")
def _(spark, sf):
    return upsert.saved_rows(read(spark, sf, "assets"), _results(spark, sf)).select("id", "path", "raw_status", col("exif").isNotNull().alias("has_exif"))


_REQ = ", q AS (SELECT CASE WHEN id % 21 = 5 THEN 'x' || id WHEN id % 21 = 6 THEN '9' || (id + 1000000) ELSE CAST(id AS VARCHAR) END AS id FROM assets)"


def _requests(spark, sf) -> DataFrame:
    i = col("id")
    return read(spark, sf, "assets").select(
        F.when(i % 21 == 5, F.concat(lit("x"), i.cast("string"))).when(i % 21 == 6, F.concat(lit("9"), (i + 1000000).cast("string"))).otherwise(i.cast("string")).alias("id")
    )


def _present(spark, sf) -> DataFrame:
    a = read(spark, sf, "assets").where("id % 8 <> 3")
    return a.select("path").union(a.select(media.thumbnail_path(col("path"), lit("large")))).union(a.where("id % 4 = 0").select(media.thumbnail_path(col("path"), lit("tiny"))))


@query("snk8_serve_file", f"""{cte('assets')}{_REQ}, r AS (SELECT q.id, a.id AS aid, try_cast(q.id AS BIGINT) AS num, a.path, a.mime_type, coalesce(a.is_raw, false) AS raw, a.raw_status FROM q LEFT JOIN assets a ON a.id = try_cast(q.id AS BIGINT)),
s AS (SELECT *, CASE WHEN num IS NULL THEN 400 WHEN path IS NULL THEN 404 WHEN raw AND raw_status IS DISTINCT FROM 'converted' THEN 422 WHEN aid % 8 = 3 THEN 404 ELSE 200 END AS status FROM r)
SELECT id, status, CASE WHEN status = 200 THEN CASE WHEN raw THEN 'large/' || {_STEM} || '.webp' ELSE path END END AS path, CASE WHEN status = 200 THEN CASE WHEN raw THEN 'image/webp' ELSE coalesce(mime_type, 'application/octet-stream') END END AS content_type FROM s""")
def _(spark, sf):
    return serving.files(_requests(spark, sf), read(spark, sf, "assets"), _present(spark, sf)).drop("cache_control")


@query("snk9_serve_thumbnail", f"""{cte('assets')}{_REQ}, z AS (SELECT id, unnest(['tiny', 'huge']) AS size FROM q),
r AS (SELECT z.id, z.size, a.id AS aid, try_cast(z.id AS BIGINT) AS num, a.path FROM z LEFT JOIN assets a ON a.id = try_cast(z.id AS BIGINT)),
s AS (SELECT *, CASE WHEN num IS NULL OR size = 'huge' THEN 400 WHEN path IS NULL THEN 404 WHEN aid % 8 = 3 OR aid % 4 <> 0 THEN 302 ELSE 200 END AS status FROM r)
SELECT id, size, status, CASE status WHEN 200 THEN 'tiny/' || {_STEM} || '.webp' WHEN 302 THEN '/api/photos/' || num || '/file' END AS path FROM s""")
def _(spark, sf):
    q = _requests(spark, sf).select("id", F.explode(F.array(lit("tiny"), lit("huge"))).alias("size"))
    return serving.thumbnails(q, read(spark, sf, "assets"), _present(spark, sf)).drop("content_type", "cache_control")


@query("snk10_tables", "SELECT unnest(['photos', 'photo_exif', 'photo_embedding', 'photo_phash']) AS name, unnest([16, 14, 4, 4]::BIGINT[]) AS columns")
def _(spark, sf):
    from ..schema import TABLES, create_tables

    root = shared_folder(spark, "tables")
    database = f"made_{root[-12:]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}'")
    try:
        made = create_tables(spark, database) + create_tables(spark, database)
        rows = [(n, len(spark.table(f"{database}.{n}").columns)) for n in made]
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
        remove(spark, root)
    assert len(rows) == len(TABLES)
    return spark.createDataFrame(rows, "name string, columns long")


@query("snk_rejected", f"{cte('assets')}{_RESULTS} SELECT path, coalesce(raw_error, 'broken') AS error FROM results WHERE NOT success")
def _(spark, sf):
    return upsert.rejected(_results(spark, sf)).select("path", "error")


# --- streams, as batches; tests/test_streaming.py compares both ------------------------------------------------------


@query("st1_tagged_events", f"{cte('jobs')} SELECT task_type, event_type, count(*) AS events FROM jobs GROUP BY ALL")
def _(spark, sf):
    from ..streaming.progress import merged

    j = read(spark, sf, "jobs")
    return merged(*(progress.of_tasks(j, [t]) for t in ("scan", "phash", "embedding"))).groupBy("task_type", "event_type").agg(F.count(lit(1)).alias("events"))


@query("st3_progress_fold", f'{cte("jobs")}{_FOLD} SELECT task_type, "current", total, items, failed FROM fold')
def _(spark, sf):
    return _fold(spark, sf)


@query("st3_stream_fold", f'{cte("jobs")}{_FOLD} SELECT task_type, "current", total, items, failed FROM fold')
def _(spark, sf):
    """The same by a stream with keyed state, over the events as files, each of them a batch."""
    return _streamed(spark, sf, lambda s, out: _last_state(spark, s, out))


def _streamed(spark, sf, use):
    """use(stream of the jobs' events, a folder for what its sink keeps); its rows are computed before both go."""
    from ..schema import EVENT
    from ..streaming.progress import events

    root = shared_folder(spark, "events")
    try:
        j = read(spark, sf, "jobs").withColumn("job_id", lit("run"))
        last = j.agg(F.max("seq")).first()[0] or 0
        for part in range(3):  # files in the order of their events
            own = j.where((col("seq") * 3 / (last + 1)).cast("int") == part)
            own.select(*(col(f.name).cast(f.dataType) for f in EVENT)).write.mode("append").parquet(f"{root}/in")
        return checkpointed(use(events(spark, f"{root}/in", maxFilesPerTrigger="1"), f"{root}/out"))
    finally:
        remove(spark, root)


def _last_state(spark, stream, out: str) -> DataFrame:
    from ..streaming import keyed

    with keyed.state_store(spark):
        _drain(spark, keyed.kept_in(keyed.partials(stream), out))
    return keyed.state_of(keyed.latest(keyed.kept(spark, out, keyed.PARTIAL))).drop("run")


def _drain(spark, writer) -> None:
    """Runs a stream's writer until it has caught up, with a checkpoint of its own in the shared folder."""
    folder = shared_folder(spark, "stream")
    q = writer.option("checkpointLocation", folder).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        remove(spark, folder)


@query("st4_embedding_rule", f'{cte("jobs")}{_FOLD} SELECT "current", total FROM fold WHERE task_type = \'embedding\'')
def _(spark, sf):
    return _fold(spark, sf).where("task_type = 'embedding'").select("current", "total")


@query("st5_view_append", f"{cte('jobs')} SELECT DISTINCT photo_id AS id FROM jobs WHERE task_type = 'scan' AND event_type = 'progress' AND phase = 'processing' AND photo_id IS NOT NULL")
def _(spark, sf):
    """What is appended to the cached list, batch by batch, as the sink has written it."""
    from ..streaming import keyed
    from ..streaming.progress import appended

    def use(stream, out):
        _drain(spark, keyed.kept_in(appended(stream).select("id"), out, "append"))
        return keyed.kept(spark, out, "id long").select("id")

    return _streamed(spark, sf, use)


@query("st6_invalidate", f"{cte('jobs')} SELECT count(*) > 0 AS refresh FROM jobs WHERE task_type = 'scan' AND event_type = 'completed'")
def _(spark, sf):
    from ..streaming.progress import on_completed

    def use(stream, _):
        calls: list = []
        _drain(spark, on_completed(stream, lambda: calls.append(1)))
        return spark.createDataFrame([(bool(calls),)], "refresh boolean")

    return _streamed(spark, sf, use)


@query("st7_emitted", f'{cte("jobs")} SELECT task_type, phase, count("current") AS with_current, count(total) AS with_total FROM jobs WHERE event_type = \'progress\' GROUP BY ALL')
def _(spark, sf):
    p = read(spark, sf, "jobs").where("event_type = 'progress'")
    return p.groupBy("task_type", "phase").agg(F.count("current").alias("with_current"), F.count("total").alias("with_total"))


@query("st8_retained", f"""{cte('jobs')}{_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_type, state ORDER BY seq DESC) AS rn FROM j)
SELECT seq, task_type, state FROM r WHERE state NOT IN ('completed', 'failed') OR rn <= CASE state WHEN 'completed' THEN 100 ELSE 50 END""")
def _(spark, sf):
    return progress.retained(_jobs(spark, sf)).select("seq", "task_type", "state")


@query("st2_delivery", f"{cte('jobs')} SELECT count(*) AS delivered, count(DISTINCT seq) AS events FROM jobs")
def _(spark, sf):
    """All events of a stream, handed to a sink in batches, each once; the sink writes what it is handed."""
    from ..streaming import keyed
    from ..streaming.progress import delivered

    def use(stream, out):
        def sink(batch, number):
            batch.select("seq").write.mode("overwrite").parquet(f"{out}/batch={number}")

        root = shared_folder(spark, "delivered")
        q = delivered(stream, sink, root).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
            remove(spark, root)
        return keyed.kept(spark, out, "seq long").agg(F.count(lit(1)).alias("delivered"), F.countDistinct("seq").alias("events"))

    return _streamed(spark, sf, use)


@query("st9_pools", "SELECT unnest(['scan', 'phash', 'embedding']) AS task, unnest([1, 4, 1]::BIGINT[]) AS jobs")
def _(spark, sf):
    from ..streaming.progress import POOLS

    return spark.createDataFrame(list(POOLS.items()), "task string, jobs long")


@query("st10_micro_batches", f"{cte('assets')} SELECT CAST(ceil(count(*) / 16.0) AS BIGINT) AS batches, count(*) AS files, max(least(16, 16))::BIGINT AS largest FROM assets WHERE embedding_status = 'pending'")
def _(spark, sf):
    """How a stand-in model is called: each vector says how many files came with it."""
    from .ingest import embedded

    a = read(spark, sf, "assets")
    work = catalog.by_ids(a, catalog.pending(a)).coalesce(1)
    sizes = embedded(work, lambda paths: [[1.0 / len(paths), float(len(paths))]] * len(paths)).select(
        col("embedding")[0].cast("double").alias("share"), col("embedding")[1].cast("long").alias("n")
    )
    return sizes.agg(F.round(F.sum("share")).cast("long").alias("batches"), F.count(lit(1)).alias("files"), F.max("n").alias("largest"))


@query("src8_heif_decode", f"{cte('assets')} SELECT id, CAST(3 AS BIGINT) AS channels FROM assets WHERE {_ends(media.HEIF)}")
def _(spark, sf):
    """With a stand-in for the codec: files that are HEIF by name reach it."""
    def run(batches):
        import numpy as np

        from .ingest import Tools

        tools = Tools(heif=lambda data: np.zeros((2, 2, 3), np.uint8))
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "channels": [tools.heif(p.encode()).shape[2] for p in b["path"]]})

    a = read(spark, sf, "assets").where(media.decoder(col("path")) == "heif")
    return a.select("id", "path").mapInPandas(run, "id long, channels long")


# --- declared by the reference's roadmap only ------------------------------------------------------------------------


@query("d_exif_filters", f"{cte('exif')} SELECT photo_id FROM exif WHERE camera_make = 'Sony' AND iso BETWEEN 100 AND 800 AND {_TAKEN} >= TIMESTAMP '2015-01-01'")
def _(spark, sf):
    return read(spark, sf, "exif").where((col("camera_make") == "Sony") & col("iso").between(100, 800) & (taken() >= lit("2015-01-01").cast("timestamp"))).select("photo_id")


@query("d_location_radius", f"""{cte('exif')}, g AS (SELECT photo_id, radians(CAST(gps_latitude AS DOUBLE)) AS a, radians(CAST(gps_longitude AS DOUBLE)) AS o FROM exif WHERE gps_latitude IS NOT NULL AND gps_longitude IS NOT NULL),
d AS (SELECT photo_id, 2 * 6371.0 * asin(sqrt(least(1, pow(sin((a - radians(45)) / 2), 2) + cos(radians(45)) * cos(a) * pow(sin((o - radians(60)) / 2), 2)))) AS km FROM g)
SELECT photo_id, round(km, 3) AS km FROM d WHERE km <= 4000""")
def _(spark, sf):
    a, o = F.radians(col("gps_latitude").cast("double")), F.radians(col("gps_longitude").cast("double"))
    h = F.pow(F.sin((a - F.radians(lit(45.0))) / 2), 2) + F.cos(F.radians(lit(45.0))) * F.cos(a) * F.pow(F.sin((o - F.radians(lit(60.0))) / 2), 2)
    km = 2 * 6371.0 * F.asin(F.sqrt(F.least(lit(1.0), h)))
    return read(spark, sf, "exif").select("photo_id", F.round(km, 3).alias("km")).where("km <= 4000")


@query("d_on_this_day", f"{cte('exif')} SELECT photo_id, CAST(year({_TAKEN}) AS INT) AS year FROM exif WHERE month({_TAKEN}) = 3 AND day({_TAKEN}) = 12")
def _(spark, sf):
    return read(spark, sf, "exif").where((F.month(taken()) == 3) & (F.dayofmonth(taken()) == 12)).select("photo_id", F.year(taken()).alias("year"))


@query("d_same_size_files", f"{cte('assets')} SELECT size, count(*) AS files, min(id) AS first_id FROM assets GROUP BY size HAVING count(*) > 1")
def _(spark, sf):
    return catalog.duplicates_by(read(spark, sf, "assets"), "size")


@query("d_subtree_totals", f"{cte('assets')}{_TREE} SELECT t.path, sum(u.photo_count)::BIGINT AS total_count FROM tree t JOIN tree u ON u.path = t.path OR starts_with(u.path, t.path || '/') GROUP BY t.path")
def _(spark, sf):
    return folders.totals(_tree(spark, sf)).select("path", "total_count")


@query("d_smart_album", f"{cte('assets', 'exif')} SELECT id FROM assets JOIN exif ON photo_id = id WHERE (camera_make = 'Canon' AND iso >= 400) OR (raw_format = 'NEF' AND width > height)")
def _(spark, sf):
    """Filters combined by AND and OR."""
    rows = catalog.with_sidecar(read(spark, sf, "assets"), read(spark, sf, "exif")).where("exif is not null")
    canon = (col("exif.camera_make") == "Canon") & (col("exif.iso") >= 400)
    return rows.where(canon | ((col("raw_format") == "NEF") & (col("width") > col("height")))).select("id")


@query("d_favourites", f"{cte('assets')} SELECT id, id % 25 = 3 AS favourite FROM assets")
def _(spark, sf):
    a = read(spark, sf, "assets")
    marks = navigation.toggled(a.limit(0), a.where("id % 25 = 3")).withColumn("favourite", lit(True))
    return a.select("id").join(marks, "id", "left").select("id", F.coalesce("favourite", lit(False)).alias("favourite"))


@query("d_zero_shot_tags", """WITH t AS (SELECT vec_id AS tag, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (10, 20, 30)),
s AS (SELECT e.vec_id AS photo_id, t.tag, list_distance(CAST(e.embedding AS DOUBLE[]), t.v) AS d FROM embeddings e, t)
SELECT photo_id, arg_min(tag, d) AS tag, round(exp(-min(d)) / sum(exp(-d)), 6) AS confidence FROM s GROUP BY photo_id""")
def _(spark, sf):
    """The nearest of a few tags' vectors, with the share of its weight."""
    s = read(spark, sf, "sidecar")
    tags = s.where("photo_id IN (10, 20, 30)").select(col("photo_id").alias("query_id"), "embedding")
    d = vectors.all_distances(s, tags).groupBy("photo_id")
    share = F.exp(-F.min("distance")) / F.sum(F.exp(-col("distance")))
    return d.agg(F.min_by("query_id", "distance").alias("tag"), F.round(share, 6).alias("confidence"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic search: the nearest stored vectors of a query vector, joined to the catalog with EXIF, in order."""
    a = catalog.with_sidecar(read(spark, sf_dir, "assets"), read(spark, sf_dir, "exif"))
    found = vectors.search(a, read(spark, sf_dir, "sidecar"), _vector(spark, sf_dir, 0), 20)
    return found.select("rank", "id", "path", media.file_size(col("size")).alias("size"), "distance", "exif.camera_make")
