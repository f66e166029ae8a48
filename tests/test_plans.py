"""What plans must look like to hold at scale: pushed filters, pruned columns, bounded top-k, no products of tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lenscape.operators import catalog, folders, hashing, progress, serving, upsert, vectors
from lenscape.schema import PHOTO_EXIF, PHOTOS, RESULT


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    ids = spark.range(200)
    photo = ids.select(
        *(
            (F.col("id") if f.name == "id" else F.concat(F.lit("a/"), F.col("id").cast("string")) if f.name == "path" else F.lit("1").try_cast(f.dataType)).alias(f.name)
            for f in PHOTOS
        )
    )
    photo.write.parquet(f"{root}/photos")
    ids.select(*(F.lit(1).cast(f.dataType).alias(f.name) if f.name != "photo_id" else F.col("id").alias("photo_id") for f in PHOTO_EXIF)).write.parquet(f"{root}/exif")
    ids.select(F.col("id").alias("photo_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding")).write.parquet(f"{root}/vectors")
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("photos", "exif", "vectors")}


def test_filters_and_columns_reach_the_scan(tables):
    p = plan(catalog.photos(tables["photos"], which="raw", folder="a").select("id"))
    assert "StringStartsWith(path,a/)" in p and "EqualTo(is_raw,true)" in p
    assert "ReadSchema: struct<id:bigint,path:string,is_raw:boolean>" in p and "Exchange" not in p
    p = plan(catalog.pending(tables["photos"]))
    assert "EqualTo(embedding_status,pending)" in p and "ReadSchema: struct<id:bigint,embedding_status:string>" in p
    p = plan(catalog.photo(tables["photos"], 5).select("path"))
    assert "EqualTo(id,5)" in p


def test_sidecar_join_reads_what_is_asked_for(tables):
    p = plan(catalog.photos(tables["photos"], tables["exif"]).select("id", "exif.iso"))
    assert "ReadSchema: struct<photo_id:bigint,iso:bigint>" in p and "ReadSchema: struct<id:bigint>" in p
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_search_keeps_k_rows_a_task(tables):
    for f in (vectors.top_k, vectors.top_k_builtin):
        p = plan(f(tables["vectors"], [0.0, 1.0], 5))
        assert "TakeOrderedAndProject(limit=5" in p and "Exchange" not in p.replace("BroadcastExchange", "")
    p = plan(vectors.search(tables["photos"], tables["vectors"], [0.0, 1.0], 5).select("id"))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_retention_limits_before_it_deals_out(spark):
    name = F.when(F.col("id") % 2 == 0, "scan").otherwise("phash")
    jobs = spark.range(1000).select(F.col("id").alias("seq"), name.alias("task_type"), F.when(F.col("id") % 3 == 0, "failed").otherwise("completed").alias("state"))
    p = plan(progress.retained(jobs))
    assert p.count("WindowGroupLimit") == 2  # one before the exchange, one behind it


def test_tree_counts_folders_first(tables):
    p = plan(folders.tree(tables["photos"]))
    assert "ReadSchema: struct<path:string>" in p
    assert p.index("Generate explode") < p.rindex("HashAggregate")  # what is exploded are folders that are counted already


def test_no_products_of_tables(spark, tables):
    results = spark.createDataFrame([], RESULT)
    hashes = tables["photos"].select("id", F.col("size").alias("hash"))
    asked, there = tables["photos"].select(F.col("id").cast("string").alias("id")), tables["photos"].select("path")
    for df in (
        hashing.close_pairs(hashes, 3), serving.files(asked, tables["photos"], there),
        catalog.by_ids(tables["photos"], tables["exif"].select(F.col("photo_id").alias("id"))), upsert.exif_rows(tables["photos"], results),
    ):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


#: Numbers of the inventory's operators of each kind.
INVENTORY = {"src": 16, "snk": 10, "f": 15, "j": 7, "a": 16, "k": 7, "s": 32, "w": 9, "st": 10}


def test_every_operator_of_the_inventory_has_a_query():
    kinds = {k.split("_")[0] for k in entry.queries()}
    assert not [f"{kind}{i}" for kind, n in INVENTORY.items() for i in range(1, n + 1) if f"{kind}{i}" not in kinds]
