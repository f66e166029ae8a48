import random

from lenscape.operators import folders, kept_list


def test_kept_list(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abcxyz") * rng.randrange(1, 4), i, "n") for i in range(500)]
    own = sorted((a, i) for a, i, _ in rows)
    df = spark.createDataFrame(rows, "path string, id long, at string").withColumnRenamed("at", "name").repartition(5)
    kept_list.build(df, f"file://{tmp_path}/list", "path", "id", ranges=6)
    one = kept_list.KeptList(spark, f"file://{tmp_path}/list", df.schema, "path", "id")  # opened again
    assert len(one) == 500 and 2 <= len(one.ranges) <= 6
    places = lambda got: sorted((r["index"], (r.path, r.id)) for r in got.collect())
    assert places(one.rows()) == list(enumerate(own))
    for i in (0, 17, 250, 499):
        assert places(one.at(i)) == [(i, own[i])] and one.position(*own[i]) == i
        assert places(one.neighbours(i)) == [(k, own[k]) for k in range(max(i - 1, 0), min(i + 2, 500))]
    assert places(one.between(300, 120)) == [(k, own[k]) for k in range(120, 301)]
    for i in (-1, 500):
        assert one.at(i).collect() == [] and one.neighbours(i).collect() == []
    assert one.position("b", 10**6) is None and one.position("", 0) is None
    assert one.between(600, 900).collect() == []


def test_one_range_is_read(spark, tmp_path):
    df = spark.range(1000).selectExpr("id")
    one = kept_list.build(df, f"file://{tmp_path}/list", ranges=8)
    at = one.at(400)
    plan = at._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Exchange" not in plan and "Sort" not in plan
    scan = at._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    assert scan.selectedPartitions().totalNumberOfFiles() == 1
    none = kept_list.build(df.limit(0), f"file://{tmp_path}/none")
    assert len(none) == 0 and none.rows().collect() == [] and none.at(0).collect() == []


def test_walk_is_the_recursive_order(spark):
    paths = ["b/x/1.jpg", "b/a/2.jpg", "b!/3.jpg", "b/x/y/z/4.jpg", "é/5.jpg", "a/6.jpg", "7.jpg", "b/x/8.jpg", "f/9.jpg"]
    tree = folders.tree(spark.createDataFrame([(p,) for p in paths], "path string"))
    walk = {r.path: r for r in folders.walked(tree).collect()}
    nodes = folders.ordered(tree).collect()
    order, after = [], []

    def visit(parent):
        for r in nodes:
            if r.parent_path == parent:
                order.append(r.path)
                visit(r.path)
                after.append(r.path)

    visit(None)
    assert sorted(walk, key=lambda p: walk[p].pre) == order and [walk[p].pre for p in order] == list(range(len(order)))
    assert sorted(walk, key=lambda p: walk[p].post) == after
    totals = {r.path: r.total_count for r in folders.totals(tree).collect()}
    for p in order:
        below = [r for r in walk.values() if walk[p].pre <= r.pre <= walk[p].last]
        assert sorted(r.path for r in below) == sorted(x for x in order if x == p or x.startswith(p + "/"))
        assert sum(r.photo_count for r in below) == totals[p]
    got = folders.subtree(folders.walked(tree), "b/x").collect()
    assert [r.path for r in got] == ["b/x", "b/x/y", "b/x/y/z"]
