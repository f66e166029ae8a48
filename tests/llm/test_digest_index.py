import hashlib

import pytest
from pyspark.sql import functions as F

from lenscape.llm import _common, digest_index as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(t):
    return hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()


ROWS = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "x" * 300_000), (10, "one"), (None, "one"), (None, "alone")]


def frame(spark, rows, parts=3):
    # extra columns with the names that the operator uses itself
    return spark.createDataFrame([(a, t, "k", 5) for a, t in rows], "doc_id long, text string, digest string, row int").repartition(parts)


def index(spark, tmp_path, buckets=4):
    return d.DigestIndex(spark, f"file://{tmp_path}/index", buckets)


def test_one_batch(spark, tmp_path):
    got = d.deduplicate(frame(spark, ROWS), index(spark, tmp_path), "one").collect()
    want = []
    for a, t in ROWS:
        same = [b for b, u in ROWS if sha(u) == sha(t)]
        keep = max((b for b in same if b is not None), default=None)
        want.append((str(a), str(keep), len(same), a == keep))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted(want)
    assert all(r.digest in {sha(t) for a, t in ROWS if a == r.doc_id} and not r.known for r in got)


def test_repeated_rows_keep_one(spark, tmp_path):
    got = d.deduplicate(frame(spark, [(1, "a")] * 5 + [(None, "b")] * 3), index(spark, tmp_path), "one").collect()
    assert sum(r.kept for r in got if r.doc_id == 1) == 1 and sum(r.kept for r in got if r.doc_id is None) == 1
    assert {r.group_size for r in got} == {5, 3}


def test_later_batches(spark, tmp_path):
    own = index(spark, tmp_path)
    d.deduplicate(frame(spark, [(1, "a"), (2, "b"), (3, "B")]), own, "one")
    second = {r.doc_id: r for r in d.deduplicate(frame(spark, [(4, "A"), (5, "c"), (6, "C"), (7, "c")]), own, "two").collect()}
    assert second[4].known and not second[4].kept and second[4].keep_id == 1
    assert second[7].kept and second[7].group_size == 3 and not second[5].kept
    spark.sql(f"DROP TABLE {own.name}")  # another session opens the same files
    again = index(spark, tmp_path)
    third = d.deduplicate(frame(spark, [(8, "B"), (9, "new")]), again, "three").collect()
    assert {r.doc_id: (r.known, r.kept) for r in third} == {8: (True, False), 9: (False, True)}
    assert {r.digest for r in again.entries().collect()} == {sha(t) for t in ("a", "b", "c", "new")}
    assert again.entries().count() == 4
    small = again.compacted(f"file://{tmp_path}/compacted")
    assert sorted(small.entries().collect()) == sorted(again.entries().collect())
    assert len(list((tmp_path / "compacted").glob("part-*"))) <= 4
    assert not any(r.kept for r in d.deduplicate(frame(spark, [(20, "C")]), small, "four").collect())


def test_a_batch_that_runs_again(spark, tmp_path):
    own = index(spark, tmp_path)
    d.deduplicate(frame(spark, [(1, "a"), (2, "b")]), own, "one")
    batch = [(3, "A"), (4, "c"), (5, "c"), (6, "d")]
    first = d.deduplicate(frame(spark, batch), own, "two")
    want = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.known) for r in first.collect())
    for parts in (1, 3):  # rows have other numbers then
        again = d.deduplicate(frame(spark, batch[::-1], parts), own, "two")
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.known) for r in again.collect()) == want
    assert [w[0] for w in want if w[3]] == [5, 6] and own.entries().count() == 4
    d.forget(own)
    assert not spark.catalog.tableExists(own.name) and not (tmp_path / "index").exists()


def test_no_documents(spark, tmp_path):
    own = index(spark, tmp_path)
    assert d.deduplicate(frame(spark, []), own, "one").count() == 0 and own.entries().count() == 0


def test_plan_is_native_and_reads_buckets(spark, tmp_path):
    own = index(spark, tmp_path)
    docs = frame(spark, ROWS)
    groups = d.digests(docs).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    plan = own.unseen(groups)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("share", [1, 2, 10**9])
def test_join_to_groups_whatever_is_frequent(spark, monkeypatch, share):
    monkeypatch.setattr(_common, "HOT_KEYS", share)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(100)], "k long, v long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
    got = _common.join_to_groups(rows, groups, "k", "n", 100).select("k", "v", "least").collect()
    least = {}
    for k, v in sorted(rows.collect(), key=lambda r: r.v):
        least.setdefault(k, v)
    assert sorted(map(tuple, got)) == sorted((r.k, r.v, least[r.k]) for r in rows.collect())


def test_without_rows(spark, tmp_path, monkeypatch):
    frame(spark, ROWS).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    own, name = _common.numbered(docs)
    assert name == "row_"
    some = own.where("doc_id % 2 = 0").select(F.col(name).alias("row"))
    few = _common.without_rows(own, name, some)
    monkeypatch.setattr(_common, "SENT_ROWS", 0)
    many = _common.without_rows(own, name, some)
    want = sorted(str(a) for a, _ in ROWS if a is None or a % 2)
    assert few.columns == docs.columns and {r.row for r in few.collect()} == {5}
    assert sorted(str(r.doc_id) for r in few.collect()) == sorted(str(r.doc_id) for r in many.collect()) == want


def test_hash_sample(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("h"), "id")
    want = [r.id for r in df.orderBy("h", "id").limit(20).collect()]
    for total in (0, 500, 1000, 10**9):  # the last bound lets none pass
        assert [r.id for r in _common.hash_sample(df, 20, total)] == want
    assert len(_common.hash_sample(df, 5000, 1000)) == 1000 and _common.hash_sample(df.limit(0), 5, 1000) == []


def test_an_index_keeps_its_number_of_buckets(spark, tmp_path):
    rows = [(i, f"text {i % 150}") for i in range(200)]
    own = d.DigestIndex(spark, f"file://{tmp_path}/kept", 8)
    first = d.deduplicate(frame(spark, rows), own, "one")
    assert first.where("kept").count() == 150
    own.close()  # as in another session
    assert not spark.catalog.tableExists(own.name)
    assert first.where("kept").count() == 150  # results hold
    again = d.DigestIndex(spark, f"file://{tmp_path}/kept", 4)
    assert again.buckets == 8 and again.entries().count() == 150
    second = d.deduplicate(frame(spark, rows), again, "two")
    assert second.where("kept").count() == 0 and second.where("known").count() == 200 and again.entries().count() == 150
    (next((tmp_path / "kept").glob("_buckets-8"))).unlink()
    again.close()
    with pytest.raises(ValueError):
        d.DigestIndex(spark, f"file://{tmp_path}/kept", 8)


def test_query_leaves_no_table(spark, sf):
    before = {t.name for t in spark.catalog.listTables()}
    assert d.query(spark, sf).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
