import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lenscape.llm import wu_manber as w

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow(text, items):
    own, hit, found = slow_words(text), set(), set()
    for i, item in items:
        b = slow_words(item)
        size = min(10, len(b))
        for at in range(len(b) - size + 1) if b else ():
            for p in range(len(own) - size + 1):
                if own[p : p + size] == b[at : at + size]:
                    hit |= set(range(p, p + size))
                    found.add(i)
    return len(own), len(hit), sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    assert [x.decode() for x in w.words(text)] == slow_words(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=5))
def test_search_against_brute_force(text, items):
    """Two words only, so windows overlap, repeat and share blocks."""
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    tables = w.matchers([(p, i) for i, x in items for p in w.windows(w.words(x))])
    spans, found = w.scan(w.words(" ".join(text)), tables)
    n, hit, want = slow(" ".join(text), items)
    assert (len(text), sum(b - a for a, b in spans), sorted(found)) == (n, hit, want)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(6)
    vocabulary = [f"wört{i}" for i in range(60)] + ["the", "of"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, make(25)), (2, make(10)), (3, "the of the"), (4, None), (5, "..."), (6, make(11)), (60, None), (7, "solo")]
    items.append((8, items[0][1]))  # an item that repeats another
    docs = [(i, make(rng.randint(0, 80))) for i in range(60)]
    docs += [(100, f"{make(5)} {items[0][1].upper()}! {make(5)}"), (101, items[5][1].replace(" ", "-- ")), (102, None), (103, ""), (104, "..,"), (105, "Solo"),
             (106, f"{make(20000)} {items[1][1]}"), (100, items[1][1]), (None, items[1][1])]
    return docs, items


def check(spark, planted, **kw):
    docs, items = planted
    df = spark.createDataFrame([(a, t, 1, "x") for a, t in docs], "doc_id long, text string, row int, items string").repartition(3)
    b = spark.createDataFrame([*items, (None, docs[0][1])], "item_id long, text string").repartition(2)
    got = [(str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in w.contamination(df, b, **kw).collect()]
    want = [(str(a), *slow(t, items)) for a, t in docs]
    assert sorted(got) == sorted(want)
    kept = w.without_contaminated(df, b, **kw)
    assert kept.schema == df.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(a for a, _, hit, _ in want if not hit)


def test_tables(spark, planted):
    check(spark, planted)


def test_many_passes_give_the_same(spark, planted):
    check(spark, planted, windows_a_pass=9)


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in w.contamination(docs, none).collect()] == [(2, 0)]
    assert w.contamination(docs.limit(0), none).count() == 0 and w.without_contaminated(docs, none).count() == 1


def test_digest(spark):
    df = spark.createDataFrame([([2, 10, 1],), ([],)], "items array<long>").select(w.digest_of("items"))
    assert [r[0] for r in df.collect()] == [hashlib.sha256(x).hexdigest() for x in (b"1,10,2", b"")]


def test_items_without_an_id_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pipeline = pytest.importorskip("corpus_pipeline")
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"a {item} b"), (2, f"{item} solo"), (3, "nothing"), (4, "solo"), (5, None)]
    items = [(None, item), (None, "only here"), (7, "solo"), (8, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = w.query(spark, str(tmp_path))
    want = con.execute(w.SQL)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(want.fetchall())
    assert {r.doc_id for r in got.where("contaminated").collect()} == {1, 2, 4}
    kept = pipeline.drop_leaks(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {3, 5}
    many = w.contamination(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")), windows_a_pass=1, nameless=True)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in many.collect()} == {1: (11, [None]), 2: (12, [7, None]), 3: (0, []), 4: (1, [7]), 5: (0, [])}


def test_passes_when_cores_change_between_them(spark, planted, tmp_path):
    """The rows of all passes are put together by stored numbers, not by numbers made anew for each reading."""
    docs, items = planted
    many = [(i * 1000 + int(a or 0), t) for i in range(40) for a, t in docs]
    spark.createDataFrame(many, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in w.contamination(df, b).collect())
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "8")
    found = w.contamination(df, b, windows_a_pass=len(items) * 2)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == want and len(want) == len(many)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
