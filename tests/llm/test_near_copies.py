"""Near copies of the pipeline's stage against all pairs, on planted and on sample rows."""

import itertools
import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from lenscape.llm import near_copies  # noqa: E402
from tests.llm.test_simhash import slow_fingerprint  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near(a, b):
    return len(a & b) / len(a | b) >= 0.8


def groups(texts):
    """texts by doc_id. Of each the smallest doc_id that links reach: by similarity, or by fingerprints within 3 bits."""
    own = {a: sets(t) for a, t in texts.items()}
    fps = {a: slow_fingerprint(t, 5) for a, t in texts.items()}
    holders = {}
    for a, s in own.items():
        for x in s:
            holders.setdefault(x, []).append(a)
    first = {a: a for a in own}

    def root(a):
        while first[a] != a:
            a = first[a]
        return a

    def link(a, b):
        low, high = sorted((root(a), root(b)))
        first[high] = low

    for a, s in own.items():
        for b in {b for x in s for b in holders[x] if b < a}:
            if near(s, own[b]):
                link(a, b)
    for a, b in itertools.combinations(own, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            link(a, b)
    return {a: root(a) for a in own}


def check(docs, folder):
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = groups(texts)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(docs.sparkSession, docs, folder).collect())
    assert kept == sorted(set(first.values()))
    assert len(kept) < len(texts)
    return set(kept)


def test_planted(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(120, 400))]
        copy = list(own)
        for at in rng.sample(range(len(own)), len(own) // 70):  # a changed word takes five shingles
            copy[at] = "changed"
        rows += [(i, " ".join(own)), (100 + i, " ".join(copy).upper()), (200 + i, " ".join(own[: len(own) // 2]))]
    rows += [(300, "  "), (301, None), (302, "a b"), (303, "A  b"), (304, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(3).write.parquet(str(tmp_path / "d"))
    kept = check(spark.read.parquet(str(tmp_path / "d")), "")
    assert kept == {*range(60), *range(200, 260), 300, 302, 304}


def test_first_of_a_band_is_no_copy(spark, tmp_path):
    """a ~ b and b ~ c alone: all are one component; without b, a and c stay."""
    w = [f"w{i}" for i in range(200)]
    a, b, c = (" ".join([*w[:150], *(f"{x}{i}" for i in range(n))]) for x, n in (("x", 0), ("y", 30), ("z", 60)))
    docs = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 3}


@pytest.mark.parametrize("left, right, sent", [(1 << 20, 1 << 22, 4096), (500, 1200, 0)])
def test_copies_of_one_source(spark, tmp_path, monkeypatch, left, right, sent):
    """Copies that each resemble their source, but hardly one another: no document of a band need be near the first of
    it. In blocks of any size all links are found."""
    monkeypatch.setattr(near_copies, "LEFT", left)
    monkeypatch.setattr(near_copies, "RIGHT", right)
    monkeypatch.setattr(near_copies, "SENT_SET", sent)
    rng = random.Random(9)
    rows = []
    for g in range(3):
        source = [f"g{g}w{rng.randrange(5000)}" for _ in range(160)]
        for i in range(40):
            copy = list(source)
            if i != 25:
                for at in rng.sample(range(len(copy)), rng.choice([3, 3, 3, 5, 8])):
                    copy[at] = f"other{rng.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    check(spark.read.parquet(str(tmp_path / "d")), "")


def test_sample_files(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), sf)
