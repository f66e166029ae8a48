"""The pipeline against a brute-force version of every stage, on planted and on sample rows."""

import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from lenscape.llm import toxicity  # noqa: E402
from tests.llm.test_near_copies import groups  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    text = (text or "").translate(LOWER)
    return "".join(c if c.isascii() and c.isalnum() or c > "\x7f" else " " for c in text).split(" ")


def leaks(text, items):
    own = [w for w in word_list(text) if w]
    for item in items:
        w = [x for x in word_list(item) if x]
        size = min(10, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        if any(tuple(own[i : i + size]) in windows for i in range(len(own) - size + 1)):
            return True
    return False


def brute(rows, items, is_toxic):
    """rows: (doc_id, text), no doc_id twice."""
    rows = [r for r in rows if not is_toxic(r[1])]
    best = {}
    for a, t in rows:
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, -1), a)
    rows = [(a, t) for a, t in rows if best[(t or "").translate(LOWER)] == a]
    first = groups(dict(rows))
    rows = [(a, t) for a, t in rows if first[a] == a]
    return [(a, t) for a, t in rows if not leaks(t, items)]


def compare(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = brute(rows, items, lambda t: model.above(model.score(t))[0] > 0.5)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(
        (a, len(sp.encode(t or "", add_bos=True, add_eos=True))) for a, t in want
    )
    return rows, {r.doc_id for r in got}


def test_planted(spark, tmp_path):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        bad = i % 10 == 0
        size = 4000 if i == 2 else 60
        rows.append((i, make(size) + (" vile scum" * 4 if bad else "")))
        labels.append((i, 1, int(bad)))
    item = make(14)
    rows += [(1001, rows[1][1].upper()), (1002, rows[2][1] + " extra"), (1003, make(20) + " " + item + " " + make(20))]
    rows += [(1004, make(30) + " vile scum vile scum scum vile"), (1005, None), (1006, ""), (1007, make(9000))]
    # columns whose names operators use themselves
    extra = [(a, t, "en", "s", 0, 1, 2) for a, t in rows]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row long, fp int"
    spark.createDataFrame(extra, columns).coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    _, kept = compare(spark, str(tmp_path))
    assert 1001 in kept and 1 not in kept  # of copies the largest doc_id
    assert 2 in kept and 1002 not in kept  # of near copies the smallest
    assert not kept & {0, 10, 1003, 1004} and {3, 4, 1007} <= kept
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_rows_hold_when_the_number_of_cores_changes(spark, tmp_path):
    """The splits of files that are read again follow the cores; what a stage drops does not."""
    rng = random.Random(6)
    make = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    texts = [make(60) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t.upper()) for i, t in enumerate(texts[:40])]
    rows += [(2000 + i, t + " more") for i, t in enumerate(texts[40:80], 40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(a, t, "en", "s", 1) for a, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    want = {
        "toxicity": {a for a, _ in rows},
        "exact_dedup": {a for a, _ in rows} - set(range(40)),
        "near_dedup": set(range(120)),
        "decontamination": {a for a, _ in rows},
        "sentencepiece": {a for a, _ in rows},
    }
    try:
        spark.conf.set(names[1], "1")
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(names[0], "8")
            out = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
            spark.conf.set(names[0], "3")
            assert sorted(r.doc_id for r in out.collect()) == sorted(want[name]), name
    finally:
        for n in names:
            spark.conf.unset(n)


def test_sample_files(spark, sf):
    rows, kept = compare(spark, sf)
    assert 0 < len(kept) < len(rows)


def test_repeated_rows_and_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 1)] * 3 + [(None, "e f g h", "en", "s", 1)], schema)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert corpus_pipeline.drop_copies(spark, docs, "").count() == 2
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 2
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
