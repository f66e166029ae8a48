import itertools
import random
import zlib

import numpy as np
import pytest

from lenscape.llm import langid_crf as x


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    k, lengths = 3, np.array([3, 1, 4, 1, 2])
    e, a, s = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    mass, pairs, starts, log_z = x.posteriors(e, lengths, a, s)
    want, want_pairs, want_starts, want_z, at = np.zeros_like(mass), np.zeros((k, k)), np.zeros(k), 0.0, 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        w = np.array([np.exp(s[p[0]] + sum(e[at + i, y] for i, y in enumerate(p)) + sum(a[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        want_z += np.log(w.sum())
        for p, v in zip(paths, w / w.sum()):
            want_starts[p[0]] += v
            for i, y in enumerate(p):
                want[at + i, y] += v
            for i in range(n - 1):
                want_pairs[p[i], p[i + 1]] += v
        at += n
    assert np.allclose(mass, want) and np.allclose(pairs, want_pairs) and np.allclose(starts, want_starts)
    assert log_z == pytest.approx(want_z)


LANGS = {"aa": ["ka", "ko", "mi", "ta"], "bb": ["ster", "ing", "ough", "ble"], "cc": ["ção", "éu", "rr", "nh"]}


def text(lang, rng, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, text(lang := rng.choice(list(LANGS)), rng, rng.randint(1, 60)), lang) for i in range(n)]


def test_held_out_accuracy_and_code_switching():
    rows = corpus(300, 1)
    model = x.fit([(t, lang) for _, t, lang in rows])
    held = corpus(200, 2)
    got = list(x.predict(model, [t for _, t, _ in held]))
    assert sum(p[0] == lang for p, (*_, lang) in zip(got, held)) >= 195
    rng = random.Random(5)
    mixed = text("aa", rng, 30) + ". " + text("cc", rng, 10)
    lang, score, words = next(x.predict(model, [mixed]))
    assert lang == "aa" and 0.6 < score < 0.9 and abs(words[2] - 10) <= 2


def test_edges(monkeypatch):
    model = x.fit([(t, lang) for _, t, lang in corpus(60, 3)])
    texts = [None, "", " .\n", "123 456", "²", "kako", "kako " * 50000]
    want = [p[:2] for p in x.predict(model, texts)]
    assert want[:5] == [("und", 0.0)] * 5 and want[5][0] == want[6][0] == "aa"
    monkeypatch.setattr(x, "WORDS_HELD", 2)
    monkeypatch.setattr(x, "CHUNK", 3)
    again = [p[:2] for p in x.predict(model, texts + [t for _, t, _ in corpus(20, 4)])]
    assert [a[0] for a in again[:7]] == [w[0] for w in want]
    assert [a[1] for a in again[:7]] == pytest.approx([w[1] for w in want])


def test_tables(spark):
    rows = corpus(200, 6) + [(500, None, "aa"), (501, "x1", None), (None, "kakomi", "aa"), (3, "again", "bb")]
    docs = spark.createDataFrame([(a, b, c, 1.0) for a, b, c in rows], "doc_id long, text string, lang string, score double")
    model = x.trained(docs.where(~x.held_out(docs.doc_id)))
    got = x.predicted(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"aa", "bb", "cc", "und"}
    assert all(0 <= r.score <= 1 for r in got)
    flags = docs.select("doc_id", x.held_out(docs.doc_id).alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in flags)
    none = x.trained(docs.limit(0))
    assert [r.lang_pred for r in x.predicted(docs, none).limit(2).collect()] == ["und", "und"]
    assert x.predicted(docs.limit(0), model).count() == 0


def test_sample_files(spark, sf):
    got = x.query(spark, sf).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(true) and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)
