import random

import numpy as np
import pytest

from lenscape.llm import toxicity as x


def loss(eta, theta, grade):
    edges = np.concatenate(([-1e9], theta, [1e9]))
    s = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    return -np.log(s(edges[grade + 1] - eta) - s(edges[grade] - eta)).sum()


def test_gradient():
    rng = np.random.default_rng(0)
    eta, theta, grade = rng.normal(size=40), np.array([-0.5, 0.4, 1.1]), rng.integers(0, 4, 40)
    g_eta, g_theta = x._gradient(eta, theta, grade)
    e = 1e-6
    for i in range(40):
        d = np.zeros(40)
        d[i] = e
        assert g_eta[i] == pytest.approx((loss(eta + d, theta, grade) - loss(eta - d, theta, grade)) / (2 * e), abs=1e-4)
    for k in range(3):
        d = np.zeros(3)
        d[k] = e
        assert g_theta[k] == pytest.approx((loss(eta, theta + d, grade) - loss(eta, theta - d, grade)) / (2 * e), abs=1e-4)


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.3
        for _ in range(rng.choice([1, 2, 8]) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["scum", "VILE!", "hatefulxyz", "hatefulabc"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_learns_and_orders():
    rows = corpus(1500, 1)
    model = x.fit_texts([t for _, t, _ in rows], np.array([y for *_, y in rows]), False)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    held = corpus(500, 2)
    right = sum((model.above(model.score(t))[0] > 0.5) == bool(y) for _, t, y in held)
    assert right >= 475
    one, many = model.score("w1 w2 scum"), model.score("w1 w2 " + "scum vile hatefulq " * 9)
    assert sum(model.above(many)) > sum(model.above(one)) > sum(model.above(model.score("w1 w2")))


def test_grades_of_ones_own():
    rng = random.Random(3)
    texts, grade = [], []
    for _ in range(900):
        g = rng.randrange(4)
        texts.append("calm " * 3 + "bad " * 3 * g)
        grade.append(g)
    model = x.fit_texts(texts, np.array(grade), True)
    severity = [sum(model.above(model.score("calm " + "bad " * 3 * g))) for g in range(4)]
    assert severity == sorted(severity) and len(model.thresholds) == 3


def test_pickled_model_scores_alike():
    import pickle

    model = x.Model({"scum": 2.0}, [1.0, 3.0])
    model.score("scum scum")
    assert pickle.loads(pickle.dumps(model)).score("Scum, scum") == model.score("scum scum")


def test_tables(spark):
    rows = corpus(400, 4)
    extra = [(None, "scum " * 9, 0), (900, None, 0), (901, "", 0), (902, "scum vile " * 20000, 0), (5, rows[5][1], 0)]
    docs = spark.createDataFrame([(a, t, 1.0) for a, t, _ in rows + extra], "doc_id long, text string, grade double")
    labels = spark.createDataFrame([(a, y, 7) for a, _, y in rows] + [(None, 1, 7), (3, None, 7)], "doc_id long, toxic int, text int")
    model = x.trained(docs, labels)
    got = x.scored(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert by[902].p_toxic > 0.9 and by[None].p_toxic > 0.9 and by[900].severity == by[901].severity < 0.5
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got)
    kept = x.without_toxic(docs, model)
    assert kept.schema == docs.schema
    # rows without an id have no score to look up; they are tested by what they are
    want = sorted(str(r.doc_id) for r in got if r.p_toxic <= 0.5)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    own = {a: y for a, _, y in rows}
    texts = [(a, t) for a, t, _ in rows + extra if a in own]
    local = x.fit_texts([t for _, t in sorted(texts)], np.array([own[a] for a, _ in sorted(texts)]), False)
    assert local.weights.keys() == model.weights.keys() and local.thresholds == pytest.approx(model.thresholds, abs=1e-3)
    again = x.trained(docs.repartition(5), labels.repartition(3))
    assert again.thresholds == pytest.approx(model.thresholds, abs=1e-6)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = x.trained(docs, none)
    assert [r.grade for r in x.scored(docs, model).collect()] == [0]
    assert x.scored(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert x.scored(docs, x.trained(docs, one)).count() == 1


def test_scores_by_brute_force(spark):
    """Severity, grade and probability of whole texts from the weights, one feature after another."""
    import re

    rows = corpus(300, 7) + [(500, None, 0), (501, "", 0), (502, "ÉTÉ scum-VILE 3x " * 500, 0), (503, "scum\x00vile\u00a0scum", 0)]
    docs = spark.createDataFrame([(a, t) for a, t, _ in rows], "doc_id long, text string")
    model = x.trained(docs, spark.createDataFrame([(a, y) for a, _, y in rows], "doc_id long, toxic int"))
    assert len(model.weights) > 3
    sig = lambda v: 1 / (1 + np.exp(-v))
    texts = {a: t for a, t, _ in rows}
    for r in x.scored(docs, model).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        score = 0.0
        for feature, weight in model.weights.items():
            if feature.endswith("*"):
                n = sum(w.startswith(feature[:-1]) and len(w) > len(feature) - 1 for w in own)
            else:
                n = own.count(feature)
            score += weight * np.log1p(n)
        above = [sig(score - t) for t in model.thresholds]
        mass = [1 - above[0], above[0] - above[1], above[1]]
        assert r.severity == pytest.approx(sum(above), abs=1e-9) and r.p_toxic == pytest.approx(above[0], abs=1e-9)
        assert mass[r.grade] >= max(mass) - 1e-9


def test_fit_is_the_least_of_its_convex_loss():
    """No step away from the fitted weights, of one feature or of all, lowers the penalised loss by more than a trifle."""
    rng = np.random.default_rng(5)
    n, width = 200, 6
    full = rng.poisson(0.6, (n, width)).astype(float)
    hidden = full @ np.array([1.5, -1.0, 0.8, 0, 0, 0]) + rng.logistic(size=n)
    grade = (hidden > 0.5).astype(int) + (hidden > 2.0)
    rows, cols = np.nonzero(full)
    vals = full[rows, cols]
    w, theta = x.fit_ordinal(rows, cols, vals, width, grade, 3)
    scale = (np.bincount(cols, vals**2, width) / n + 1e-6) ** -x.SCALING
    objective = lambda w, t: loss(full @ w, t, grade) / n + x.PENALTY * np.abs(w / scale).sum()
    least = objective(w, theta)
    for size in (1e-2, 1e-1, 1.0):
        for i in range(width):
            for sign in (-1, 1):
                step = np.zeros(width)
                step[i] = sign * size
                assert objective(w + step, theta) >= least - 1e-5
        for _ in range(50):
            t = theta + size * rng.normal(size=2)
            if t[0] < t[1]:
                assert objective(w + size * rng.normal(size=width), t) >= least - 1e-5
