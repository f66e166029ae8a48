"""Toxicity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(score - threshold[k]): one weight vector serves all the ordered thresholds. Features are sparse:
the words of a text and the beginnings of its words, each worth log(1 + count). Weights are fitted with an L1 penalty
by accelerated proximal gradient steps, so neutral words weigh nothing and long texts gather no noise; as the penalty
also shrinks what it keeps, the score's scale and the thresholds are then fitted to a held-out quarter. The result is the
expected severity, the sum over k of P(grade > k), and the most probable grade.

Labels that only say toxic or not are graded first: 0 for clean; toxic texts get 1 or 2, by whether the words that a
two-grade fit finds telling occur in them more often than in the median toxic text. A label table with a column `grade`
is used as it is.

The model is fitted on SAMPLE labelled rows at most, chosen by a hash of doc_id; scoring covers every row and whole
texts. Null and empty texts have no features, and so the score of none. Rows with null doc_id are scored, not learned
from. Repeated labels count repeatedly. With no labels, or labels of one grade only, all texts get grade 0. Extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_sample, on_workers, stored
from .wu_manber import words

#: Labelled rows to learn from, at most.
SAMPLE = 8_000
#: Features that enter the fit, at most: those whose shares among grades differ the most.
FEATURES = 30_000
BEGINNINGS = (3, 4, 5, 6, 7, 8)
PENALTY = 1e-3
STEPS = 900
#: Texts that a feature must occur in, and how far frequent features are scaled down before the fit.
LEAST = 8
SCALING = 0.35
#: Words whose weights a worker remembers; then it starts afresh.
WORDS_HELD = 150_000


def features(word: bytes) -> list[str]:
    """A word, and its beginnings that are shorter than it (marked, so as to differ from words)."""
    w = word.decode()
    return [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)]


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]
    held: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return (self.weights, self.thresholds)

    def __setstate__(self, state):
        self.weights, self.thresholds = state
        self.held = {}

    def score(self, text: str | None) -> float:
        """Features of a text are those of its words; a feature that several words share is worth log(1 + sum)."""
        own = Counter()
        held, weights = self.held, self.weights
        for w, n in Counter(words(text)).items():
            known = held.get(w)
            if known is None:
                known = [f for f in features(w) if f in weights]
                if len(held) >= WORDS_HELD:
                    held.clear()
                held[w] = known
            for f in known:
                own[f] += n
        return sum(weights[f] * log1p(n) for f, n in own.items())

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [float(_sigmoid(np.float64(score - t))) for t in self.thresholds]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int, grade: np.ndarray, grades: int):
    """Weights and increasing thresholds for the sparse matrix (rows, cols, vals). Thresholds are unpenalised; they are
    the first one and the logarithms of the steps between them."""
    n = len(grade)
    w = np.zeros(width)
    share = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(grades - 1)])
    theta = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(grades - 1))
    t = np.concatenate(([theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))))
    # features are scaled towards one size, so that rare telling ones are learned as fast as frequent ones
    scale = (np.bincount(cols, vals**2, width) / n + 1e-6) ** -SCALING
    vals = vals * scale[cols]
    v = np.ones(width)
    for _ in range(12):  # the largest eigenvalue, for the step
        v = np.bincount(cols, vals * np.bincount(rows, vals * v[cols], n)[rows], width)
        size = np.sqrt((v**2).sum()) or 1.0
        v /= size
    rate = n / max(size, 1e-9)  # small enough, with thresholds moving too, not to end in a cycle
    yw, yt, momentum = w.copy(), t.copy(), 1.0
    for _ in range(STEPS):
        eta = np.bincount(rows, vals * yw[cols], n)
        gaps = np.exp(yt[1:])
        theta = yt[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        gw_eta, g_theta = _gradient(eta, theta, grade)
        gw = np.bincount(cols, vals * gw_eta[rows], width) / n
        g_t = np.concatenate(([g_theta.sum()], gaps * np.cumsum(g_theta[::-1])[::-1][1:])) / n
        step = rate
        new_w = yw - step * gw
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * PENALTY, 0)
        new_t = yt - np.clip(g_t, -0.5, 0.5)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / after
        if ((yw - new_w) * (new_w - w)).sum() > 0:  # restart where momentum goes uphill
            push, after = 0.0, 1.0
        yw, yt = new_w + push * (new_w - w), new_t + push * (new_t - t)
        w, t, momentum = new_w, new_t, after
    theta = t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))
    return w * scale, theta


def _gradient(eta: np.ndarray, theta: np.ndarray, grade: np.ndarray):
    """Of the negative log-likelihood by score and by threshold; P(grade = k) is a difference of neighbours' sigmoids."""
    edges = np.concatenate(([-np.inf], theta, [np.inf]))
    low, high = edges[grade], edges[grade + 1]
    with np.errstate(over="ignore"):
        a = np.where(np.isinf(low), 0.0, _sigmoid(np.where(np.isinf(low), 0, low) - eta))
        b = np.where(np.isinf(high), 1.0, _sigmoid(np.where(np.isinf(high), 0, high) - eta))
    p = np.maximum(b - a, 1e-12)
    da, db = a * (1 - a), b * (1 - b)
    g_eta = (db - da) / p
    g_theta = np.array([(da / p)[grade == k + 1].sum() - (db / p)[grade == k].sum() for k in range(len(theta))])
    return g_eta, g_theta


def gap(c1, c0, n1, n0):
    """How surely a feature in c1 of n1 toxic and c0 of n0 clean texts tells them apart (a z-score); 0 if too rare."""
    p = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    return np.where((c1 + c0 < LEAST) | (z < 2), 0.0, z)


def fit(texts: list[tuple[list[int], list[int]]], grade: np.ndarray, graded: bool, names: list[str]) -> Model:
    """texts: of each the numbers of its features (places in names) and their counts. graded: grade is severity as it
    is, else 0 or 1."""
    if len(texts) == 0 or grade.min() == grade.max():
        return Model({}, [50.0] * (max(1, int(grade.max(initial=1))) if graded else 2))
    rows = np.repeat(np.arange(len(texts)), [len(f) for f, _ in texts])
    cols = np.array([i for f, _ in texts for i in f], np.int64)
    vals = np.log1p(np.array([n for _, ns in texts for n in ns], np.float64))
    if not graded:
        w, _ = fit_ordinal(rows, cols, vals, len(names), (grade > 0).astype(int), 2)
        telling = np.bincount(rows, np.where(w[cols] > 0.05, np.expm1(vals), 0), len(grade))
        middle = np.median(telling[grade > 0])
        grade = np.where(grade > 0, 1 + (telling > middle), 0)
        if (grade == 2).sum() == 0:
            grade = np.minimum(grade, 1)
    grade = grade.astype(int)
    grades = int(grade.max()) + 1
    held = np.arange(len(grade)) % 4 == 3
    if min(np.bincount(grade[held], minlength=grades).min(), np.bincount(grade[~held], minlength=grades).min()) < LEAST:
        w, theta = fit_ordinal(rows, cols, vals, len(names), grade, grades)  # too few to hold any out
    else:
        place = np.cumsum(~held) - 1
        use = ~held[rows]
        w, theta = fit_ordinal(place[rows[use]], cols[use], vals[use], len(names), grade[~held], grades)
        scores = np.bincount(rows, vals * w[cols], len(grade))[held]
        scale, theta = calibrated(scores, grade[held], theta)
        w = w * scale
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-4)}, theta.tolist())


def calibrated(scores: np.ndarray, grade: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """The scale of scores, from 1 to 8 and the smaller of about equal ones, and the thresholds that suit them best."""
    best = None
    for scale in 1.25 ** np.arange(0, 10):
        t = theta * scale
        for _ in range(400):
            t = np.maximum.accumulate(t - np.clip(_gradient(scores * scale, t, grade)[1] * 8 / len(grade), -0.5, 0.5))
        edges = np.concatenate(([-np.inf], t, [np.inf]))
        low, high = (_sigmoid(np.clip(edges[grade + i] - scores * scale, -500, 500)) for i in (0, 1))
        loss = -np.log(np.maximum(high - low, 1e-12)).sum() + np.log(scale) ** 2
        if best is None or loss < best[0] - 0.1:
            best = (loss, float(scale), t)
    return best[1:]


def text_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words(text)).items():
        for f in features(w):
            out[f] += n
    return out


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id and `grade`, or `toxic` (0 or 1). The executors count and screen features; the driver holds
    FEATURES of them at most and their counts in `sample` texts."""
    spark = docs.sparkSession
    on_workers(spark)
    graded = "grade" in labels.columns
    known = labels.select(
        F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("grade" if graded else "toxic").cast("int").alias("grade"),
    ).where("doc_id is not null and grade is not null and grade >= 0")
    chosen = spark.createDataFrame([(r.doc_id, r.grade) for r in hash_sample(known, sample, labels.count())], "doc_id long, grade int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.select("doc_id", "grade", "text"), "labelled")
    n1, n0 = rows.agg(F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") == 0)).first()
    if not n1 or not n0:
        return fit([], np.zeros(0, int), graded, [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c: tuple[Counter, Counter] = (Counter(), Counter())
                for g, t in zip(b.column(0).slice(at, 500), b.column(1).slice(at, 500), strict=True):
                    c[g.as_py() > 0].update(text_features(t.as_py()).keys())
                for toxic in (0, 1):
                    names, ns = list(c[toxic]), list(c[toxic].values())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()), pa.array([n * toxic for n in ns], pa.int64()), pa.array([n * (1 - toxic) for n in ns], pa.int64())],
                        names=["feature", "c1", "c0"],
                    )

    counted = rows.select("grade", "text").mapInArrow(count, "feature string, c1 long, c0 long")
    c1, c0 = F.col("c1"), F.col("c0")
    p = (c1 + c0) / (n1 + n0)
    z = F.abs(c1 / n1 - c0 / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)  # as gap() has it
    telling = (
        counted.groupBy("feature").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
        .where(c1 + c0 >= LEAST).withColumn("z", z).where("z >= 2")
        .orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature")
    )
    names = sorted(r.feature for r in telling.toLocalIterator())
    ids = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids.value
        for b in batches:
            own = [{known[f]: n for f, n in text_features(t.as_py()).items() if f in known} for t in b.column(2)]
            own = [dict(sorted(c.items())) for c in own]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(c) for c in own], pa.list_(pa.int32())), pa.array([list(c.values()) for c in own], pa.list_(pa.int32()))],
                names=["doc_id", "grade", "ids", "counts"],
            )

    found = rows.mapInArrow(number, "doc_id long, grade int, ids array<int>, counts array<int>")
    # in an order that does not depend on how rows were read
    got = sorted((r.doc_id, r.grade, r.ids, r.counts) for r in found.toLocalIterator())
    return fit([(i, n) for *_, i, n in got], np.array([g for _, g, *_ in got], dtype=int), graded, names)


def fit_texts(texts: list[str], grade: np.ndarray, graded: bool) -> Model:
    """The same for texts at hand."""
    counts = [text_features(t) for t in texts]
    toxic = np.asarray(grade) > 0
    c: tuple[Counter, Counter] = (Counter(), Counter())
    for x, y in zip(counts, toxic, strict=True):
        c[int(y)].update(x.keys())
    every = sorted(set(c[0]) | set(c[1]))
    z = gap(*(np.array([k[f] for f in every], float) for k in (c[1], c[0])), max(toxic.sum(), 1), max((~toxic).sum(), 1))
    kept = sorted(every[i] for i in np.argsort(-z, kind="stable")[:FEATURES] if z[i] > 0)
    ids = {f: i for i, f in enumerate(kept)}
    rows = [dict(sorted((ids[f], n) for f, n in x.items() if f in ids)) for x in counts]
    return fit([(list(x), list(x.values())) for x in rows], np.asarray(grade), graded, kept)


SCORED = "doc_id long, severity double, grade int, p_toxic double"


def _columns(model: Model, texts) -> list[pa.Array]:
    severity, grades, toxic = [], [], []
    for t in texts:
        above = model.above(model.score(t.as_py()))
        mass = -np.diff([1.0, *above, 0.0])
        severity.append(sum(above))
        grades.append(int(np.argmax(mass)))
        toxic.append(above[0])
    return [pa.array(severity, pa.float64()), pa.array(grades, pa.int32()), pa.array(toxic, pa.float64())]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (most probable) and p_toxic (of a grade above 0) of every document."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *_columns(shared.value, b.column(1))], names=["doc_id", "severity", "grade", "p_toxic"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose probability of a grade above 0 is at most `limit`."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = _columns(shared.value, b.column(at))[2]
            yield b.filter(pa.array([not p > limit for p in toxic.to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: severity of all whole documents, learned from the labels table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", F.round("severity", 6).alias("severity"), "grade", F.round("p_toxic", 6).alias("p_toxic"),
        (F.col("p_toxic") > 0.5).alias("toxic"),
    )
