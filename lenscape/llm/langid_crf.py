"""Language identification by a linear-chain conditional random field over words.

A text's words are labelled with languages sentence by sentence, so code-switched text gets a label for every word:
a word's emission scores sum learned weights of its affixes, its character n-grams, its script and (if met often enough
in training) the word itself; transitions between the languages of neighbours are learned too. Forward-backward gives
each word's distribution. A document's language is the one with the largest sum over its words, its score that
sum's share.

Only text and lang of the training rows are learned from, SAMPLE documents at most (as many rows as there are languages
if those are more), an equal part of each language, chosen by hashes; every document is predicted from its whole text,
whose words are labelled some at a time, however long it is. Ties go to the language that sorts first. Null texts and texts without
a letter are `und` with score 0, as is everything if there is nothing to learn from. Words without a letter are no
words. Rows without an id are predicted, and count as held out. Repeated rows give repeated results. Extra columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import on_workers, stored

UNKNOWN = "und"
#: Documents to learn from, at most.
SAMPLE = 1_200
#: Characters of a text that are learned from, at most.
LEARNED_CHARS = 8_000
#: Texts of the sample that a feature must occur in, and a word for the lexicon.
LEAST = 2
LEXICON_LEAST = 3
STEPS = 30
PENALTY = 1e-6
#: Words whose features a worker remembers; then it starts afresh.
WORDS_HELD = 300_000
#: Words that are labelled at one time.
CHUNK = 400_000

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    w = word.lower()
    n = len(w)
    out = [f"={w}"]
    out += [f"<{w[:k]}" for k in (1, 2, 3) if k <= n]
    out += [f"{w[-k:]}>" for k in (1, 2, 3, 4) if k <= n]
    out += [w[i : i + 3] for i in range(n - 2)]
    out += [c for c in w if c > "\x7f"]
    return out


def tokens(text: str | None) -> list[str]:
    """Words, and the marks that end sentences."""
    return _TOKEN.findall(text) if text else []


@dataclass
class Model:
    languages: list[str]
    ids: dict[str, int]
    weights: np.ndarray  # of features by language
    transitions: np.ndarray
    start: np.ndarray
    held: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)  # emissions of the words held
    count: int = 0
    fresh: list = field(default_factory=list, repr=False)  # features of words whose emissions are not summed yet
    fresh_sizes: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.languages, self.ids, self.weights, self.transitions, self.start

    def __setstate__(self, state):
        self.languages, self.ids, self.weights, self.transitions, self.start = state
        self.held, self.scores, self.count, self.fresh, self.fresh_sizes = {}, None, 0, [], []

    def look_up(self, found: list[str]) -> np.ndarray:
        """Numbers of words' rows in emissions(): -1 ends a sentence, -2 is no word. They hold until the table of words
        is emptied, at the first call that finds it full."""
        held = self.held
        if len(held) >= WORDS_HELD:
            held.clear()
            self.count, self.fresh, self.fresh_sizes = 0, [], []
        for w in set(found).difference(held):
            if w in _ENDS:
                held[w] = -1
            elif not w.isalpha() and not any(map(str.isalpha, w)):
                held[w] = -2
            else:
                ids = self.ids
                own = [ids[f] for f in features(w) if f in ids]
                held[w] = self.count + len(self.fresh_sizes)
                self.fresh += own
                self.fresh_sizes.append(len(own))
        return np.fromiter(map(held.__getitem__, found), np.int64, len(found))

    def emissions(self) -> np.ndarray:
        """The sums of the weights of each held word's features."""
        n = len(self.fresh_sizes)
        if self.scores is None or self.count + n > len(self.scores):
            grown = np.zeros((max(1024, 2 * (self.count + n)), len(self.languages)))
            if self.count:
                grown[: self.count] = self.scores[: self.count]
            self.scores = grown
        if n:
            word = np.repeat(np.arange(n), self.fresh_sizes)
            own = self.weights[np.array(self.fresh, np.int64)] if self.fresh else np.zeros((0, len(self.languages)))
            for j in range(len(self.languages)):
                self.scores[self.count : self.count + n, j] = np.bincount(word, own[:, j], n)
            self.count += n
            self.fresh, self.fresh_sizes = [], []
        return self.scores


def sequences(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' ids without marks, and the lengths of the sentences, for ids in which -1 ends a sentence."""
    ids = ids[ids != -2]
    ends = np.flatnonzero(ids == -1)
    lengths = np.diff(np.concatenate(([-1], ends, [len(ids)]))) - 1
    return ids[ids >= 0], lengths[lengths > 0]


def posteriors(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Forward-backward on many sequences at once, the longest first, one place of all of them in a step. Gives each
    word's distribution, expected transitions, the sequences' first distributions' sum and the log-likelihood's
    normaliser."""
    k = emission.shape[1]
    n = len(lengths)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    longest = int(lengths[0]) if n else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    top = emission.max(axis=1, keepdims=True)
    e = np.exp(emission - top)
    a = np.exp(transitions - transitions.max())
    forward = np.empty_like(e)
    scale = np.empty(len(e))
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        now = e[at] * (np.exp(start - start.max()) if t == 0 else forward[at - 1] @ a)
        s = now.sum(axis=1)
        forward[at] = now / s[:, None]
        scale[at] = s
    backward = np.ones_like(e)
    pairs = np.zeros((k, k))
    for t in range(longest - 1, 0, -1):
        m = active[t]
        at = begin[:m] + t
        right = e[at] * backward[at] / scale[at][:, None]
        pairs += forward[at - 1].T @ right * a
        backward[at - 1] = right @ a.T
    mass = forward * backward
    mass /= mass.sum(axis=1, keepdims=True)
    log_z = np.log(scale).sum() + top.sum() + (lengths - 1).sum() * transitions.max() + n * start.max()
    return mass, pairs, mass[begin].sum(axis=0) if n else np.zeros(k), log_z


def fit(texts: list[tuple[str, str]]) -> Model:
    """texts: (text, language). A text's words are all taken to be of its language; what is learned of words that
    several languages share, and of neighbours, is for the field to find."""
    languages = sorted({lang for _, lang in texts})
    place = {x: i for i, x in enumerate(languages)}
    split = [tokens(t) for t, _ in texts]
    words: dict[str, int] = {}
    spread: Counter = Counter()
    met: Counter = Counter()
    for own in split:
        once = {w for w in own if w not in _ENDS and any(map(str.isalpha, w))}
        met.update(w.lower() for w in once)
        for w in once:
            words.setdefault(w, len(words))
    by_word = [features(w) for w in words]
    for fs in by_word:
        spread.update(set(fs))
    ids: dict[str, int] = {}
    rows, cols = [], []
    for i, fs in enumerate(by_word):
        for f in fs:
            if spread[f] >= LEAST if f[0] != "=" else met[f[1:]] >= LEXICON_LEAST:
                rows.append(i)
                cols.append(ids.setdefault(f, len(ids)))
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    seq, lens, gold = [], [], []
    for own, (_, lang) in zip(split, texts, strict=True):
        found = np.array([-1 if w in _ENDS else words.get(w, -2) for w in own], np.int64)
        s, n = sequences(found)
        seq.append(s)
        lens.append(n)
        gold.append(np.full(len(s), place[lang]))
    seq, lens, gold = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (seq, lens, gold))
    k = len(languages)
    model = Model(languages, ids, np.zeros((len(ids), k)), np.zeros((k, k)), np.zeros(k))
    if not len(seq):
        return model
    begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
    inner = np.ones(len(seq), bool)
    inner[begin] = False
    later = np.flatnonzero(inner)
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (gold[later - 1], gold[later]), 1)
    true_start = np.bincount(gold[begin], minlength=k)
    true_words = np.bincount(seq * k + gold, minlength=len(words) * k).reshape(-1, k).astype(float)
    params = [model.weights, model.transitions, model.start]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    spread_of = np.maximum(np.bincount(cols, minlength=len(ids)), 1)[:, None]
    for step in range(1, STEPS + 1):
        scores = np.stack([np.bincount(rows, model.weights[cols, j], len(words)) for j in range(k)], axis=1)
        mass, pairs, starts, _ = posteriors(scores[seq], lens, model.transitions, model.start)
        expected = np.stack([np.bincount(seq, mass[:, j], len(words)) for j in range(k)], axis=1)
        by_type = (true_words - expected) / len(seq)
        g = np.stack([np.bincount(cols, by_type[rows, j], len(ids)) for j in range(k)], axis=1)
        grads = [
            g - PENALTY * model.weights * np.minimum(spread_of, 100),
            (true_pairs - pairs) / len(seq) - 1e-3 * model.transitions,
            (true_start - starts) / len(lens) - 1e-3 * model.start,
        ]
        for p, g, m, v in zip(params, grads, first, second, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return model


def predict(model: Model, texts) -> Iterator[tuple[str, float, list[int]]]:
    """Language, score and number of words by language (most probable labels) of each text."""
    k = len(model.languages)
    pending: list[np.ndarray] = []
    total = 0

    def finish() -> Iterator[tuple[str, float, list[int]]]:
        parts = [sequences(p) for p in pending]
        seq = np.concatenate([s for s, _ in parts])
        lens = np.concatenate([n for _, n in parts])
        if len(seq):
            mass = posteriors(model.emissions()[seq], lens, model.transitions, model.start)[0]
        at = 0
        for s, _ in parts:
            if not len(s):
                yield UNKNOWN, 0.0, [0] * k
                continue
            own = mass[at : at + len(s)]
            at += len(s)
            share = own.mean(axis=0)
            best = int(share.argmax())
            yield model.languages[best], float(min(share[best], 1.0)), np.bincount(own.argmax(axis=1), minlength=k).tolist()

    for text in texts:
        if not k:
            yield UNKNOWN, 0.0, []
            continue
        if len(model.held) >= WORDS_HELD and pending:  # numbers hold until the table is emptied
            yield from finish()
            pending, total = [], 0
        pending.append(model.look_up(tokens(text)))
        total += len(pending[-1])
        if total >= CHUNK:
            yield from finish()
            pending, total = [], 0
    if pending:
        yield from finish()


def trained(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: the training rows, with doc_id, text and lang. Every language has an equal part of the sample, or all its rows
    if they are fewer, so that rare ones are learned too: those with the smallest hashes of doc_id and text, equal rows
    counting once. Of a text longer than LEARNED_CHARS a part of that length is learned from, at a place that the hash
    names."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select(
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"), "lang", "text"
    )
    sizes = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = max(sample // max(sizes.count(), 1), 1)
    # four times as many pass as are wanted, so that few rows are sorted
    bound = F.when(F.col("n") > 4 * each, -(2.0**63) + 2.0**64 * 4 * each / F.col("n")).otherwise(2.0**63)
    rows = known.join(F.broadcast(sizes.select("lang", bound.alias("bound"))), "lang").where(F.col("h").cast("double") <= F.col("bound"))
    start = F.when(F.length("text") > LEARNED_CHARS, F.pmod("h", F.length("text") - LEARNED_CHARS) + 1).otherwise(1)
    part = rows.select("h", "lang", F.col("text").substr(start.cast("int"), F.lit(LEARNED_CHARS)).alias("text")).dropDuplicates(["h", "lang"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = part.withColumn("rank", rank).where(F.col("rank") <= each)
    return fit(sorted(((r.text, r.lang) for r in chosen.toLocalIterator()), key=lambda x: (len(x[0]), x)))


PREDICTED = "doc_id long, lang_pred string, score double, words_by_lang array<long>"


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and words_by_lang (in the order of model.languages) of every document."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(predict(shared.value, (t.as_py() for t in b.column(1))))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.float64()),
                    pa.array([x[2] for x in out], pa.list_(pa.int64())),
                ],
                names=["doc_id", "lang_pred", "score", "words_by_lang"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PREDICTED)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: language of every whole document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 6).alias("score")
    )
