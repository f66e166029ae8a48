import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lenscape.llm import periodic_runs as x

EMPTY = hashlib.sha256(b"").hexdigest()


def brute(s, least, times):
    """Every period's maximal stretches; the smallest period of each stretch; those that are long enough."""
    found = {}
    for q in range(len(s), 0, -1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= 2 * q:
                found[i, j + q] = q
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, times * q))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_repetitions_equal_brute_force(s):
    assert x.repetitions(s) == brute(s, 0, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 6)), max_size=8), st.sampled_from([(24, 3), (6, 3), (4, 2), (10, 4)]))
def test_runs_equal_brute_force(parts, limits):
    s = [w for word, k in parts for w in word * k]
    assert x.runs_of(s, *limits) == brute(s, *limits)


def test_long_texts():
    rng = random.Random(5)
    for period in (1, 2, 7, 9000):
        word = [rng.randrange(50) for _ in range(period)]
        s = (word * (40_000 // period + 1))[:40_000]
        assert x.runs_of(s) == brute_of_known(s, period)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    assert x.runs_of(fib[-1][:2000]) == brute(fib[-1][:2000], 24, 3)


def brute_of_known(s, period):
    whole = [(0, len(s), period)] if len(s) >= 3 * period else []
    return whole if period > 2 else [(0, len(s), period if len(set(s[:period])) > 1 else 1)]


def test_places_stay_in_order():
    for places in (range(5000), reversed(range(5000)), random.Random(1).sample(range(100_000), 5000)):
        places = list(places)
        kept, seen = x.Places(places[0]), [places[0]]
        for p in places[1:]:
            before, after = kept.add(p)
            if len(seen) < 300:
                assert before == max((v for v in seen if v < p), default=None) and after == min((v for v in seen if v > p), default=None)
            seen.append(p)
        assert list(kept) == sorted(seen) and max(map(len, kept.chunks)) <= x.CHUNK


def test_prose_has_no_stretch():
    rng = random.Random(2)
    s = np.array([rng.randrange(300) for _ in range(20_000)])
    assert x.stretches(s) == []
    s[9000:9060] = np.tile(s[9000:9010], 6)
    (a, b), = x.stretches(s)
    assert a <= 9000 and 9060 <= b < 9100


def planted_by_contract(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def want(doc_id, text):
    words = planted_by_contract([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w], doc_id)
    runs = brute(words, 24, 3)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in x.query(spark, sf).collect()}
    assert got.keys() == texts.keys()
    small = [d for d in texts if len(texts[d] or "") < 4000]
    assert len(small) > 100 and any(got[d][0] for d in small)
    for d in small:
        assert got[d] == want(d, texts[d]), d


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y " * 20, "c"), (4, "x y " * 20, "d"), (4, "x y " * 20, "d"), (5, "   w\x0b" * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").withColumnRenamed("start", "n_runs")
    got = [tuple(r) for r in x.run_digests(docs).collect()]
    assert got[0] == (1, 0, None, None, None, None, EMPTY, EMPTY) and got[1][1:] == got[0][1:]
    assert got[2][:6] == (None, 1, 0, 40, 2, 20000) and got[3] == got[4] and got[3][1:] == got[2][1:]
    assert got[5][1] == 0
    assert x.run_digests(docs.limit(0)).collect() == []
    kept = x.without_repetition(docs).collect()
    assert [r.text for r in kept][:4] == [None, "", "x y", "x y"] and kept[0].n_runs == "a"
    assert sorted(tuple(r) for r in x.runs(docs).where("doc_id = 4").collect()) == [(4, 0, 40, 2, "x y")] * 2
