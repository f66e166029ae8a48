import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lenscape.llm import best_fit_packing as x


def sequences(counts, capacity):
    """All pieces, placed as the table of places says; checks that they fill sequences without gap or overlap."""
    plan = x.places(x.pack(counts, capacity))
    held = {}
    for n, k in counts.items():
        rows = [r for r in plan.tolist() if r[0] == n]
        for rank in range(k):
            _, first, each, sequence, offset = max((r for r in rows if r[1] <= rank), key=lambda r: r[1])
            deal, slot = divmod(rank - first, each)
            held.setdefault(sequence + deal, []).append((offset + slot * n, n))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert sum(map(len, held.values())) == sum(counts.values())
    return held


def best(sizes, capacity):
    """The least number of sequences, by trying all."""
    fewest = [len(sizes)]

    def put(i, gaps):
        if len(gaps) >= fewest[0]:
            return
        if i == len(sizes):
            fewest[0] = len(gaps)
            return
        for gap in {g for g in gaps if g >= sizes[i]}:
            rest = list(gaps)
            rest[rest.index(gap)] -= sizes[i]
            put(i + 1, rest)
        put(i + 1, [*gaps, capacity - sizes[i]])

    put(0, [])
    return fewest[0]


def least(sizes, capacity):
    """A lower bound of the number of sequences: pieces over capacity - k share with none of k or more."""
    out = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n > capacity - k for n in sizes)
        halves = [n for n in sizes if capacity - k >= n > capacity / 2]
        rest = sum(n for n in sizes if k <= n <= capacity / 2) - (len(halves) * capacity - sum(halves))
        out = max(out, alone + len(halves) + max(0, -(-rest // capacity)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_places_are_gapless(counts):
    held = sequences(counts, 64)
    if counts:
        total = sum(n * k for n, k in counts.items())
        fits = 64 // min(counts)
        assert -(-total // 64) <= len(held) <= sum(counts.values()) and all(len(p) <= fits for p in held.values())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_near_the_optimum(sizes):
    found = len(sequences(Counter(sizes), 24))
    fewest = best(sorted(sizes, reverse=True), 24)
    assert least(sizes, 24) <= fewest <= found <= fewest + 1
    if all(3 * n > 24 for n in sizes):
        assert found == fewest  # greedy matching of large pieces is exact


def test_patterns_do_not_grow_with_the_counts():
    rng = random.Random(3)
    few = {n: rng.randrange(1, 20) for n in range(1, 1025)}
    many = {n: k * 1_000_003 for n, k in few.items()}
    for counts in (few, many):
        patterns = x.pack(counts, 1024)
        total = sum(n * k for n, k in counts.items())
        assert len(patterns) < 4000 and len(x.places(patterns)) < 40_000
        assert sum(k for k, _ in patterns) <= 1.01 * total / 1024 + 2


@pytest.fixture(scope="module")
def files():
    return x.public_files()


def test_encoder_equals_the_library(files, spark, sf):
    encode = x.Encoder(*files)
    rng = random.Random(4)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", " ", "a<|endoftext|>b", "\n" * 5000, " " * 300_000, "x" + "\t " * 9999, "漢字 かな　ü", "it's I'LL we've", " \u0085  ", "\x00\x1f", "🙂" * 50]
    texts += ["".join(chr(rng.choice((rng.randrange(128), rng.randrange(0x250), rng.randrange(0xD800)))) for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert encode.ids(t).tolist() == encode.reference(t).tolist(), t[:80]


def check(got, texts, files, capacity):
    """Every piece of every text, and sequences without gaps."""
    encode = x.encoder(files).reference
    by_row = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for doc_id, text in texts:
        ids = [*encode(text or "").tolist(), 2]
        n = len(ids)
        first = n if n <= capacity else n % capacity or capacity
        for piece, start in enumerate([0, *range(first, n, capacity)]):
            part = ids[start : start + (capacity if piece else first)]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert by_row == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return held


def test_query_packs_all_documents(spark, sf, files):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = x.query(spark, sf).collect()
    held = check(got, texts, files, 1024)
    assert len(held) <= 1.01 * least([r.length for r in got], 1024)


def test_odd_rows_and_cores(spark, files):
    rng = random.Random(6)
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two", "c"), (4, "same", "d"), (4, "same", "d"), (5, "word " * 400, "e")]
    rows += [(10 + i, "w " * rng.randrange(60), "z") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, task string").withColumnRenamed("task", "sequence_id").repartition(7)
    got = x.packed(docs, files, capacity=64).collect()
    held = check(got, [(r[0], r[1]) for r in rows], files, 64)
    assert len(held) <= 1.01 * least([r.length for r in got], 64)
    assert x.packed(docs.limit(0), files).collect() == []
