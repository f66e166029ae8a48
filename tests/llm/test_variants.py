import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lenscape.llm import anagram_variants as x


def near(a, b):
    """Exactly one edit, by trying all."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) == len(a):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=9), min_size=2, max_size=12, unique=True), st.integers(2, 5))
def test_groups_give_each_near_pair_once(words, block):
    groups = {}
    for n, w in enumerate(words):
        for k in x.keys(w, block):
            groups.setdefault(k[:2], []).append((*k, w, n))
    got = Counter((a, b) for g in groups.values() for a, b, _ in x.near_in_group(g, block))
    assert got == Counter((a, b) for a in words for b in words if a != b and near(a, b))


def test_groups_stay_small_among_anagrams():
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefghijkl", 12)) for _ in range(20_000)}
    groups = Counter(k[:2] for w in words for k in x.keys(w))
    assert max(groups.values()) <= 12


def brute(rows, least, twice, ratio, alter=True):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if alter and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= twice}
    forms, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(v, w)]
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = top if top and counts[top] >= ratio * n else None
        out[w] = len(others)
    rows = {}
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows[w] = (forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None)
    return rows


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    bases = ["wordwork", "Éléphant", "wordworks", "aaaaaaaa", "statement"]
    words = []
    for k, b in enumerate(bases):
        words += [b] * (300 >> k)
        for _ in range(40):
            i = rng.randrange(len(b))
            v = b[:i] + rng.choice(["", b[i] + "x", "q", "ÿ", b[i].upper()]) + b[i + 1 :]
            words += [v] * rng.choice((1, 2, 4, 25))
    rng.shuffle(words)
    rows = [(None if i == 3 else i // 2, " ".join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20 + 1)] + [(8, None), (9, ""), (9, "÷×÷×÷×÷ " * 3)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, word string")
    for alter in (True, False):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in x.variants(docs, alter).collect()}
        want = brute(rows, 7, 2, 10, alter)
        assert got == want and any(v[0] for v in want.values())
    assert x.variants(docs.limit(0)).collect() == []


def test_chains_of_forms(spark):
    chain = [("abcdefghij" + "k" * i, 10 ** (6 - i)) for i in range(7)]
    words = spark.createDataFrame(chain, "word string, n long")
    got = {r.word: (r.form, r.root) for r in x.roots(x.stored(x.forms(words), "forms")).collect()}
    assert got == {w: (chain[i - 1][0] if i else None, chain[0][0]) for i, (w, _) in enumerate(chain)}


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duck.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({x.SQL})").fetchall())
    got = sorted(tuple(r) for r in x.query(spark, sf).collect())
    assert got == want and len(got) > 100


@pytest.mark.parametrize("text", ["", "a", "12:abc", "7:élan"])
def test_crc_in_sql(text):
    crc = x._CRC.format(f"'{text}'")
    sql = f"WITH t0 AS (SELECT i, i AS c FROM range(256) r(i)),\n{x._STEPS}\ncrc AS (SELECT list(c ORDER BY i) AS tab FROM t8) SELECT {crc} FROM crc"
    assert duckdb.sql(sql).fetchall()[0][0] == zlib.crc32(text.encode())
