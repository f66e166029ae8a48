import random

import numpy as np
import pytest
import xxhash

from lenscape.llm import simhash_vptree as v


def slow_fingerprint(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def slow_components(rows):
    ids = list(rows)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(rows[a] ^ rows[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "a b c", "A\x0bb\x0cc\rd É é x", "x " * 300])
def test_fingerprint(text):
    assert v.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("half", [0, 1])
def test_trees_lose_no_link(half, monkeypatch):
    monkeypatch.setattr(v, "LEAF", 16)
    monkeypatch.setattr(v, "WIDE", 40)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([base, near, rng.integers(0, 2**32, 200, dtype=np.uint64)]))
    want = np.arange(len(points))
    masks = (points >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
    for a in range(len(points)):
        close = (np.bitwise_count(points ^ points[a]) <= 3) & (np.bitwise_count(masks ^ masks[a]) <= 1)
        for b in np.flatnonzero(close):
            x, y = sorted((want[a], want[b]))
            want[want == y] = x
    got = v.components(points, half, 3)
    # the tree may find more links than its own half promises, never fewer
    for a in range(len(points)):
        assert got[a] == got[want[a]]


def test_route_shares_leaves():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**32, 5000, dtype=np.uint32)
    tree = v.grow(keys[:2000], 1, 64)
    near = keys ^ (np.uint32(1) << rng.integers(0, 32, 5000, dtype=np.uint32))
    both = np.concatenate([keys, near])
    leaves = [set() for _ in both]
    for leaf, rows in v.route(tree, both, 1):
        for r in rows:
            leaves[r].add(leaf)
    assert all(leaves[i] & leaves[i + 5000] for i in range(5000))
    assert len({x for s in leaves for x in s}) > 8


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        rows.append((i, " ".join(text)))
        if i % 5 == 0 and text:
            text[rng.randrange(len(text))] = "changed"
            rows.append((1000 + i, " ".join(text)))
        if i % 7 == 0:
            rows.append((2000 + i, " ".join(text).upper()))
    rows += [(5000, None), (5001, ""), (5002, "  "), (None, "alone"), (7, dict(rows)[7])]
    # extra columns with names that the operator uses itself
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, root int")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in v.near_duplicates(docs).collect()]
    fps = {a: slow_fingerprint(b) for a, b in rows if a is not None}
    want = slow_components(dict(sorted(fps.items())))
    assert sorted(x for x in got if x[0] is not None) == sorted(
        (a, fps[a], want[a]) for a, _ in rows if a is not None
    )


def test_no_documents(spark):
    assert v.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_points_that_agree_in_a_half(monkeypatch):
    """A half cannot part them; the tree over all bits takes over, and blocks compare what that leaves."""
    monkeypatch.setattr(v, "LEAF", 8)
    monkeypatch.setattr(v, "WIDE", 20)
    rng = np.random.default_rng(9)
    points = np.unique(rng.integers(0, 2**32, 150, dtype=np.uint64) << np.uint64(32) | np.uint64(12345))
    near = points[:60] ^ (np.uint64(7) << np.uint64(40))
    points = np.unique(np.concatenate([points, near, points[:1] ^ (np.uint64(1) << np.arange(33, 60, dtype=np.uint64))]))
    got = v.components(points, 0, 3)
    want = slow_components({i: int(p) for i, p in enumerate(points)})
    assert got.tolist() == [want[i] for i in range(len(points))]


@pytest.mark.parametrize("shards", [1, 64, 500])
def test_links_whatever_the_shards(spark, monkeypatch, shards):
    monkeypatch.setattr(v, "SHARDS", shards)
    monkeypatch.setattr(v, "SAMPLED", 4)
    rng = np.random.default_rng(shards)
    base = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    flip = (np.int64(1) << rng.integers(0, 62, 400)) | (np.int64(1) << rng.integers(0, 62, 400))
    points = np.unique(np.concatenate([base, base ^ flip]))
    df = spark.createDataFrame([(int(p),) for p in points], "fp long")
    roots = {r.node: r.root for r in v.connected(v.links(df)).collect()}
    want = slow_components({int(p): int(p) % 2**64 for p in points})
    groups = {}
    for p, w in want.items():
        groups.setdefault(w, set()).add(p)
    for members in groups.values():
        assert len({roots.get(p, p) for p in members}) == 1
    assert len({roots.get(p, p) for p in want}) == len(groups)


def test_sample_files(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {a: slow_fingerprint(t) for a, t in sorted(texts.items())}
    want = slow_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in v.query(spark, sf).collect()}
    assert got == {a: (f"{fps[a]:016x}", want[a]) for a in texts}
    assert len(set(want.values())) < len(want)


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """A path whose nodes lie in the order of their numbers."""
    rounds = []
    own = v.stored
    monkeypatch.setattr(v, "stored", lambda df, name: rounds.append(name) or own(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in v.connected(edges).collect()}
    assert len(got) == 203 and len({got[i] for i in range(201)}) == 1 and got[1000] == got[1001] != got[0]
    assert rounds.count("moves") <= 12


def test_shards_that_nothing_parts(spark, monkeypatch):
    """Points that agree in one half cannot be parted by it: the shard is cut into blocks, and no link is lost."""
    monkeypatch.setattr(v, "BLOCKED", 40)
    monkeypatch.setattr(v, "UNEVEN", 1)
    monkeypatch.setattr(v, "SHARDS", 4)
    rng = random.Random(8)
    base = [rng.getrandbits(32) << 32 for _ in range(60)]
    points = sorted({b for b in base} | {b ^ (1 << rng.randrange(32, 63)) ^ (1 << rng.randrange(32, 63)) for b in base})
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in v.connected(v.links(fps)).collect()}
    want = slow_components(dict(zip(signed, points, strict=True)))
    pairs = [(a, b) for a in signed for b in signed]
    assert all((roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b]) for a, b in pairs)
    dealt = spark.createDataFrame([(1, x) for x in signed] + [(2, x) for x in signed[:10]], "shard int, fp long")
    sizes = {(r.shard, r.i, r.j): r["count"] for r in v.in_blocks(dealt, 40).groupBy("shard", "i", "j").count().collect()}
    assert sizes[2, 0, 0] == 10 and len(sizes) > 10 and max(sizes.values()) < 70
