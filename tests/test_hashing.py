import random

import pytest

from lenscape.operators import hashing


def near(rows, threshold):
    return {(a, b): bin((x ^ y) & (2**64 - 1)).count("1") for a, x in rows for b, y in rows if a < b and x is not None and y is not None and bin((x ^ y) & (2**64 - 1)).count("1") <= threshold}


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def made(bits, n, seed):
    """Clusters, copies, and many hashes that agree in their lower half."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(bits) for _ in range(4)]
    rows = []
    for i in range(n):
        v = rng.choice(bases)
        for b in rng.sample(range(bits), rng.randrange(0, bits // 3)):
            v ^= 1 << b
        if i % 3 == 0:
            v = (rng.getrandbits(bits - bits // 2) << (bits // 2)) | (bases[0] & ((1 << bits // 2) - 1))
        rows.append((i, signed(v) if bits == 64 else v))
    return [*rows, *((n + i, rows[3][1]) for i in range(6)), (n + 50, None)]


@pytest.mark.parametrize(("bits", "threshold"), [(64, 3), (64, 0), (62, 18), (40, 9), (12, 5), (64, 11)])
def test_pairs_and_classes_equal_brute_force(spark, monkeypatch, bits, threshold):
    monkeypatch.setattr(hashing, "TOGETHER", 20)
    monkeypatch.setattr(hashing, "HOT_VALUES", 10**6)
    rows = made(bits, 150, bits + threshold)
    df = spark.createDataFrame(rows, "id long, hash long")
    want = near(rows, threshold)
    got = hashing.close_pairs(df, threshold, bits).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want
    members, pairs = hashing.close_classes(df, threshold, bits)
    value = dict(rows)
    same = lambda i: [j for j in value if value[j] == value[i]]
    links = {i: sum(i in p for p in want) for i in value}
    assert {tuple(r) for r in members.collect()} == {(i, min(same(i)), len(same(i)), links[i]) for i in value if value[i] is not None}
    firsts = {min(same(i)) for i in value if value[i] is not None}
    assert {(r.a, r.b, r.distance) for r in pairs.collect()} == {(a, b, d) for (a, b), d in want.items() if d and a in firsts and b in firsts}


def test_bands_find_all_and_are_wide(spark):
    for bits in (62, 64, 40, 128 // 2):
        for threshold in range(0, 24):
            for total in (10, 10**4, 10**9):
                cut = hashing.bands(threshold, bits, total)
                assert all(width >= 10 for _, width, _ in cut)
                # hashes that differ by more than the radius in every band differ by more than the threshold
                assert sum(radius + 1 for _, _, radius in cut) > threshold or any(r == w for _, w, r in cut)
                assert sum(len(hashing._masks(w, r)) for _, w, r in cut) <= hashing.MOST_PROBES or threshold > 12


def test_no_hashes(spark):
    df = spark.createDataFrame([(1, None)], "id long, hash long")
    assert hashing.close_pairs(df, 3).collect() == []
    members, pairs = hashing.close_classes(df, 3)
    assert members.collect() == [] and pairs.collect() == []
    with pytest.raises(ValueError):
        hashing.close_hashes(df.select("hash"), 64)


@pytest.mark.parametrize("probe", [0, 10**9])
@pytest.mark.parametrize(("bits", "threshold"), [(64, 3), (62, 18)])
def test_bands_and_blocks_agree(spark, monkeypatch, probe, bits, threshold):
    """Either way, whatever is the least work; several blocks, and tiles that cut them."""
    monkeypatch.setattr(hashing, "PROBE", probe)
    monkeypatch.setattr(hashing, "BLOCK", 40)
    monkeypatch.setattr(hashing, "TILE", 300)
    rows = made(bits, 150, bits + threshold)
    df = spark.createDataFrame(rows, "id long, hash long")
    want = near(rows, threshold)
    got = hashing.close_pairs(df, threshold, bits).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want
    value = {i: v for i, v in rows if v is not None}
    apart = {tuple(sorted((value[a], value[b]))) for (a, b), d in want.items() if d}
    found = hashing.close_hashes(df.where("hash is not null").select("hash").distinct(), threshold, bits).collect()
    assert len(found) == len(apart) and {(r["hash"], r.hash2) for r in found} == apart


def test_wide_thresholds_compare_all_and_narrow_ones_look_up():
    """Bands of wide thresholds would be looked up by thousands of values for each hash."""
    least = lambda threshold, total: hashing._all_is_least(hashing.bands(threshold, 62, total), total)
    assert all(least(t, total) for t in (15, 16, 18) for total in (2_000, 10**5, 10**6))
    assert not least(3, 10**6) and not least(0, 10**6)


@pytest.mark.parametrize("rest", [0, 12, 1 << 18])
def test_components(spark, monkeypatch, rest):
    """A path whose numbers rise, one in random order, stars, a loop alone: by rounds, by the last step, and by both."""
    monkeypatch.setattr(hashing, "REST", rest)
    rng = random.Random(5)
    mixed = rng.sample(range(1000, 1040), 40)
    edges = [(i, i + 1) for i in range(60)] + list(zip(mixed, mixed[1:], strict=False)) + [(2000 + i, 2500) for i in range(30)] + [(3000, 3000), (2001, 2001)]
    got = {r.node: r.root for r in hashing.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(range(61), 0) | dict.fromkeys(range(1000, 1040), 1000) | dict.fromkeys([*range(2000, 2030), 2500], 2000) | {3000: 3000}
    assert got == want


def test_long_paths_take_few_jobs(spark, monkeypatch):
    """Labels that go from neighbour to neighbour took a round for each few of a path in random order."""
    calls = []
    kept = hashing.checkpointed
    monkeypatch.setattr(hashing, "checkpointed", lambda df: calls.append(1) or kept(df))
    names = random.Random(6).sample(range(10**6), 3000)
    got = hashing.connected(spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")).collect()
    assert len(got) == 3000 and {r.root for r in got} == {min(names)} and len(calls) == 2
