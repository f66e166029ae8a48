import random

from lenscape.operators import timed


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_as_of_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(200)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(200)]), f"v{i}") for i in range(150)]
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "k string, t long, v string")
    for strict in (False, True):
        want = []
        for i, k, t in left:
            fits = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
            best = max(fits, key=lambda r: (r[1], r[2]), default=(None,) * 3)
            want.append((i, k, t, *best))
        for parts in (1, 7):
            assert rows_of(timed.as_of(a, b, "k", "t", strict=strict, parts=parts)) == sorted(want, key=repr), (strict, parts)
    none = timed.as_of(a, b.limit(0), "k", "t")
    assert none.count() == 400 and none.where("right_v IS NOT NULL").count() == 0 and timed.as_of(a.limit(0), b, "k", "t").count() == 0


def test_within_equals_brute_force(spark):
    rng = random.Random(9)
    points = [(i, rng.choice("aab"), rng.randrange(-500, 3000)) for i in range(200)] + [(900, None, 5), (901, "a", None)]
    spans = [(rng.choice("aab"), s := rng.randrange(-600, 3000), s + rng.choice((0, 1, 2, 3, 17, 64, 1000, 100_000)), j) for j in range(120)] + [("a", 5, None, 999), (None, 0, 9, 998)]
    p = spark.createDataFrame(points, "id long, k string, t long")
    i = spark.createDataFrame(spans, "k string, s long, e long, j long")
    got = sorted((r.id, r.j) for r in timed.within(p, i, "k", "t", "s", "e").collect())
    want = sorted((a, j) for a, k, t in points for k2, s, e, j in spans if k and k == k2 and t is not None and e is not None and s <= t < e)
    assert got == want
    assert timed.within(p, i.limit(0), "k", "t", "s", "e").count() == 0
