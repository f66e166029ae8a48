import numpy as np
import pytest

from lenscape.operators import density


def brute(rows, eps, least):
    ids, v = [i for i, _ in rows], np.array([p for _, p in rows], np.float32).astype(float)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    near = d <= eps
    core = near.sum(axis=1) >= least
    label = {i: i for k, i in enumerate(ids) if core[k]}
    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(core):
            low = min(label[ids[b]] for b in np.flatnonzero(near[a] & core))
            changed |= low < label[ids[a]]
            label[ids[a]] = low
    out = {}
    first = {tuple(p): min(i for i, q in zip(ids, v, strict=True) if tuple(q) == tuple(p)) for p in v}
    for k, i in enumerate(ids):
        reach = [(d[k, b], first[tuple(v[b])]) for b in np.flatnonzero(near[k] & core)]
        out[i] = (bool(core[k]), label[i] if core[k] else label[min(reach)[1]] if reach else None)
    return out


@pytest.mark.parametrize(("block", "cells"), [(2000, None), (25, 9), (7, 2)])
def test_equals_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(density, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(5, 3)) * 2
    points = np.concatenate([centres[rng.integers(0, 5, 220)] + rng.normal(scale=0.25, size=(220, 3)), rng.uniform(-4, 4, size=(60, 3)), np.tile(centres[0], (40, 1))])
    rows = [(int(i), [float(np.float32(x)) for x in p]) for i, p in zip(rng.permutation(len(points)), points, strict=True)]
    df = spark.createDataFrame([*rows, (9001, None), (None, rows[0][1]), (9002, [1.0])], "photo_id long, embedding array<float>").repartition(5)
    want = brute(rows, 0.4, 5)
    got = {r.photo_id: (r.core, r.cluster) for r in density.clusters(df, 0.4, 5, cells).collect()}
    assert got == want and len({c for _, c in want.values()}) > 4 and any(not k and c is not None for k, c in want.values())


def test_small_tables(spark):
    none = spark.createDataFrame([], "photo_id long, embedding array<float>")
    assert density.clusters(none, 1.0, 2).collect() == []
    one = spark.createDataFrame([(4, [1.0, 2.0])], "photo_id long, embedding array<float>")
    assert [tuple(r) for r in density.clusters(one, 1.0, 2).collect()] == [(4, False, None)]
    assert [tuple(r) for r in density.clusters(one, 1.0, 1).collect()] == [(4, True, 4)]


@pytest.mark.parametrize("cells", [None, 30])
def test_wide_eps_sends_each_point_in_bounded_batches(spark, monkeypatch, cells):
    """An eps that all cells are within: a worker made a copy of each vector for each cell at once, and without a number of cells
    given no cells are worth making."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]
    monkeypatch.setattr(density, "BLOCK", 70)
    df = spark.createDataFrame(rows, "photo_id long, embedding array<float>").repartition(1)
    sent = []
    kept = density._in_blocks
    monkeypatch.setattr(density, "_in_blocks", lambda *a: sent.append(a[1]) or kept(*a))
    got = {r.photo_id: (r.core, r.cluster) for r in density.clusters(df, 0.75, 4, cells).collect()}
    assert got == brute(rows, 0.75, 4)
    assert len(sent[0]) == (1 if cells is None else 30)
    monkeypatch.setattr(density, "SENT", 100)
    made = spark.createDataFrame(rows, "point long, embedding array<float>").selectExpr("*", "1L AS n").repartition(1)
    assert density._sent(made, 16, points[:30], 2.0).count() == 400 * 30


@pytest.mark.parametrize("shift", [0.0, 1000.0, 1e30])
def test_near_pairs_are_those_of_double_precision(monkeypatch, shift):
    monkeypatch.setattr(density, "TILE", 500)
    monkeypatch.setattr(density, "AGAIN", 50)
    rng = np.random.default_rng(4)
    a, b = ((rng.integers(-4, 5, size=(n, 8)) / 4 + shift).astype(np.float32).astype(float) for n in (90, 110))  # many at exactly eps
    d = np.sqrt(((b[None] - a[:, None]) ** 2).sum(axis=2))
    for eps in (2.0, 1.5, float(np.sort(d.ravel())[300])):
        got = [(int(i), int(j)) for x, y in density.near_pairs(a, b, eps) for i, j in zip(x, y, strict=True)]
        assert len(got) == len(set(got)) and set(got) == set(zip(*(c.tolist() for c in np.nonzero(d <= eps)), strict=True))
