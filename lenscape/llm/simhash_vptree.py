"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits, one vote of each word shingle's XXH64. Two fingerprints link if they differ in at most
`radius` bits. Then at least one of their 32-bit halves differs in at most radius // 2 bits, so each half has a tree
of its own, searched with that smaller radius, in which triangle bounds prune far better.

A tree splits points at a distance `cut` from a vantage point: inner ones are nearer than `cut`. Two points within r of
each other that a split parts have distances in [cut - r, cut) and [cut, cut + r), so it is enough that outer points
nearer than cut + r also visit the inner branch: each pair then shares a leaf. The upper tree is fitted on a bounded
sample of fingerprints and its leaves are the shards; every fingerprint is dealt to its shard and to those its ball
overlaps. A shard that came out far larger than others is cut into blocks, whose pairs are tasks of their own. Each task
grows its own tree in memory and compares within leaves. A shard reports a spanning forest of its
links, not all pairs, and distributed rounds of contraction join the forests to components.

Null texts count as empty. A very long text is hashed whole, its votes counted some shingles at a time. A text without
words has fingerprint zero and links like any other. A text of fewer words
than a shingle is one shingle. Equal fingerprints are one point, so groups of copies cost nothing. Repeated rows give
repeated results. Rows with null doc_id count as larger than all others. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, hash_sample, join_to_groups, on_workers, stored, with_row

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints that a shard should hold, about; the shards of a small input; and the sampled fingerprints that fit the
#: upper tree: so many for each shard, and at most.
SHARD = 2_000_000
SHARDS = 64
SAMPLED = 256
SAMPLE = 1_048_576
#: A shard of more than so many times the mean, and this number of points, is compared in blocks of half that size.
UNEVEN = 4
BLOCKED = 65_536
#: Points that are compared with one another without a further split, and at one time with how many others.
LEAF = 1_024
WIDE = 8_192
#: Shingles whose votes are counted at one time.
VOTES = 65_536


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    parts = shingles(text, size)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(p, SEED) for p in parts], dtype="<u8")) if parts else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, some hashes at a time."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES):
        h = hashes[at : at + VOTES].astype("<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, row: str | None = None) -> DataFrame:
    """doc_id, row (tells repeated rows apart; the column `row` of docs if there is one) and fp (the 64 bits as a long)."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(2)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), with_row(docs, row), "text")
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(keys: np.ndarray, radius: int) -> tuple[int, int] | None:
    """A vantage point among keys and the cut that leaves the fewest pairs to compare; None if nothing parts them."""
    best, size = None, len(keys)
    sample = keys if size <= 4096 else keys[:: size // 4096 + 1]
    for vantage in sample[:: max(1, len(sample) // 5)][:5].tolist():
        n = np.bincount(distance(sample, sample.dtype.type(vantage)), minlength=66 + radius)
        below = np.concatenate(([0], np.cumsum(n)))  # below[c]: points nearer than c
        cuts = np.arange(1, 65)
        outer = len(sample) - below[cuts]
        cost = below[cuts + radius].astype(float) ** 2 + outer.astype(float) ** 2
        cost[(below[cuts] == 0) | (outer == 0)] = np.inf
        at = int(cost.argmin())
        if cost[at] < 0.95 * len(sample) ** 2 and (best is None or cost[at] < best[0]):
            best = (cost[at], vantage, int(cuts[at]))
    return best and best[1:]


def grow(keys: np.ndarray, radius: int, leaf: int) -> list:
    """The upper tree as a list of nodes (vantage, cut, inner, outer), or leaf numbers: what `route` reads."""
    nodes: list = []
    leaves = 0
    todo = [(None, keys)]
    while todo:
        (parent, own) = todo.pop()
        cut = split(own, radius) if len(own) > 2 * leaf else None
        if parent is not None:
            nodes[parent[0]][parent[1]] = len(nodes)
        if cut is None:
            nodes.append([None, leaves, 0, 0])
            leaves += 1
            continue
        nodes.append([cut[0], cut[1], 0, 0])
        d = distance(own, own.dtype.type(cut[0]))
        here = len(nodes) - 1
        todo += [((here, 2), own[d < cut[1]]), ((here, 3), own[d >= cut[1]])]
    return nodes


def route(nodes: list, keys: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaf numbers with the places of the keys that go there: their own shard's and those that their ball overlaps."""
    todo = [(0, np.arange(len(keys)))]
    while todo:
        at, rows = todo.pop()
        vantage, cut, inner, outer = nodes[at]
        if vantage is None:
            yield cut, rows
            continue
        d = distance(keys[rows], keys.dtype.type(vantage))
        todo += [(inner, rows[d < cut + radius]), (outer, rows[d >= cut])]


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label after the links a-b: the smallest place of each component."""
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
    return label


def components(points: np.ndarray, half: int, radius: int) -> np.ndarray:
    """For each of the points (distinct fingerprints, unsigned) the place of the first one of its component, by a tree
    over their half. Points that agree in that half are told apart by a tree over all 64 bits."""
    label = np.arange(len(points))
    halves = ((points >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    todo = [(np.arange(len(points)), halves, radius // 2)]
    while todo:
        rows, keys, r = todo.pop()
        if len(rows) <= LEAF:
            _compare(points, rows, radius, label)
            continue
        own = keys[rows]
        cut = split(own, r)
        if cut is not None:
            d = distance(own, own.dtype.type(cut[0]))
            inner, outer = rows[d < cut[1] + r], rows[d >= cut[1]]
            if len(inner) < len(rows) and len(outer) < len(rows):
                todo += [(inner, keys, r), (outer, keys, r)]
                continue
        if keys is not points:
            todo.append((rows, points, radius))
        else:
            _compare(points, rows, radius, label)
    return label


def _compare(points: np.ndarray, rows: np.ndarray, radius: int, label: np.ndarray) -> None:
    """All pairs among rows, a block of LEAF by WIDE at a time; the links go into label."""
    own = points[rows]
    for at in range(0, len(rows), LEAF):
        block = own[at : at + LEAF]
        for to in range(at, len(rows), WIDE):
            a, b = np.nonzero(np.bitwise_count(block[:, None] ^ own[None, to : to + WIDE]) <= radius)
            a, b = a + at, b + to
            keep = a < b
            if keep.any():
                _roots(len(points), rows[a[keep]], rows[b[keep]], label)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that span the components of all links of `radius` bits."""
    spark = fps.sparkSession
    on_workers(spark)
    total = fps.count()
    shards = max(SHARDS, -(-total // SHARD))
    size = min(SAMPLE, SAMPLED * shards)
    sample = [r.fp for r in hash_sample(fps.select(F.xxhash64("fp").alias("h"), "fp"), size, total)]
    known = np.array(sample, dtype="<i8").view("<u8")
    parts = [((known >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for h in (0, 1)]
    trees = [grow(p, radius // 2, max(1, size // shards)) for p in parts]
    offset = sum(n[0] is None for n in trees[0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for h, tree in enumerate(trees):
                half = ((fp.view("<u8") >> np.uint64(32 * h)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for leaf, rows in route(tree, half, radius // 2):
                    if len(rows):
                        shard = np.full(len(rows), leaf + h * offset, dtype=np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[rows])], names=["shard", "fp"])

    def span(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(rows["fp"].to_numpy()).view("<u8")
        first = components(points, int(key[0] >= offset), radius)
        away = np.flatnonzero(first != np.arange(len(points)))
        return pd.DataFrame({"a": points[away].view("<i8"), "b": points[first[away]].view("<i8")})

    dealt = stored(fps.select("fp").mapInArrow(deal, "shard int, fp long"), "dealt")
    blocks = in_blocks(dealt, max(BLOCKED, UNEVEN * -(-total // shards)))
    return blocks.groupBy("shard", "i", "j").applyInPandas(span, "a long, b long")


def in_blocks(dealt: DataFrame, most: int) -> DataFrame:
    """shard, i, j, fp: a shard of at most `most` points as it is (i = j = 0). A larger one, which its tree could not part,
    is cut into blocks by a hash, and each pair of blocks (i < j) has both blocks' points: every two points meet, in tasks
    of about `most` points, and fingerprints go out as many times as there are blocks less one."""
    sizes = stored(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "uneven")
    # as many rows as there are shards at most
    known = dealt.join(F.broadcast(sizes), "shard", "left")
    blocks = F.ceil(F.col("n") * 2 / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    cut = known.select("shard", "fp", F.coalesce(blocks, F.lit(1)).alias("blocks"), F.coalesce(own, F.lit(0)).alias("own"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other or blocks = 1")
    return met.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (one node of its component, the same for all): rounds in which every node moves to the one of itself and
    its neighbours that a hash of the round puts first, and edges are contracted, until none is left. The hash is another
    in each round, so about half of the nodes go whatever their order, and a path of n nodes takes some log2(n) rounds.
    All state is in tables in the shared folder."""
    edges = stored(edges.where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        turn = F.lit(len(steps))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda node: F.struct(F.xxhash64(node, turn).alias("h"), F.col(node).alias("to"))  # noqa: B023, E731
        first = F.least(F.min(place("b")), F.first(place("a")))
        moves = stored(both.groupBy("a").agg(first.alias("first")).select(F.col("a").alias("node"), F.col("first.to").alias("root")), "moves")
        steps.append(moves)
        to = lambda end: moves.select(F.col("node").alias(end), F.col("root").alias(f"{end}2"))  # noqa: B023, E731
        moved = edges.join(to("a").hint("merge"), "a").join(to("b").hint("merge"), "b")
        edges = stored(
            moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(),
            "edges",
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for moves in steps[1:]:
        step = moves.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step.hint("merge"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored(out, "assigned")


def row_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows: a table with row and fp. row, to: links that span the components, between a row of each fingerprint and of
    another, and between the rows of one."""
    firsts = stored(rows.groupBy("fp").agg(F.min("row").alias("to"), F.count(F.lit(1)).alias("copies")), "points")
    named = lambda fp, row: firsts.select(F.col("fp").alias(fp), F.col("to").alias(row)).hint("merge")
    apart = stored(links(firsts, radius), "forest").join(named("a", "row"), "a").join(named("b", "to"), "b").select("row", "to")
    same = join_to_groups(rows.select("row", "fp"), firsts.where("copies > 1"), "fp", "copies", rows.count())
    return apart.unionByName(same.where("row <> to").select("row", "to"))


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows: a table with doc_id, row and fp. doc_id, row, fp, component_id (smallest doc_id that links reach) and first_row
    (the row of the component that has it; of repeated ones just one)."""
    points = stored(
        rows.groupBy("fp").agg(
            F.min("doc_id").alias("least"),
            F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("least_row"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "points",
    )
    roots = stored(connected(links(points, radius)), "roots")
    named = points.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = named.groupBy("root").agg(
        F.min("least").alias("component_id"),
        F.coalesce(F.min_by("least_row", "least"), F.min("least_row")).alias("first_row"),
        F.count(F.lit(1)).alias("members"),
    )
    placed = join_to_groups(
        named.select("root", "fp", "copies"), least, "root", "members", points.count()
    ).select("fp", "copies", "component_id", "first_row")
    return join_to_groups(rows, stored(placed, "placed"), "fp", "copies", rows.count()).select(
        "doc_id", "row", "fp", "component_id", "first_row"
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, row, fp (long), component_id and first (this row is its component's first_row)."""
    rows = stored(fingerprints(docs, size, row), "fingerprints")
    return grouped(rows, radius).withColumn("first", F.col("row") == F.col("first_row")).drop("first_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
