"""Perceptual hashes: Hamming distance, pairs within a threshold, groups of duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import checkpointed, find_package


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(embedding: Column, bits: int = 62) -> Column:
    """A stand-in hash of a vector: one bit for the sign of each of its first dimensions."""
    pieces = [F.when(F.get(embedding, F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(bits)]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.bitwiseOR(p)
    return out


def close_pairs(hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """a, b (a < b) and distance of all pairs of rows (id, hash) within a threshold.

    Where comparing all is the least work, rows meet in blocks. Else pairs of different hashes are those of close_hashes, and
    rows of equal hashes are joined to them at the end. The result holds all pairs: for groups of copies use close_classes or
    duplicate_groups."""
    points = checkpointed(hashes.where("hash is not null").select("id", "hash"))
    total = points.count()
    if threshold < bits and _all_is_least(bands(threshold, bits, total), total):
        return compared(points, total, threshold).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    met = close_hashes(points.select("hash").distinct(), threshold, bits)
    left = points.select(F.col("id").alias("x"), "hash")
    right = points.select(F.col("id").alias("y"), F.col("hash").alias("hash2"))
    apart = met.join(left, "hash").join(right, "hash2").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance"
    )
    equal = left.join(right.withColumnRenamed("hash2", "hash"), "hash").where("x < y")
    return apart.where("a <> b").unionByName(equal.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("distance")))


#: Bits of a band at least, so that a band's values are 2^10 keys or more; values that a hash is looked up by, at most.
LEAST_BITS = 10
MOST_PROBES = 50_000
#: Hashes of one value of a band that one task gets, about; and the share of all rows below which a value is not looked at.
TOGETHER, HOT_VALUES = 1_000, 2_000
#: What a looked-up value costs, in comparisons of two hashes.
PROBE = 300
#: Hashes of a block that is compared with others at most, and at least where there are fewer than FEW blocks; comparisons at once.
BLOCK, LEAST_BLOCK, FEW, TILE = 32_768, 1_000, 8, 1 << 18


def bands(threshold: int, bits: int, total: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of bands such that hashes within the threshold differ by at most the radius in one of
    them: with m bands and threshold = q * m + r, one of the first r + 1 within q or one of the others within q - 1. Of the
    numbers of bands whose widths are LEAST_BITS or more, the one with the least work for so many hashes."""
    best = None
    for m in range(1, max(1, bits // LEAST_BITS) + 1):
        edges = [bits * i // m for i in range(m + 1)]
        q, r = divmod(threshold, m)
        cut = [(lo, hi - lo, min(q if i <= r else q - 1, hi - lo)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
        cut = [c for c in cut if c[2] >= 0]
        probes = [sum(comb(width, k) for k in range(radius + 1)) for _, width, radius in cut]
        work = sum(p * (1 + total / 2**width) for p, (_, width, _) in zip(probes, cut, strict=True))
        if best is None or (sum(probes) > MOST_PROBES, work) < best[0]:
            best = (sum(probes) > MOST_PROBES, work), cut
    return best[1]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in at) for k in range(radius + 1) for at in combinations(range(width), k)]


def _all_is_least(cut: list[tuple[int, int, int]], total: int) -> bool:
    """Whether comparing all of so many hashes is less work than looking them up by these bands."""
    looked_up = sum(sum(comb(width, k) for k in range(radius + 1)) * (1 + total / 2**width) for _, width, radius in cut)
    return total / 2 <= PROBE * looked_up


def compared(rows: DataFrame, total: int, threshold: int) -> DataFrame:
    """a, b and distance of every two of so many rows (id, hash) within a threshold, once and in either order. Rows are dealt
    to blocks and every two blocks meet in a group, which holds their hashes and hands out pairs as it finds them."""
    spark = rows.sparkSession
    find_package(spark)
    blocks = max(1, -(-total // BLOCK), min(FEW, -(-total // LEAST_BLOCK)))
    groups = blocks * (blocks + 1) // 2
    block, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.col("other")
    sent = rows.select("id", "hash", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = sent.select("id", "hash", (other >= F.col("block")).alias("left"), F.least("other", "block").alias("i"), F.greatest("other", "block").alias("j"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own = [], False
        for b in batches:
            parts.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash", "left")])
            own = b.column("i")[0] == b.column("j")[0]
        ids, hashes, left = (np.concatenate(c) for c in zip(*parts, strict=True))
        hashes = hashes.view(np.uint64)
        a, x = ids[left], hashes[left]
        b, y = (a, x) if own else (ids[~left], hashes[~left])
        step = max(1, TILE // max(1, len(y)))
        for at in range(0, len(x), step):
            skip = at if own else 0
            d = np.bitwise_count(x[at : at + step, None] ^ y[skip:])
            found = np.flatnonzero(d <= threshold)
            row, column = np.divmod(found, len(y) - skip) if len(found) else (found, found)
            if own:  # each pair once, and none with itself
                later = column > row
                found, row, column = found[later], row[later], column[later]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(a[at + row]), pa.array(b[skip + column]), pa.array(d.ravel()[found].astype(np.int32))], names=["a", "b", "distance"])

    tasks = min(groups, max(4 * spark.sparkContext.defaultParallelism, groups // 16))
    return sent.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(meet, "a long, b long, distance int")


def close_hashes(distinct: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """hash, hash2 (hash < hash2) and distance of different hashes within a threshold. Where comparing all of them is the least
    work, as beyond about a quarter of the bits, they meet in blocks (`compared`).

    A hash is filed under its values in some bands, and looked up under all values near its own there (see `bands`); values
    that very many hashes share are filed in parts. A pair is reported by the first band that finds it."""
    if threshold >= bits:
        raise ValueError("all hashes are within that threshold")
    spark = distinct.sparkSession
    distinct = checkpointed(distinct)
    total = distinct.count()
    cut = bands(threshold, bits, total)
    if _all_is_least(cut, total):
        return compared(distinct.select(F.col("hash").alias("id"), "hash"), total, threshold).select(
            F.least("a", "b").alias("hash"), F.greatest("a", "b").alias("hash2"), "distance"
        )
    value = lambda c, lo, width: F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    filed = distinct.select(
        F.col("hash").alias("hash2"), F.inline(F.array(*(F.struct(F.lit(i).alias("band"), value(F.col("hash"), lo, width).alias("value")) for i, (lo, width, _) in enumerate(cut))))
    )
    counts = filed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > F.greatest(F.lit(TOGETHER), F.lit(total * len(cut) // HOT_VALUES))
    )
    hot = F.broadcast(checkpointed(counts.select("band", "value", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts"))))  # HOT_VALUES rows at most
    one = F.coalesce("parts", F.lit(1))
    filed = filed.join(hot, ["band", "value"], "left").select("hash2", "band", "value", F.pmod(F.xxhash64("hash2"), one).cast("int").alias("part"))
    masks = spark.createDataFrame([(i, m) for i, (_, width, radius) in enumerate(cut) for m in _masks(width, radius)], "band int, mask long")
    own = distinct.select("hash", F.inline(F.array(*(F.struct(F.lit(i).alias("band"), value(F.col("hash"), lo, width).alias("v")) for i, (lo, width, _) in enumerate(cut)))))
    probes = own.join(F.broadcast(masks), "band").select("hash", "band", F.col("v").bitwiseXOR(F.col("mask")).alias("value"))  # MOST_PROBES masks
    probes = probes.join(hot, ["band", "value"], "left").select("hash", "band", "value", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    apart = hamming(F.col("hash"), F.col("hash2"))
    met = probes.join(filed.hint("merge"), ["band", "value", "part"]).where((F.col("hash") < F.col("hash2")) & (apart <= threshold))
    first = F.lit(len(cut))
    for i, (lo, width, radius) in reversed(list(enumerate(cut))):
        first = F.when(F.bit_count(value(F.col("hash").bitwiseXOR(F.col("hash2")), lo, width)) <= radius, i).otherwise(first)
    return met.where(F.col("band") == first).select("hash", "hash2", apart.alias("distance"))


def close_classes(hashes: DataFrame, threshold: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Near rows without a pair for every two of them. Members: id, representative (the smallest id of its hash), copies
    (rows of that hash) and links (other rows within the threshold, copies among them). Pairs: a, b (a < b) and distance of
    representatives of different hashes within the threshold. Rows without a hash have no class."""
    points = checkpointed(hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies")))
    met = checkpointed(close_hashes(points.select("hash"), threshold, bits))
    x = points.select("hash", F.col("representative").alias("x"), F.col("copies").alias("n"))
    y = points.select(F.col("hash").alias("hash2"), F.col("representative").alias("y"), F.col("copies").alias("n2"))
    both = checkpointed(met.join(x, "hash").join(y, "hash2"))
    ends = both.select("hash", F.col("n2").alias("others")).unionByName(both.select(F.col("hash2").alias("hash"), F.col("n").alias("others")))
    others = ends.groupBy("hash").agg(F.sum("others").alias("others"))
    counted = points.join(others, "hash", "left").select(
        "hash", "representative", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    )
    pairs = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    return hashes.where("hash is not null").join(counted, "hash").select("id", "representative", "copies", "links"), pairs


def duplicate_groups(hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """id and group_id (the smallest id that links of close pairs reach) of rows that have a partner. Equal hashes are one
    point, so a group of copies makes no pairs."""
    points = hashes.where("hash is not null").groupBy("hash").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    links = close_hashes(points.select("hash"), threshold, bits).select(F.col("hash").alias("a"), F.col("hash2").alias("b"))
    roots = connected(links).select(F.col("node").alias("hash"), "root")
    named = points.join(roots, "hash", "left").withColumn("root", F.coalesce("root", "hash"))
    least = named.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("copies").alias("size")).where("size > 1")
    return hashes.join(named.select("hash", "root").join(least, "root"), "hash").select("id", "group_id")


#: Links that one task contracts at most, when rounds have left so few.
REST = 1 << 18


def merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The labels of nodes 0, 1, ... (each the number of its group's smallest node) after links between u and v."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        label[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(label, label[label]):
            label = label[label]


def connected(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component), by contraction: in a round each node moves to the one with the least
    hash among itself and its neighbours, and links are named by where their ends went. About half of the nodes or more go in
    a round, however long paths are; the last REST links are contracted at once. Then names are carried back. State is
    checkpointed where the session says."""
    find_package(edges.sparkSession)
    links = checkpointed(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct())  # edges are computed once
    both, moves = links.where("a <> b"), []

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy() for c in b.columns] for b in batches]
        if ends:
            a, b = (np.concatenate(c) for c in zip(*ends, strict=True))
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = merged(np.arange(len(names)), at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["node", "to"])

    while both.count() > REST:
        rank = lambda c, n=len(moves): F.struct(F.xxhash64(c, F.lit(n)).alias("hash"), F.col(c).alias("at"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", rank("a"))["at"].alias("to"))
        moves.append(checkpointed(least))
        ends = both.join(moves[-1].toDF("a", "a2"), "a").join(moves[-1].toDF("b", "b2"), "b").where("a2 <> b2")
        both = checkpointed(ends.select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct())
    named = both.select(F.col("a").cast("long"), F.col("b").cast("long")).repartition(1).mapInArrow(contract, "node long, to long")
    for moved in reversed(moves):
        named = moved.join(named.toDF("to", "last"), "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    named = checkpointed(named)
    least = named.groupBy("to").agg(F.min("node").alias("root"))
    alone = links.where("a = b").select(F.col("a").alias("node")).join(named, "node", "left_anti")
    return named.join(least, "to").select("node", "root").unionByName(alone.select("node", F.col("node").alias("root")))
