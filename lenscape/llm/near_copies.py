"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least `similarity`, or whose
SimHash fingerprints over the same shingles differ in at most `radius` bits.

Fingerprints are searched by the vantage-point trees of `simhash_vptree`, which find what is nearly equal. At a
similarity of 0.8 about ten of 64 bits differ, where triangle bounds prune nothing; so those pairs are found by bands of
MinHash signatures (BANDS bands of BAND values; a pair at 0.8 shares none with probability (1 - 0.8^5)^24 = 7e-5) and
confirmed on the sets of shingles of the whole texts.

Of the documents that share a band, each is first compared with its most central one (that shares most bands with most
documents), which joins a group of copies of one source at a cost in proportion to its size. Documents of a band that are
then still in different components are all compared with one another, in blocks, a pair in the first band that it shares.
So no link is lost; pairs never leave a task, links do.

Null texts count as empty; texts without words are alike. A text of fewer words than a shingle is one shingle. Very long
texts are hashed in pieces; a task holds the sets of shingles' hashes (8 bytes each) of two blocks, cut by bytes, and at
least that of one document. Rows with null doc_id count as larger than all others. Repeated rows are copies of one another. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HOT_KEYS, SENT_ROWS, join_to_groups, on_workers, stored, with_row
from .simhash_vptree import RADIUS, SEED, connected, majority, row_links, shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
BAND = 5
#: Shingles whose hashes are permuted at one time.
AT_ONCE = 1_024
#: Shingles (8 bytes each) in a block's sets on the side that is not yet joined, and on the other: so blocks are bounded by
#: bytes, whatever the documents' length. A document with more is in a block with few others.
LEFT, RIGHT = 1 << 20, 1 << 22
#: Sets of central documents that a worker remembers, and the largest (in shingles) that is broadcast.
SETS_HELD = 16
SENT_SET = 4_096

_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 2**64, BANDS * BAND, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**64, BANDS * BAND, dtype=np.uint64) | np.uint64(1)


def hashed(parts: list[bytes]) -> np.ndarray:
    """Hashes of shingles in order of place; that of the empty one for a text without words."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in parts or [b""]], dtype=np.uint64)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(BANDS * BAND, np.uint64(2**64 - 1))
    for at in range(0, len(own), AT_ONCE):
        np.minimum(least, ((own[at : at + AT_ONCE, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    parts = least.astype("<u8").reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], dtype="<u8")


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketched(docs: DataFrame, size: int = SHINGLE, row: str | None = None) -> DataFrame:
    """doc_id, row, fp (the SimHash fingerprint) and keys (of the bands) of every document."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = [], []
            for t in b.column(2):
                parts = shingles(t.as_py(), size)
                own = hashed(parts)
                fps.append(majority(own) if parts else 0)
                keys.append(bands(np.unique(own)))
            flat = np.concatenate(keys) if keys else np.zeros(0, "<u8")
            offsets = np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(fps, "<u8").view("<i8")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view("<i8")))],
                names=["doc_id", "row", "fp", "keys"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), with_row(docs, row), "text")
    return rows.mapInArrow(run, "doc_id long, row long, fp long, keys array<long>")


def _sets(docs: DataFrame, row: str, wanted: DataFrame, size: int) -> DataFrame:
    """row, set (the hashes of its different shingles, ascending) and n (their number) of the wanted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = [np.unique(hashed(shingles(t.as_py(), size))) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.astype("<u8").tobytes() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64())],
                    names=["row", "set", "n"],
                )

    few = wanted.count() <= SENT_ROWS
    rows = docs.select(F.col(row).alias("row"), "text").join(F.broadcast(wanted) if few else wanted.hint("merge"), "row", "left_semi")
    return stored(rows.mapInArrow(run, "row long, set binary, n long"), "sets")


def _central(members: DataFrame, total: int) -> DataFrame:
    """row, to: of each band's members all but the most central one, and that one."""
    weights = members.groupBy("row").agg(F.sum("n").alias("weight"))
    rank = F.struct("weight", (-F.col("row")).alias("last"))
    centres = members.join(weights.hint("merge"), "row").groupBy("key").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    centres = stored(centres.select("key", "n", (-F.col("best.last")).alias("to")), "centres")
    return join_to_groups(members.select("row", "key"), centres, "key", "n", total).where("row <> to").select("row", "to").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (row, to) that are similar enough. A central document that many pairs have is broadcast if its set is not
    large; else the pairs are dealt out by it, and salted by Spark's handling of skewed joins."""
    pairs = stored(pairs, "pairs")
    total = pairs.count()
    centres = pairs.groupBy("to").agg(F.count(F.lit(1)).alias("pairs")).join(
        sets.select(F.col("row").alias("to"), F.col("set").alias("to_set"), F.col("n").alias("to_n")).hint("merge"), "to"
    )
    centres = stored(centres.withColumn("size", F.when(F.col("to_n") <= SENT_SET, F.col("pairs")).otherwise(0)), "central_sets")
    both = join_to_groups(pairs.join(sets.select("row", "set").hint("merge"), "row"), centres, "to", "size", total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            near = []
            for to, own, other in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if to not in known:
                    if len(known) >= SETS_HELD:
                        known.clear()
                    known[to] = np.frombuffer(other.as_buffer(), "<u8")
                near.append(similarity_of(np.frombuffer(own.as_buffer(), "<u8"), known[to]) >= similarity)
            yield b.select(["row", "to"]).filter(pa.array(near, pa.bool_()))

    return both.select("row", "to", "set", "to_set").mapInArrow(run, "row long, to long")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with label, the component of links that a row is in."""
    roots = connected(links.select(F.col("row").alias("a"), F.col("to").alias("b")))
    named = rows.join(roots.select(F.col("node").alias("row"), "root").hint("merge"), "row", "left")
    return named.withColumn("label", F.coalesce("root", "row")).drop("root")


def _left_apart(members: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """row, to: links between members (key, row, label, size: of its set) of a band that have different labels. In each band
    the label whose members have most shingles needs no comparison within itself: the others, in blocks, meet all."""
    share = stored(members.groupBy("key", "label").agg(F.sum("size").alias("k"), F.count(F.lit(1)).alias("rows")), "labels")
    apart = share.groupBy("key").agg(
        F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("all"), F.sum("rows").alias("total"), F.count(F.lit(1)).alias("labels")
    )
    apart = stored(apart.where("labels > 1").select("key", F.col("most.label").alias("main"), "total", "all", (F.col("all") - F.col("most.k")).alias("others")), "apart")
    rest = join_to_groups(members.drop("size"), apart, "key", "total", members.count())
    lefts = F.ceil(F.col("others") / LEFT).cast("int")
    rights = F.ceil(F.col("all") / RIGHT).cast("int")
    draw = F.xxhash64("row")
    is_left = F.col("label") != F.col("main")
    dealt = rest.select("key", "row", "label", is_left.alias("left"), lefts.alias("lefts"), rights.alias("rights"), F.pmod(draw, lefts).alias("lb"), F.pmod(draw, rights).alias("rb"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # in a block that it is on both sides of a row is sent once
    as_right = dealt.withColumn("l", F.explode(all_of("lefts"))).select(
        "key", "row", "label", "l", F.col("rb").cast("int").alias("r"), (F.col("left") & (F.col("lb") == F.col("l"))).alias("left"), F.lit(True).alias("right")
    )
    as_left = dealt.where("left").withColumn("r", F.explode(all_of("rights"))).where("r <> rb").select(
        "key", "row", "label", F.col("lb").cast("int").alias("l"), "r", F.lit(True).alias("left"), F.lit(False).alias("right")
    )
    wanted = sets.select("row", "set", "n").join(sketches.select("row", "keys").hint("merge"), "row")
    # rows that many blocks need are few beside the blocks' pairs: joined once by row
    full = as_right.unionByName(as_left).join(wanted.hint("merge"), "row")

    def compare(block: pa.Table) -> pa.Table:
        left, right = block.filter(block["left"]), block.filter(block["right"])
        if not left.num_rows or not right.num_rows:
            return _LINKS.empty_table()
        key = np.int64(block["key"][0].as_py())
        rows, labels, sizes = (right[c].to_numpy() for c in ("row", "label", "n"))
        keys = _key_table(right)
        sets_ = [np.frombuffer(x.as_buffer(), "<u8") for x in right["set"]]
        own_keys = _key_table(left)
        a, b = [], []
        for i, (row, label, n, own) in enumerate(zip(left["row"].to_pylist(), left["label"].to_pylist(), left["n"].to_pylist(), left["set"], strict=True)):
            near = (labels != label) & (sizes >= similarity * n) & (n >= similarity * sizes)
            at = np.flatnonzero(near)
            if not len(at):
                continue
            same = keys[at] == own_keys[i]
            at = at[own_keys[i][same.argmax(axis=1)] == key]  # the first band that they share
            if not len(at):
                continue
            own = np.frombuffer(own.as_buffer(), "<u8")
            both = _in_common(own, [sets_[j] for j in at])
            at = at[both >= similarity * (n + sizes[at] - both) - 1e-9]
            for j in at[np.unique(labels[at], return_index=True)[1]].tolist():  # one link to a label is enough
                a.append(row)
                b.append(int(rows[j]))
        return pa.table({"row": pa.array(a, pa.int64()), "to": pa.array(b, pa.int64())})

    return full.groupBy("key", "l", "r").applyInArrow(compare, "row long, to long")


_LINKS = pa.schema([("row", pa.int64()), ("to", pa.int64())])


def _key_table(rows: pa.Table) -> np.ndarray:
    return np.array(rows["keys"].combine_chunks().flatten()).reshape(-1, BANDS)


def _in_common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of own each of others has, some at a time."""
    out = []
    for at in range(0, len(others), 64):
        part = others[at : at + 64]
        flat = np.concatenate(part)
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        out.append(np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum([0, *map(len, part[:-1])])))
    return np.concatenate(out)


def _members(flat: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """flat (row, key) with n of its band, for bands that groups (key, n) has. The keys that hold at least 1/HOT_KEYS of all
    rows, so HOT_KEYS of them at most, are named in a filter: their rows get n where they lie, and only others are dealt
    out by key."""
    hot = [r.key for r in groups.where(F.col("n") * HOT_KEYS >= total).select("key").collect()]
    is_hot = F.col("key").isin(hot)
    if not hot:
        return flat.hint("merge").join(groups, "key")
    near = flat.where(is_hot).join(F.broadcast(groups.where(is_hot)), "key")
    return near.unionByName(flat.where(~is_hot).hint("merge").join(groups.where(~is_hot), "key"))


def components(docs: DataFrame, row: str, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, row, label (a row of its component, the same for all). docs is `numbered`, and row its number."""
    sketches = stored(sketched(docs, size, row), "sketches")
    flat = sketches.select("row", F.explode("keys").alias("key"))
    groups = stored(flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    members = stored(_members(flat, groups, sketches.count() * BANDS), "members")
    sets = _sets(docs, row, stored(members.select("row").distinct(), "wanted"), size)
    near = stored(_confirmed(_central(members, members.count()), sets, similarity).unionByName(row_links(sketches, radius)), "near")
    labels = stored(_labelled(sketches.select("doc_id", "row"), near), "labels")
    names = labels.select("row", "label")
    sized = sets.select("row", F.col("n").alias("size")).join(names.hint("merge"), "row")
    more = stored(_left_apart(stored(members.drop("n").join(sized.hint("merge"), "row"), "labelled"), sketches, sets, similarity), "more")
    if not more.limit(1).count():
        return labels
    to = names.select(F.col("row").alias("to"), F.col("label").alias("to_label"))
    edges = more.join(names.hint("merge"), "row").join(to.hint("merge"), "to").select(F.col("label").alias("row"), F.col("to_label").alias("to"))
    further = _labelled(labels.select("doc_id", F.col("row").alias("own"), F.col("label").alias("row")), edges)
    return stored(further.select("doc_id", F.col("own").alias("row"), "label"), "labels")


def near_copies(docs: DataFrame, row: str, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """row: all rows of each component but the one with the smallest doc_id. docs is `numbered`, row its number."""
    named = components(docs, row, size, similarity, radius)
    order = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row")
    # partial aggregation meets large components before the shuffle
    firsts = named.groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return named.join(firsts.hint("merge"), "row", "left_anti").select("row")
