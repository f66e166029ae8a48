"""Packing of tokenized documents into sequences of a fixed number of tokens: large-item matching, then best fit.

Lengths are whole numbers up to the capacity, so one histogram of at most `capacity` counts says all that packing needs,
whatever the number of documents. It is packed by lengths and counts: pieces of over a third of the capacity, of which a
sequence holds two at most, are matched greedily, each with the longest that fits beside it; smaller ones go, from the
longest to the shortest, where the gap that they leave is least. That gives patterns (lengths of a sequence) with the
number of sequences of each, a few thousand however many documents there are. A piece finds its sequence by its rank among
the pieces of its length, which comes from a count for each task and length and a sum over these.

A document's ids end with an end-of-document id. Those of more than a sequence are cut into whole sequences, of which the
first takes what is left over. Null and empty texts are one piece of the end-of-document id alone. Repeated rows are packed
each for itself, a null doc_id is kept, extra columns are not read. An empty table gives no rows.

Ids are those of the `tokenizers` library. Texts of characters up to `CHECKED` are encoded by `tiktoken` with the same
vocabulary, three times as fast; that both part these characters alike is checked when a worker starts, and whatever is
beyond them, or refused, goes through `tokenizers`.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import on_workers, stored, table

CAPACITY = 1024
END = 2
#: The last character that the fast library is used for.
CHECKED = 0x24F


class Encoder:
    """Ids of a text as `tokenizers` gives them. Files: the vocabulary for that library and the same as ranks."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._whole = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in self._whole.get_added_tokens_decoder().items()}
        self._fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=known, special_tokens=special)
        self._special = set(special)
        unlike = [c for c in map(chr, range(CHECKED + 1)) if self._differ(f"a{c}a 1{c}1 !{c}!  {c} {c}{c}")]
        self._beyond = re.compile(f"[^\\x00-{chr(CHECKED)}]" + (f"|[{re.escape(''.join(unlike))}]" if unlike else ""))

    def _differ(self, text: str) -> bool:
        return self._fast.encode(text, allowed_special=self._special) != self.reference(text).tolist()

    def reference(self, text: str) -> np.ndarray:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        if not self._beyond.search(text):
            try:
                return self._fast.encode_to_numpy(text, allowed_special=self._special).astype("<u4", copy=False)
            except ValueError:  # its pattern gives up on very long white space
                pass
        return self.reference(text)


@functools.cache
def encoder(files: tuple[str, str, str]) -> Encoder:
    """One for each worker."""
    return Encoder(*files)


def public_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are whole sequences."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns for counts of pieces by length: (number of sequences, {length: pieces in each})."""
    by_gap: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def add(bins: int, gap: int, held: dict[int, int]) -> None:
        if bins:
            by_gap.setdefault(gap, []).append((bins, held))

    rest = {n: k for n, k in counts.items() if k and 3 * n > capacity}
    order = sorted(rest)
    while order:
        n = order.pop()
        while rest[n]:
            fits = order[: bisect_right(order, capacity - n)]
            mate = n if 2 * n <= capacity and rest[n] > 1 else next((m for m in reversed(fits) if rest[m]), None)
            if mate is None:
                add(rest[n], capacity - n, {n: 1})
                rest[n] = 0
            elif mate == n:
                add(rest[n] // 2, capacity - 2 * n, {n: 2})
                rest[n] %= 2
            else:
                both = min(rest[n], rest[mate])
                add(both, capacity - n - mate, {n: 1, mate: 1})
                rest[n] -= both
                rest[mate] -= both
        order = [m for m in order if rest[m]]
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        left = counts[n]
        for gap in sorted(g for g in by_gap if g >= n):
            each = gap // n  # a sequence that took one is the best fit for the next
            while left and by_gap[gap]:
                bins, held = by_gap[gap].pop()
                full = min(bins, left // each)
                add(full, gap - each * n, held | {n: each})
                bins, left = bins - full, left - full * each
                if bins and left:  # fewer than fill one more
                    add(1, gap - left * n, held | {n: left})
                    bins, left = bins - 1, 0
                if bins:
                    by_gap[gap].append((bins, held))
                    break
            if not by_gap[gap]:
                del by_gap[gap]
            if not left:
                break
        each = capacity // n
        add(left // each, capacity - each * n, {n: each})
        if left % each:
            add(1, capacity - left % each * n, {n: left % each})
    return [p for gap in sorted(by_gap) for p in by_gap[gap]]


def places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """For each length, which ranks go to which sequences: rows (length, first rank, pieces a sequence, first sequence,
    offset of the first piece), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, held in patterns:
        offset = 0
        for n, each in sorted(held.items(), reverse=True):
            rows.append((n, used.get(n, 0), each, sequence, offset))
            used[n] = used.get(n, 0) + bins * each
            offset += n * each
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def pieces(docs: DataFrame, files: tuple[str, str, str], capacity: int, end: int) -> DataFrame:
    """One row per piece, with the task that made it and its place among that task's pieces of its length. Stored, so that
    task and place are data."""
    on_workers(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(files).ids, TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            out = []
            for doc_id, text in zip(*b.columns, strict=True):
                doc_id, ids = doc_id.as_py(), np.append(encode(text.as_py() or ""), np.array([end], "<u4"))
                raw = ids.tobytes()
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECE_TYPES, strict=True)], names=names)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES), "pieces")


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _placed(ranked: DataFrame, plan) -> DataFrame:
    """plan: the broadcast rows of `places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = plan.value
        shift = int(made[:, 1].max(initial=0)) + 1
        starts = made[:, 0] * shift + made[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            _, first, each, sequence, offset = made[np.searchsorted(starts, length * shift + np.minimum(rank, shift - 1), "right") - 1].T
            deal, slot = np.divmod(rank - first, each)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence + deal), pa.array(offset + slot * length)], names=[*b.schema.names[:5], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, PACKED)


def packed(docs: DataFrame, files: tuple[str, str, str], capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: its document, place there, checksum of its ids, and its sequence and offset. The driver holds the
    number of pieces of each length."""
    spark = docs.sparkSession
    cut = pieces(docs, files, capacity, end)
    by_task = stored(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = stored(by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    ranked = cut.join(base, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")
    )
    return _placed(ranked, spark.sparkContext.broadcast(places(pack(counts, capacity))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents, in sequences of 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"), public_files())
