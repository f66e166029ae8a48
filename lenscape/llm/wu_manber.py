"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For the windows of one length the search looks at blocks of two
words: a shift table says how many words the search may advance past a block, the buckets of blocks that end a window
give the test strings, and direct comparison confirms an occurrence.

Texts are lower-cased in A-Z only; words are runs of other characters than ASCII punctuation, space and control.
Null and empty texts have no words; an item without words has no window and occurs nowhere. Equal items all count. Items
without an id are left out unless `nameless`: then their windows hit words as others do, and all of them together are one
item, null, that a digest leaves out, as in the SQL. The query and the pipeline search them.
Repeated rows give repeated results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, numbered, on_workers, stored

WINDOW = 10
BLOCK = 2
#: Windows in the tables at one time; more benchmark windows are searched in several passes over the documents.
WINDOWS_A_PASS = 200_000

_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_TABLE = bytes(b if b in _WORD else 32 for b in LOWER_BYTES)


def words(text: str | None) -> list[bytes]:
    """All bytes of characters past ASCII belong to words, so UTF-8 is split as the characters would be."""
    return text.encode().translate(_TABLE).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))]


class Matcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple]):
        self.length = length
        self.block = min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.buckets.setdefault(self.key(pattern, length), []).append((pattern, owners))

    def key(self, row, end: int):
        return row[end - 1] if self.block == 1 else (row[end - 2], row[end - 1])

    def search(self, row: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """The start and the owners of each occurrence, in order of place."""
        shift, most, length, n = self.shift.get, self.most, self.length, len(row)
        end = length
        if self.block == 1:
            for end in range(1, n + 1):
                if row[end - 1] in self.shift:
                    yield from ((end - 1, owners) for _, owners in self.buckets[row[end - 1]])
            return
        while end <= n:
            step = shift((row[end - 2], row[end - 1]), most)
            if step:
                end += step
                continue
            start = end - length
            found = tuple(row[start:end])
            for pattern, owners in self.buckets[row[end - 2], row[end - 1]]:
                if pattern == found:
                    yield start, owners
                    break
            end += 1


def _by_id(item: int | None) -> tuple:
    """Null after all numbers."""
    return item is None, item or 0


def matchers(item_windows: list[tuple[tuple[bytes, ...], int]]) -> list[Matcher]:
    by_length: dict[int, dict] = {}
    for pattern, item in item_windows:
        by_length.setdefault(len(pattern), {}).setdefault(pattern, set()).add(item)
    return [Matcher(k, {p: tuple(sorted(v, key=_by_id)) for p, v in found.items()}) for k, found in sorted(by_length.items())]


def scan(row: list[bytes], tables: list[Matcher]) -> tuple[list[tuple[int, int]], set]:
    """The merged intervals of hit words, and the items of which a window occurs."""
    spans, items = [], set()
    for m in tables:
        for start, owners in m.search(row):
            spans.append((start, start + m.length))
            items.update(owners)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


FOUND = "doc_id long, row long, n_words long, starts array<int>, ends array<int>, items array<long>"


def _search_pass(rows: DataFrame, tables, everything: bool) -> DataFrame:
    """Rows for all documents, or for those with a hit. tables: a broadcast variable."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tables.value
        for b in batches:
            out: list[tuple] = []
            for doc_id, row, text in zip(*b.columns, strict=True):  # a text at a time, to bound memory
                own = words(text.as_py())
                spans, items = scan(own, made)
                if everything or spans:
                    out.append((doc_id.as_py(), row.as_py(), len(own), [s for s, _ in spans], [e for _, e in spans], sorted(items, key=_by_id)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES
            )

    return rows.mapInArrow(search, FOUND)


_NAMES = ["doc_id", "row", "n_words", "starts", "ends", "items"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _passes(benchmark: DataFrame, most: int, nameless: bool) -> Iterator[list]:
    """The items' windows, a bounded number at a time."""
    held: list = []
    for r in (benchmark if nameless else benchmark.where("item_id is not null")).select(F.col("item_id").cast("long"), "text").toLocalIterator():
        for w in windows(words(r[1])):
            held.append((w, r[0]))
            if len(held) >= most:
                yield held
                held = []
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, windows_a_pass: int = WINDOWS_A_PASS, nameless: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, starts and ends (of runs of hit words), items (item_ids in order of
    number), n_hit. The driver holds two parts of `windows_a_pass` benchmark windows at most. A larger benchmark takes more
    passes over the documents; these are stored with their row numbers first, so that every pass knows a row by the same
    number however files are split, and the hits of all passes are put together by it once."""
    spark = docs.sparkSession
    on_workers(spark)
    parts = _passes(benchmark, windows_a_pass, nameless)
    first, held = next(parts), next(parts, None)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if held is None:
        rows, row = rows.withColumn("row", F.monotonically_increasing_id()), "row"
    else:
        rows, row = numbered(rows)
    rows = rows.select("doc_id", F.col(row).alias("row"), "text")
    found = _search_pass(rows, spark.sparkContext.broadcast(matchers(first)), everything=True)
    if held is not None:
        found = stored(found, "hits")
        while held is not None:
            tables = spark.sparkContext.broadcast(matchers(held))
            found = found.unionByName(stored(_search_pass(rows, tables, everything=False), "hits"))
            tables.unpersist()
            held = next(parts, None)
        found = _put_together(found)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", hit)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, windows_a_pass: int = WINDOWS_A_PASS, nameless: bool = False) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs: a filter for each pass, no shuffle."""
    spark = docs.sparkSession
    on_workers(spark)
    at = docs.columns.index("text")
    for held in _passes(benchmark, windows_a_pass, nameless):
        docs = _clean_of(docs, spark.sparkContext.broadcast(matchers(held)), at)
    return docs


def _clean_of(docs: DataFrame, tables, at: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tables.value
        for b in batches:
            clean = [not any(next(m.search(own), None) for m in made) for own in (words(t.as_py()) for t in b.column(at))]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _put_together(found: DataFrame) -> DataFrame:
    """The findings of several passes, a row for each document: its runs of hit words merged, its items once each. A group
    has a row for each pass that found something in the document."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [merged([x for s, e in parts for x in zip(s, e, strict=True)]) for parts in ([(p["starts"], p["ends"]) for p in c.as_py()] for c in b.column(3))]
            spans = [[[x[i] for x in own] for own in both] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x, _TYPES[3]) for x in spans), b.column(4)], names=_NAMES)

    grouped = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.collect_list(F.struct("starts", "ends")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.select("doc_id", "row", "n_words", "spans", "items").mapInArrow(merge, FOUND)


def digest_of(items) -> F.Column:
    """Of item_ids sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",").cast("binary"), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: whole documents against whole benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), nameless=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest_of(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPLIT}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_SPLIT}') AS w FROM benchmark),
p AS (SELECT item_id, least(len(w), {WINDOW}) AS k,
             unnest(list_transform(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1),
                    lambda i: array_to_string(w[i : i + {WINDOW} - 1], ' '))) AS s
      FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT g.doc_id, g.i, g.k, p.item_id
        FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM g) g JOIN p ON g.k = p.k AND g.s = p.s),
words AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit
          FROM (SELECT doc_id, i, unnest(range(0, k)) AS o FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
