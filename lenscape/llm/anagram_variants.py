"""Spelling variants of words, found by anagram hashing.

A word's anagram value is the sum of the fifth powers of its code points. Two words that differ by one letter agree in
their values once that letter is taken out: of the longer one for an added or removed letter, of both for an exchanged one.
So every word gives a row for each of its letters with the value without it, and rows with the value of the whole word, and
rows that share a value meet. Values alone would let all anagrams meet; since one edit lies in one place, words are also cut
into blocks of `BLOCK` letters, and a row carries a checksum of all that lies outside the letter's block. What meets then
differs inside one block at most, so a group has a bounded number of words however large the vocabulary is. The order of
letters is verified, and a pair counts in the one group that its place of difference and letter name.

The form of a word is its most frequent near word (ties: smallest in code-point order) if that is `RATIO` times as frequent
or more; the root is the end of the chain of forms, found by doubling steps: at most log10 of the largest count long.

Null and empty texts have no words. Repeated rows count again. A null doc_id counts as the empty string where words are
altered by it. Very long runs are words like others. Without words of that kind the result has no rows. Extra columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, on_workers, stored, table

BLOCK = 3
LEAST = 7
TWICE = 2
RATIO = 10
#: Different words that a task counts before it sends them on.
HELD = 200_000

_LOW = str.maketrans(UPPER, LOWER)


def altered(run: str, salt: int) -> str:
    """The run, of every 31st pair of document and run without one of its code points. salt: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), salt)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, alter: bool = False, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """Words of at least `least` code points with their number n, of those that occur `twice` times or more. Tasks add up
    what they have read, a bounded number of words at a time."""
    on_workers(docs.sparkSession)
    long_runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # shorter ones can't get longer

    def sent(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(*b.columns, strict=True):
                salt = zlib.crc32(f"{'' if (d := doc_id.as_py()) is None else d}:".encode())
                for word, n in Counter(long_runs.findall((text.as_py() or "").translate(_LOW))).items():
                    word = altered(word, salt) if alter else word
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield sent(held)
                    held = {}
        yield sent(held)

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def power(c: str) -> int:
    return ord(c) ** 5


def keys(word: str, block: int = BLOCK) -> Iterator[tuple[int, int, int, bool]]:
    """(value, checksum outside the block, block, whether a letter is out) of all rows of a word."""
    m, value, outside, seen = len(word), sum(map(power, word)), None, set()
    for i, c in enumerate(word):
        b = i // block
        if i % block == 0:
            seen.clear()
            outside = zlib.crc32(f"{word[:i]}\0{word[i + block:]}".encode())
        if c not in seen:
            seen.add(c)
            yield value - power(c), outside, b, True
    for b in range(m // block + 1):  # as a word with one more letter in this block sees it
        at = b * block
        yield value, zlib.crc32(f"{word[:at]}\0{word[at + block - 1:]}".encode()), b, False


def difference(a: str, b: str) -> int:
    """The place where a and b, which is as long or one letter longer, differ by exactly one edit; -1 if they don't."""
    n = len(a)
    i = next((i for i in range(n) if a[i] != b[i]), n)
    if len(b) == n:
        return i if i < n and a[i + 1 :] == b[i + 1 :] else -1
    return i if a[i:] == b[i + 1 :] else -1


def near_in_group(group: list[tuple], block: int) -> Iterator[tuple]:
    """Pairs of near words of a group of equal value and checksum, each with the other and its count."""
    value = group[0][0]
    out = [r for r in group if r[3]]
    for k, (_, _, b, _, word, n) in enumerate(out):
        for _, _, other_b, taken, other, other_n in [*out[k + 1 :], *(r for r in group if not r[3])]:
            if b != other_b or len(other) != len(word) - (not taken):
                continue
            at = difference(other, word)
            if at >= 0 and at // block == b and sum(map(power, word)) - power(word[at]) == value:
                yield word, other, other_n
                yield other, word, n


ROW = "value long, outside long, block int, taken boolean, word string, n long"


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: every pair of words that differ by one added, removed or exchanged code point, both ways."""
    on_workers(words.sparkSession)
    names = [c.split()[0] for c in ROW.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [(*k, w, n) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for k in keys(w, block)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and (row[0] != group[0][0] or row[1] != group[0][1]):
                    if len(group) > 1:
                        found += near_in_group(group, block)
                    group = []
                group.append(row)
            yield pairs(found)
        yield pairs(list(near_in_group(group, block)) if len(group) > 1 else [])

    def pairs(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

    spreaded = words.select("word", "n").mapInArrow(spread, ROW)
    dealt = spreaded.repartition("value", "outside").sortWithinPartitions("value", "outside")
    return dealt.mapInArrow(meet, "word string, near string, near_n long")


def forms(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """words (word, n) with form, form_n and n_near. words should be stored, it is read twice."""
    best = near_words(words, block).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    enough = -F.col("best.less") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def roots(found: DataFrame) -> DataFrame:
    """found with root. Forms have larger counts than their words, so that chains end; each round doubles the steps that a
    word has gone along its chain. Only words with a form take part."""
    chain = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "chain")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(chain.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        if longer.where("moved").isEmpty():
            break
        chain = longer.select("word", "root")
    return found.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, alter: bool = False, least: int = LEAST, twice: int = TWICE, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, n_near, root of all frequent long words of docs."""
    words = stored(word_counts(docs, alter, least, twice), "words")
    return roots(stored(forms(words, ratio), "forms"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the words of all documents, altered as the contract says."""
    found = variants(table(spark, sf_dir, "documents"), alter=True)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


_STEPS = "\n".join(
    f"t{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM t{k})," for k in range(8)
)
#: crc32 by its table of 256 values, over the bytes of a text.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + octet_length(encode({0}))),
  lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"""
SQL = f"""
WITH RECURSIVE t0 AS (SELECT i, i AS c FROM range(256) r(i)),
{_STEPS}
crc AS (SELECT list(c ORDER BY i) AS tab FROM t8),
runs AS (SELECT doc_id, w, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= {LEAST} GROUP BY ALL),
hashed AS (SELECT w, n, {_CRC.format("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM runs, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {TWICE}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.s = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.s = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form,
          CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS root FROM found WHERE form IS NULL
          UNION ALL SELECT f.word, c.root FROM found f JOIN chain c ON f.form = c.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON f.word = c.word
"""
