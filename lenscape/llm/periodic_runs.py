"""Periodic runs of words, found with a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of consecutive words with smallest period q and a length of at least max(least, times * q) that no
neighbouring word extends with that period. The states of a text's automaton are merged from the longest to the shortest.
Whenever a place comes into a set of end positions, its distances to the two neighbours there are looked at: a distance that
does not exceed the state's length seeds a square, and each square that lies in no known run of its period is extended to
both sides. A word of length q whose copies touch has no occurrence between them, so every run is seeded with its smallest
period; a multiple of it seeds the same stretch, which keeps the smallest.

The automaton is built over the stretches of a text that could hold a run: with times >= 3, every sequence of `gram` words
inside a run recurs inside it within a third of its length, so words outside of such sequences lie in no run. That leaves
whole texts which are periodic, and next to nothing of prose.

Words are what ASCII white space parts. Null and empty texts have no words and no runs; the digests are then those of the
empty string, and start, length, period and exponent_milli null, as in any text without runs. Repeated rows give repeated
results, a null doc_id is kept (`planted` leaves such a text as it is). Extra columns are not read. A text is handled whole,
in memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import on_workers, table

LEAST = 24
TIMES = 3
#: Places that a chunk of an ordered set holds at most.
CHUNK = 1024


class Automaton:
    """The suffix automaton of a sequence of whole numbers. A state's first transition is in two lists, further ones in a
    dictionary of the few states that have several."""

    def __init__(self, s: list[int]):
        self.length, self.link, self.end = [0], [-1], [-1]
        self._symbol, self._to, self._more = [-1], [0], {}
        last = 0
        for place, c in enumerate(s):
            last = self._extend(last, place, c)

    def _state(self, length: int, link: int, end: int, symbol: int = -1, to: int = 0) -> int:
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        self._symbol.append(symbol)
        self._to.append(to)
        return len(self.length) - 1

    def _extend(self, last: int, place: int, c: int) -> int:
        length, link, symbol, to, more = self.length, self.link, self._symbol, self._to, self._more
        new = self._state(place + 1, 0, place)
        p = last
        while p >= 0:
            if symbol[p] == c:
                q = to[p]
                break
            if symbol[p] < 0:
                symbol[p], to[p] = c, new
            else:
                others = more.setdefault(p, {})
                if c in others:
                    q = others[c]
                    break
                others[c] = new
            p = link[p]
        else:
            return new
        if length[p] + 1 == length[q]:
            link[new] = q
            return new
        copy = self._state(length[p] + 1, link[q], -1, symbol[q], to[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if symbol[p] == c:
                if to[p] != q:
                    break
                to[p] = copy
            elif more.get(p, {}).get(c) == q:
                more[p][c] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
        return new


class Places:
    """An ordered set of places, in chunks, so that one more costs little wherever it goes."""

    __slots__ = ("chunks", "tops", "size")

    def __init__(self, first: int):
        self.chunks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Puts x in, which is not there yet, and gives its neighbours."""
        at = min(bisect_left(self.tops, x), len(self.tops) - 1)
        chunk = self.chunks[at]
        i = bisect_left(chunk, x)
        before = chunk[i - 1] if i else self.tops[at - 1] if at else None
        after = chunk[i] if i < len(chunk) else None  # only in the last chunk can x be the largest
        chunk.insert(i, x)
        self.size += 1
        if len(chunk) > CHUNK:
            half = len(chunk) // 2
            self.chunks[at : at + 1] = [chunk[:half], chunk[half:]]
            self.tops[at : at + 1] = [chunk[half - 1], chunk[-1]]
        elif i == len(chunk) - 1:
            self.tops[at] = x
        return before, after


class Runs:
    """The maximal stretches of each period that are known of one sequence."""

    def __init__(self, s: list[int]):
        self.s, self.known, self.recent = s, {}, {}

    def seed(self, end: int, period: int) -> None:
        """The words up to `end` and up to `end + period` agree over `period` words at least."""
        first = end - period + 1
        start, stop = self.recent.get(period, (0, 0))
        if start <= first and end + period < stop:
            return
        spans = self.known.setdefault(period, [])
        at = bisect_right(spans, (first, len(self.s) + 1)) - 1
        if at < 0 or end + period >= spans[at][1]:
            insort(spans, self._extended(first, end + 1, period))
            at = bisect_right(spans, (first, len(self.s) + 1)) - 1
        self.recent[period] = spans[at]

    def _extended(self, first: int, after: int, d: int) -> tuple[int, int]:
        """first and after bound the places that equal those d further on; steps double while all of them agree."""
        s, n, step = self.s, len(self.s) - d, 8
        while after < n:
            most = min(step, n - after)
            if s[after : after + most] != s[after + d : after + d + most]:
                while s[after] == s[after + d]:
                    after += 1
                break
            after, step = after + most, step * 2
        step = 8
        while first > 0:
            most = min(step, first)
            if s[first - most : first] != s[first - most + d : first + d]:
                while s[first - 1] == s[first - 1 + d]:
                    first -= 1
                break
            first, step = first - most, step * 2
        return first, after + d

    def found(self) -> dict[tuple[int, int], int]:
        """Each stretch with its smallest period."""
        out: dict[tuple[int, int], int] = {}
        for period in sorted(self.known, reverse=True):
            for span in self.known[period]:
                out[span] = period
        return out


def repetitions(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal repetitions of at least two periods, by start and period."""
    made = Automaton(s)
    length, link = made.length, made.link
    sets: list = list(made.end)  # a place, a set of several, or -1
    runs = Runs(s)
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        into, own = link[state], sets[state]
        sets[state] = None
        if not into:
            continue  # at the root no distance is small enough
        most, large = length[into], sets[into]
        if isinstance(large, int):
            if large < 0:
                sets[into] = own
                continue
            large, own = (own, large) if isinstance(own, Places) else (Places(large), own)
        elif isinstance(own, Places) and own.size > large.size:
            large, own = own, large
        for x in (own,) if isinstance(own, int) else own:
            before, after = large.add(x)
            if before is not None and x - before <= most:
                runs.seed(before, x - before)
            if after is not None and after - x <= most:
                runs.seed(x, after - x)
        sets[into] = large
    return sorted((a, b - a, q) for (a, b), q in runs.found().items())


def gram_of(least: int, times: int) -> int:
    """Words of the longest sequences of which all inside a run must recur inside it: with L words and period q each start
    from 0 to L - gram has a copy q before or q after it if L >= 2 * q + gram - 1."""
    return max(1, (least + 5) // 3) if times >= 3 else 1


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES, rounds: int = 6) -> list[tuple[int, int]]:
    """Parts that hold all runs, if there are any. Equal sums of a sequence's words can only keep a part too many."""
    gram = gram_of(least, times)
    n = len(ids)
    if n < least:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        sums *= np.uint64(0xBF58476D1CE4E5B9)
        sums += mixed[j : j + len(sums)]
    in_order = np.sort(sums)
    if not (in_order[1:] == in_order[:-1]).any():
        return []
    parts, out = [(0, n, rounds)], []
    while parts:
        a, b, left = parts.pop()
        own = sums[a : b - gram + 1]
        order = np.argsort(own, kind="stable")
        near = (own[order[1:]] == own[order[:-1]]) & (order[1:] - order[:-1] <= (b - a) // times)
        recurs = np.zeros(len(own), bool)
        recurs[order[1:][near]] = True
        recurs[order[:-1][near]] = True
        edge = np.zeros(b - a + 1, np.int32)  # words of recurring sequences, as a sum of steps
        edge[:-gram][recurs] += 1
        edge[gram:][recurs] -= 1
        inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        steps = np.diff(inside)
        for x, y in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
            if y - x < least:
                continue
            if y - x == b - a or not left:
                out.append((a + x, a + y))
            else:
                parts.append((a + x, a + y, left - 1))
    return sorted(out)


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start and period."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    return [
        (a + start, length, q)
        for a, b in stretches(np.array(ids), least, times)
        for start, length, q in repetitions(ids[a:b])
        if length >= max(least, times * q)
    ]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without what a run repeats: all of it after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equals the first by start, then by period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of every tenth document (by hash) from a place on repeated with a period."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _digest_row(doc_id: int | None, words: list[bytes], least: int, times: int) -> tuple:
    runs = runs_of(words, least, times)
    top = strongest(runs)
    place = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (doc_id, len(runs), *place, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def run_digests(docs: DataFrame, plant: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: number of runs, the strongest, digests of all runs and of the collapsed text. No shuffle."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(*b.columns, strict=True):  # a text at a time, to bound memory
                doc_id, words = doc_id.as_py(), (text.as_py() or "").encode().split()
                out.append(_digest_row(doc_id, planted(words, doc_id) if plant else words, least, times))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


LISTED = "doc_id long, start long, length long, period long, sample string"


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per run of each document: its place and the words of its first period."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(*b.columns, strict=True):
                words = (text.as_py() or "").encode().split()
                out += [(doc_id.as_py(), a, n, q, b" ".join(words[a : a + q]).decode()) for a, n, q in runs_of(words, least, times)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "period", "sample"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LISTED)


def without_repetition(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs, all columns, with each text collapsed. A text without runs, and null, stays as it is."""
    on_workers(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text in b.column(at):
                text = text.as_py()
                words = (text or "").encode().split()
                found = runs_of(words, least, times)
                texts.append(collapsed(words, found).decode() if found else text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: whole documents, those that the contract says with a planted period."""
    return run_digests(table(spark, sf_dir, "documents"), plant=True)
