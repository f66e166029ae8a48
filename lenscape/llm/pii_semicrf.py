"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers; their spans always stay. The
field scores whole candidate segments (their shape, digit and dot counts, checksum, octets, what stands beside them) and
labels of neighbouring segments; dynamic programming over entities of at most MAX_TOKENS tokens chooses boundaries and
types jointly. It is trained by maximum likelihood (forward-backward over segments) on the base spans of a bounded
sample of regions, and finds what resembles them in shape without matching a pattern; what it finds is added where it
overlaps no base span.

A region is a run of neighbouring chunks between white space that hold a digit or an at sign; no segment reaches beyond
one, so only regions are decoded, in time linear in their length however long they are (2 MB of letters and digits take
seconds; where candidates begin at every other character, about 0.3 ms a character). Places are code points, ends exclusive.

Null and empty texts have no spans. Repeated rows give repeated results. With no regions to learn from only base spans
are found. Ties between labellings go to the one that comes first in the order of KINDS. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_sample, on_workers, stored

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of an entity, at most, in candidates of the field.
MAX_TOKENS = 40
MAX_CHARS = 160
#: Different regions to learn from, at most, and tokens of such a region.
SAMPLE = 1_500
SAMPLE_TOKENS = 120
STEPS = 80
PENALTY = 2e-3
#: Natural logarithm of how much likelier an added span must be than no entity there.
MARGIN = 2.0

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, with zeros before it or not; a number of any length is not converted."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them, leftmost first, in time linear in the text."""
    floor, at = 0, text.find("@")
    while at >= 0:
        end = at
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                floor = end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """By kind as listed, then by place."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _TRIGGER.search(text):
        return out
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def regions(text: str | None) -> list[tuple[int, int]]:
    """Runs of chunks with a digit or an at sign, one white space character between neighbours."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    n, done = len(text), 0
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        if out and start - out[-1][1] <= 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        done = end
    return out


def _side(c: str) -> str:
    return "" if not c else "9" if c in "0123456789" else "a" if c.isalpha() else "_" if c.isspace() else c


@lru_cache(maxsize=20_000)
def _span_features(span: str) -> tuple[str, ...]:
    digits = _NO_DIGIT.sub("", span)
    shape = re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]+", "a", span))
    runs = re.sub(r"9+", "9", shape)
    n = len(digits)
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    grouped = "g" if re.fullmatch(r"[0-9](?:[ -]?[0-9])*", span) else "-"
    check = grouped + ("L" if luhn(digits) else "x") if 13 <= n <= 19 else grouped
    ats = span.count("@")
    return (
        "bias",
        f"shape {runs[:60]}",
        f"full {shape[:60]}",
        f"digits {min(n, 20)}",
        f"check {check} {min(n, 20)}",
        f"octets {octets}",
        f"at {min(ats, 2)} {'.' in span.rpartition('@')[2]}",
        f"first {_side(span[0])} last {_side(span[-1])}",
        f"letters {any(c.isalpha() for c in span)} dots {min(span.count('.'), 5)}",
        f"plus {span[0] == '+'} {8 <= n <= 15}",
    )


def token_cuts(text: str, start: int, end: int) -> list[int]:
    return [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]


def segments_from(text: str, cuts: list[int], i: int) -> Iterator[tuple[int, tuple[str, ...], bool]]:
    """The segments that begin with token i: its end, its features, and whether it is a single token outside entities."""
    token = text[cuts[i] : cuts[i + 1]]
    yield i + 1, ("out", f"out {_side(token[0])}", f"out {_side(token[0])} {min(len(token), 20)}"), True
    for j in entities_from(text, cuts, i):
        a, b = cuts[i], cuts[j]
        yield j, (*_span_features(text[a:b]), f"left {_side(text[a - 1 : a])}", f"right {_side(text[b : b + 1])}"), False


def entities_from(text: str, cuts: list[int], i: int) -> Iterator[int]:
    """The ends of the candidates that begin with token i: spans of digits and the marks of numbers, or with one at sign,
    of at most MAX_TOKENS tokens and MAX_CHARS characters, that the exact check allows some kind for."""
    start = cuts[i]
    first = text[start]
    last = min(i + MAX_TOKENS, len(cuts) - 1)
    if first in _DIGITS or first in "+(":
        digits = dots = others = 0
        for j in range(i, last):
            a, b = cuts[j], cuts[j + 1]
            c = text[a]
            if c in _DIGITS:
                digits += b - a
                if digits > 19 or b - start > MAX_CHARS:
                    break
                if 8 <= digits <= 15:  # plausible as a phone number, whatever else
                    yield j + 1
                elif digits > 15 and plausible("card", text[start:b]):
                    yield j + 1
                elif digits >= 4 and dots == 3 and not others and plausible("ip", text[start:b]):
                    yield j + 1
            elif c == ".":
                dots += 1
            elif c in " ()+-" or c.isspace():
                others += 1
            else:
                break
    if first.isascii() and first.isalnum():
        at = text.find("@", start, min(cuts[last], start + MAX_CHARS))
        if at < 0:
            return
        for j in range(i + 1, last + 1):
            b = cuts[j]
            if b - start > MAX_CHARS or text.find("@", at + 1, b) >= 0:
                return
            if b > at + 1 and text[b - 1].isascii() and text[b - 1].isalnum() and plausible("email", text[start:b]):
                yield j


class Lattice:
    """All segments of a region, for training."""

    def __init__(self, text: str, start: int, end: int):
        self.cuts = token_cuts(text, start, end)
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.features: list[tuple[str, ...]] = []
        self.outside: list[bool] = []
        for i in range(len(self.cuts) - 1):
            for j, features, outside in segments_from(text, self.cuts, i):
                self.starts.append(i)
                self.ends.append(j)
                self.features.append(features)
                self.outside.append(outside)


LABELS = 1 + len(KINDS)


class Model:
    """ids: numbers of features; weights by label (0 is outside); transitions between the labels of neighbours."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.ids, self.weights, self.transitions = ids, weights, transitions

    def score(self, features: tuple[str, ...], outside: bool) -> np.ndarray:
        """Of a segment by label; minus infinity where a label is not for it."""
        own = [k for f in features if (k := self.ids.get(f)) is not None]
        s = self.weights[own].sum(axis=0) if own else np.zeros(LABELS)
        if outside:
            s[1:] = -np.inf
        else:
            s[0] = -np.inf
        return s

    def scores(self, lattice: Lattice) -> np.ndarray:
        return np.array([self.score(f, o) for f, o in zip(lattice.features, lattice.outside, strict=True)])

    def decode(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The best segmentation's entities. A token that no candidate holds is outside in every segmentation, and then the
        label before the next one is known; so candidates that overlap or touch are decoded together and apart from
        others, with the same result, in memory of a few numbers for each of their tokens."""
        cuts = token_cuts(text, start, end)
        n = len(cuts) - 1
        out: list[tuple[str, int, int]] = []
        first = until = -1  # of the candidates at hand, in tokens
        for i in range(n):
            if i > until >= 0:
                out += self._decode(text, cuts, first, until)
                until = -1
            for j in entities_from(text, cuts, i):
                if until < 0:
                    first = i
                until = max(until, j)
        if until >= 0:
            out += self._decode(text, cuts, first, until)
        return out

    def _decode(self, text: str, cuts: list[int], first: int, until: int) -> list[tuple[str, int, int]]:
        """Of tokens first to until, which single tokens or the region's bounds surround."""
        n = until - first
        best = np.full((n + 1, LABELS), -np.inf)
        best[0, 0] = 0.0
        back = np.zeros((n + 1, LABELS, 2), np.int32)  # where the best segment that ends here begins, and the label before
        gain = np.zeros((n + 1, LABELS))  # its score
        outside = np.zeros(n + 1)  # sums of the scores of single tokens
        for i in range(n):
            into = best[i][:, None] + self.transitions
            value, source = into.max(axis=0), into.argmax(axis=0)
            for to, features, single in segments_from(text, cuts, first + i):
                own = self.score(features, single)
                j = to - first
                if single:
                    outside[i + 1] = outside[i] + own[0]
                total = value + own
                for y in np.flatnonzero(total > best[j]):
                    best[j, y], gain[j, y] = total[y], own[y]
                    back[j, y] = i, source[y]
        after = self.transitions[:, 0] if until < len(cuts) - 1 else 0.0
        out = []
        at, y = n, int((best[n] + after).argmax())
        while at:
            begin, before = map(int, back[at, y])
            if y and gain[at, y] - (outside[at] - outside[begin]) >= MARGIN:
                out.append((KINDS[y - 1], cuts[first + begin], cuts[first + at]))
            at, y = begin, before
        return out[::-1]


def gold_labels(lattice: Lattice, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Segments and labels of the segmentation that has the base spans; of overlapping ones the first in KINDS."""
    place = {c: i for i, c in enumerate(lattice.cuts)}
    taken: dict[int, tuple[int, int]] = {}
    for kind, a, b in spans:
        if a in place and b in place:
            i, j = place[a], place[b]
            if not any(i < e and s < j for s, (e, _) in taken.items()):
                taken[i] = (j, 1 + KINDS.index(kind))
    index = {(s, e, o): k for k, (s, e, o) in enumerate(zip(lattice.starts, lattice.ends, lattice.outside, strict=True))}
    out, at = [], 0
    while at < len(lattice.cuts) - 1:
        j, y = taken.get(at, (at + 1, 0))
        k = index.get((at, j, y == 0))
        if k is None:
            at, y = at, 0
            k, j = index[at, at + 1, True], at + 1
        out.append((k, y))
        at = j
    return out


class Batch:
    """The segments of many regions, for one pass of forward-backward over all of them."""

    def __init__(self, lattices: list[Lattice], gold: list[list[tuple[int, int]]]):
        self.ids: dict[str, int] = {}
        rows, cols = [], []
        self.region, self.start, self.end, outside = [], [], [], []
        offsets, n = [], 0
        for r, x in enumerate(lattices):
            offsets.append(n)
            for k, fs in enumerate(x.features):
                for f in fs:
                    rows.append(n + k)
                    cols.append(self.ids.setdefault(f, len(self.ids)))
            self.region += [r] * len(x.starts)
            self.start += x.starts
            self.end += x.ends
            outside += x.outside
            n += len(x.starts)
        self.rows, self.cols = np.array(rows), np.array(cols)
        self.region, self.start, self.end = map(np.array, (self.region, self.start, self.end))
        self.length = np.array([len(x.cuts) - 1 for x in lattices])
        self.barred = np.zeros((n, LABELS))
        outside = np.array(outside)
        self.barred[outside, 1:] = -np.inf
        self.barred[~outside, 0] = -np.inf
        self.true = np.zeros((n, LABELS))
        self.true_pairs = np.zeros((LABELS, LABELS))
        for r, path in enumerate(gold):
            before = 0
            for k, y in path:
                self.true[offsets[r] + k, y] += 1
                self.true_pairs[before, y] += 1
                before = y
        self.by_end = [np.flatnonzero(self.end == t) for t in range(self.length.max() + 1)]
        self.by_start = [np.flatnonzero(self.start == t) for t in range(self.length.max() + 1)]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        n = len(self.start)
        return self.barred + np.stack([np.bincount(self.rows, weights[self.cols, y], n) for y in range(LABELS)], axis=1)

    def expected(self, scores: np.ndarray, transitions: np.ndarray):
        """Of segments by label and of neighbours' labels; and the sum of log-normalisers."""
        longest, count = self.length.max(), len(self.length)
        low = -1e30
        alpha = np.full((longest + 1, count, LABELS), low)
        alpha[0, :, 0] = 0.0
        into = np.full((longest + 1, count, LABELS), low)
        for t in range(longest + 1):
            own = self.by_end[t]
            if len(own):
                value = into[self.start[own], self.region[own]] + scores[own]
                np.logaddexp.at(alpha[t], self.region[own], np.maximum(value, low))
            into[t] = np.logaddexp.reduce(alpha[t][:, :, None] + transitions, axis=1)
        beta = np.full((longest + 1, count, LABELS), low)
        beta[self.length, np.arange(count)] = 0.0
        onward = np.full((longest + 1, count, LABELS), low)
        for t in range(longest - 1, -1, -1):
            own = self.by_start[t]
            if len(own):
                value = scores[own] + beta[self.end[own], self.region[own]]
                np.logaddexp.at(onward[t], self.region[own], np.maximum(value, low))
                inside = np.logaddexp.reduce(transitions + onward[t][:, None, :], axis=2)
                open_ = t < self.length
                beta[t][open_] = inside[open_]
        log_z = np.logaddexp.reduce(alpha[self.length, np.arange(count)], axis=1)
        z = log_z[self.region][:, None]
        mass = np.exp(np.minimum(into[self.start, self.region] + scores + beta[self.end, self.region] - z, 0.0))
        pairs = np.exp(np.minimum(alpha[:, :, :, None] + transitions + onward[:, :, None, :] - log_z[None, :, None, None], 0.0))
        inner = np.arange(longest + 1)[:, None] < self.length
        return mass, (pairs * inner[:, :, None, None]).sum(axis=(0, 1)), log_z.sum()


def fit(sample: list[str]) -> Model:
    """sample: regions with a character of context on either side."""
    lattices, gold = [], []
    for text in sample:
        x = Lattice(text, 1, len(text) - 1)
        if not 0 < len(x.cuts) - 1 <= SAMPLE_TOKENS:
            continue
        spans = [(k, a, b) for k, a, b in base_spans(text) if a >= 1 and b <= len(text) - 1]
        lattices.append(x)
        gold.append(gold_labels(x, spans))
    if not lattices or not any(y for path in gold for _, y in path):
        return Model({}, np.zeros((0, LABELS)), np.zeros((LABELS, LABELS)))
    batch = Batch(lattices, gold)
    weights, transitions = np.zeros((len(batch.ids), LABELS)), np.zeros((LABELS, LABELS))
    params = [weights, transitions]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        mass, pairs, _ = batch.expected(batch.scores(weights), transitions)
        by_segment = (batch.true - mass) / len(lattices)
        g = np.stack([np.bincount(batch.cols, by_segment[batch.rows, y], len(batch.ids)) for y in range(LABELS)], axis=1)
        for p, grad, m, v in zip(params, [g - PENALTY * weights, (batch.true_pairs - pairs) / len(lattices) - PENALTY * transitions], first, second, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(batch.ids, weights, transitions)


def plausible(kind: str, span: str) -> bool:
    """The exact check that follows the field: no checksum, octet or number of digits speaks against the span."""
    digits = _NO_DIGIT.sub("", span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return span.count("@") == 1 and "." in span.rpartition("@")[2]


def all_spans(text: str | None, model: Model, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans, and those of the field that overlap none of them; by kind as listed, then by place."""
    if not text or not model.ids:
        return base
    out = list(base)
    for a, b in regions(text):
        own = [s for s in base if s[1] < b and a < s[2]]
        for kind, s, e in model.decode(text, a, b):
            if not any(s < y and x < e for _, x, y in own) and plausible(kind, text[s:e]):
                out.append((kind, s, e))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def trained(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from `sample` different regions at most of all documents, chosen by a hash: an eighth of them, or as many as
    there are, with base spans of each kind, and half of them without any."""
    on_workers(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, kinds = [], []
            for t in b.column(0):
                text = f" {t.as_py() or ''} "
                for a, e in regions(text):
                    if e - a <= 8 * SAMPLE_TOKENS:
                        own = text[a - 1 : e + 1]
                        out.append(own)
                        kinds.append(sum(1 << KINDS.index(k) for k in {k for k, _, _ in base_spans(own)}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(kinds, pa.int32())], names=["region", "kinds"])

    found = docs.select("text").mapInArrow(find, "region string, kinds int").groupBy("region").agg(F.max("kinds").alias("kinds"))
    found = stored(found.select(F.xxhash64("region").alias("h"), "region", "kinds"), "regions")
    strata = [(F.col("kinds").bitwiseAND(F.lit(1 << i)) > 0, sample // 8) for i in range(len(KINDS))] + [(F.col("kinds") == 0, sample // 2)]
    sizes = found.agg(*(F.count_if(of).alias(str(i)) for i, (of, _) in enumerate(strata))).first()
    chosen = {r.region for i, (of, most) in enumerate(strata) for r in hash_sample(found.where(of).select("h", "region"), most, sizes[i])}
    return fit(sorted(chosen))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, base array<struct<kind: string, start: int, end: int>>, spans array<struct<kind: string, start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def detected(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base (spans of the base patterns) and spans (all) of every document."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = lambda xs: [dict(zip(("kind", "start", "end"), x, strict=True)) for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = [], []
            for t in b.column(1):
                text = t.as_py()
                found = base_spans(text)
                base.append(row(found))
                spans.append(row(all_spans(text, shared.value, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _SPANS), pa.array(spans, _SPANS)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def _listed(spans: str) -> F.Column:
    """As `listed` does."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole text of documents. The counts are those of the base spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = detected(docs, trained(docs))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(number(k) for k in KINDS),
        F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )
