"""SentencePiece BPE encoding by backtracking, and decoding.

A sequence of tokens is the encoding of a text exactly if each token is its own encoding and each pair of neighbours is
the encoding of what it spells. So a text is encoded without merging it: at each place take the longest vocabulary
match (an Aho-Corasick automaton finds all matches) whose pairing with the token before is valid, shorten it while it
is not, and go back a token when none is left. A place that was left this way ends no prefix's encoding, which a
bitfield remembers, so that each place is left at most once. The validity of a pair is decided by merging the two
tokens' characters again, and remembered.

Characters outside the vocabulary become bytes and part a text, as no merge crosses them. If no piece of the model has
a space after another character (checked), then no merge enters a word from before its space; nor does one join a word
to a mark that no piece has beside another character (looked up). So words are encoded one by one, and those met often
are remembered, up to a bound.

Null and empty texts encode as begin and end only. Texts of any length, spaces of any number, control characters and
characters outside the vocabulary encode as the sentencepiece library does. Repeated rows give repeated results. Extra
columns are not read. The model file is a parameter; it must have the identity normaliser, as BPE with byte fallback.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import on_workers

SPACE = "▁"
#: Words of one generation that a worker remembers, and pairs. When a generation is full, the one before it goes; words
#: that are met again pass to the new one.
WORDS_HELD = 100_000
PAIRS_HELD = 250_000


class Words(dict):
    """Remembered encodings (ids as little bytes), two generations of them. A dictionary that is asked for a word it lacks
    takes it from the generation before or encodes it, so that looking up a text's words runs in the interpreter's core."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        one = self.old.get(word)
        if one is None:
            one = array("I", self.encode(word)).tobytes()
            if len(word) >= 64:
                return one
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = one
        return one


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self._begin, self._end = (array("I", [i]).tobytes() for i in (self.bos, self.eos))
        probe = "  é é ﬁ "
        if sp.decode(sp.encode(probe)) != probe or not sp.id_to_piece(sp.encode("a")[0]).startswith(SPACE):
            raise ValueError("the model must keep texts as they are and begin them with a space")
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_ids = [i for i, _ in sorted(self.byte_of.items(), key=lambda x: x[1])]
        if len(self.byte_ids) != 256:
            raise ValueError("the model needs byte fallback")
        plain = [i for i in range(size) if i not in special and i not in self.byte_of]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.by_words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        # of runs that hold no other character than the vocabulary's
        known = "".join(re.escape(p) for p in self.id_of if len(p) == 1)
        self._known_run = re.compile(f"[{known}]+", re.S)
        self._split = re.compile(self._parts(), re.S)
        self._pair: dict[int, bool] = {}
        self._words = Words(self.word, WORDS_HELD)
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, list[int]] = {}  # pieces that are their own encoding; others never appear in one
        for piece, i in self.id_of.items():
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, i)
                self.whole[piece] = [i]
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.most = max(map(len, self.whole))
        self.window = 8 * self.most  # characters that matching looks at again when a match was shortened
        #: the longest piece that is a shorter prefix; -1 if there is none
        self.shorter = [-1] * size
        for piece, (i,) in self.whole.items():
            for end in range(len(piece) - 1, 0, -1):
                if (one := self.whole.get(piece[:end])) is not None:
                    self.shorter[i] = one[0]
                    break
        self.surface = [
            "" if i in special and i != self.unk else " ⁇ " if i == self.unk else p.replace(SPACE, " ")
            for i, p in enumerate(self.pieces)
        ]
        # ids by which decoding needs more than surfaces put together
        self.odd = np.array([i in self.byte_of or i in special for i in range(size)])

    def _parts(self) -> str:
        """A pattern for the parts of a text that no merge leaves: words with the spaces before them, and runs of an ASCII
        mark, or line break, that no piece has beside anything but itself or after a space."""
        lone = set(map(chr, range(1, 127))) - {c for c in map(chr, range(127)) if c.isalnum() or c == " "}
        for piece in self.id_of:
            for a, b in zip(piece, piece[1:]):
                if a != b:
                    lone.discard(a)
                    if a != SPACE:
                        lone.discard(b)
        marks = "".join(re.escape(c) for c in sorted(lone))
        runs = "|".join(f"{re.escape(c)}+" for c in sorted(lone, key=lambda c: (c not in ".,\n", c)))
        if not lone:
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"{SPACE}*[^{SPACE}{marks}]+|{SPACE}*(?:{runs})|{SPACE}+"

    def merged(self, text: str) -> list[str]:
        """Encoding of a short text by the rule itself: merge the neighbours of best score, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) >= PAIRS_HELD:
                self._pair.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._pair[key] = self.merged(a + b) == [a, b]
        return known

    def backtrack(self, run: str) -> list[int]:
        """Encoding of a run of characters of the vocabulary. All matches at a place are prefixes of the longest one, so
        the next shorter one is a property of the piece."""
        longest, shorter, length = self.automaton.iter_long, self.shorter, self.length
        fits, known = self.fits, self._pair.get
        n = len(run)
        left: bytearray | None = None  # the bitfield: places that end no prefix's encoding
        ids: list[int] = []
        place, before = 0, -1
        # longest matches one after another in a window, as long as none is shortened; up to `sure` none is cut by its end
        window, most = self.window, self.most
        ahead, sure = longest(run[:window]), n if n <= window else window - most
        token = next(ahead)[1]
        while True:
            while token >= 0:
                if left is None or not left[(end := place + length[token]) >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    good = known(before << 32 | token)
                    if good or good is None and fits(before, token):
                        break
                token = shorter[token]
                ahead = None
            if token < 0:
                if before < 0:
                    raise ValueError("no encoding: the vocabulary lacks a character")
                if left is None:
                    left = bytearray((n >> 3) + 1)
                left[place >> 3] |= 1 << (place & 7)
                place -= length[before]
                token = shorter[ids.pop()]
                before = ids[-1] if ids else -1
                ahead = None
                continue
            ids.append(token)
            place += length[token]
            if place >= n:
                return ids
            before = token
            if ahead is None or place > sure:
                end = place + window
                ahead, sure = longest(run[place:end]), n if n <= end else end - most
            token = next(ahead)[1]

    def word(self, text: str) -> list[int]:
        """Encoding of a text that no merge enters or leaves."""
        if (one := self.whole.get(text)) is not None:
            return one
        if self._known_run.fullmatch(text):
            return self.backtrack(text)
        out: list[int] = []
        at = 0
        for m in self._known_run.finditer(text):
            for c in text[at : m.start()]:
                out += [self.byte_ids[b] for b in c.encode()]
            out += self.backtrack(m.group())
            at = m.end()
        for c in text[at:]:
            out += [self.byte_ids[b] for b in c.encode()]
        return out

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, with begin and end."""
        if not text:
            return np.array([self.bos, self.eos], np.uint32)
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_words:
            return np.array([self.bos, *self.word(text), self.eos], np.uint32)
        parts = map(self._words.__getitem__, self._split.findall(text))
        return np.frombuffer(b"".join([self._begin, *parts, self._end]), np.uint32)

    def decode(self, ids) -> str:
        """The text of ids: bytes joined to characters (a byte that is part of none gives U+FFFD), the space that
        begins every encoded text taken off."""
        ids = np.asarray(ids)
        inner = ids[1:-1] if len(ids) > 2 and ids[0] == self.bos and ids[-1] == self.eos else ids
        if len(inner) and not self.odd[inner].any():  # no bytes, no control ids: surfaces put together
            text = "".join(map(self.surface.__getitem__, inner.tolist()))
            return text[1:] if text[0] == " " else text
        out: list[str] = []
        pending = bytearray()
        surface, byte_of = self.surface, self.byte_of
        first = True
        for i in ids.tolist():
            b = byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(_characters(pending))
                pending.clear()
                first = False
            s = surface[i]
            if first and s:
                first = False
                if s[0] == " " and i != self.unk:
                    s = s[1:]
            out.append(s)
        if pending:
            out.append(_characters(pending))
        return "".join(out)


def _characters(data: bytearray) -> str:
    """UTF-8 with one U+FFFD for every byte that is in no character."""
    out, at = [], 0
    raw = bytes(data)
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One for each worker, so that what it remembers serves its later tasks."""
    return Codec(model_file)


OUT = "doc_id long, ids array<long>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids and decoded text of every document."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in batches:
            for one in _slices(b, 256):
                ids = [c.encode(t.as_py() or "") for t in one.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([c.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def encoded_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, made where the texts are encoded, so that ids do not
    leave the worker."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in batches:
            n, hashes, texts = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                texts.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole text of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
