import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lenscape.llm import sentencepiece_bpe as b

FILE = public_tokenizers.path("piece_bpe_32k.model")
CODEC = b.Codec(FILE)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)


def same(text):
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert list(CODEC.encode(text)) == want
    assert CODEC.decode(want) == LIBRARY.decode(want)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "▁x ▁", "a\n\tb\x00", "é́ﬁ☃🎉日本", "  " * 40, "ab" * 3000, "x" * 5000])
def test_edges(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(CODEC.id_of)), max_size=8))
def test_pieces_side_by_side(parts):
    same("".join(parts).replace("▁", " "))


def test_decode_any_ids():
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randint(0, 6))]
        assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_without_words(monkeypatch):
    c = b.Codec(FILE)
    c.by_words = False
    for text in ("some words  and more", "  a b", ""):
        assert list(c.encode(text)) == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(b, "WORDS_HELD", 3)
    monkeypatch.setattr(b, "PAIRS_HELD", 3)
    c = b.Codec(FILE)
    text = " ".join(f"thequick{i}brown" for i in range(50))
    assert list(c.encode(text)) == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert len(c._words) <= 3 and len(c._pair) <= 3


def test_query_columns(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "é\n☃"), (1, "Hello world"), (None, "x")]
    docs = spark.createDataFrame([(a, t, 0) for a, t in rows], "doc_id long, text string, n_tokens int")
    want = []
    for a, t in rows:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((a, len(ids), sha, hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in b.encoded_digests(docs, FILE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = {r.doc_id: r for r in b.encoded(docs, FILE).collect()}
    assert full[4].decoded == "é\n☃" and full[2].ids == [1, 2]
    assert b.encoded(docs.limit(0), FILE).count() == 0


def test_unbroken_runs_take_linear_time():
    codec = b.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ab", "aé漢\n"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        assert codec.encode(text).tolist() == sp.encode(text, add_bos=True, add_eos=True)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2_000_000))
    began = time.process_time()
    assert codec.decode(codec.encode(text)) == text
    assert time.process_time() - began < 30
