import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lenscape.llm import token_scan as t

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def slow(ids, eod):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == eod:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_scan(spark, width, block):
    rng = np.random.default_rng(block)
    eod = 50256
    files = {
        "a": rng.choice([1, 7, eod, 0xC4, 0x50], 200),
        "b": np.full(7, eod),
        "c": np.full(9, 3),
        "d": np.array([eod, 5, 5]),
        "e": np.array([5, eod]),
        # bytes of the id that lie across two ids are no separator
        "f": np.array([0x5000, 0x00C4, eod, 0x50C4]),
    }
    rows = []
    for name, ids in files.items():
        data = ids.astype(t.WIDTHS[width]).tobytes()
        size = block * width
        rows += [(name, k, data[at : at + size]) for k, at in enumerate(range(0, len(data), size))]
    got = t.separator_scan(spark.createDataFrame(rows, "file string, block long, data binary").repartition(3), eod, width)
    want = [(f, k, *x) for f, ids in files.items() for k, x in enumerate(slow(ids.tolist(), eod))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_documents(spark, tmp_path):
    texts = ["Hello world", None, "", " a  b\n", "é☃", "x" * 4000, "Hello world", "<|endoftext|>", "word " * 3000]
    rows = [(i % 6, x, "clash") for i, x in enumerate(texts)] + [(None, "no id", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, file string").coalesce(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = t.token_counts(docs, str(tmp_path / "files"), RANKS, public_tokenizers.PATTERN, 50256)
    want = [(a, len(e.encode_ordinary(x or ""))) for a, x, _ in rows]
    assert sorted((r.doc_id, r.n_tokens) for r in got.where("doc_id is not null").collect()) == sorted(
        x for x in want if x[0] is not None
    )
    assert got.count() == len(rows)
    blocks = t.token_blocks(spark, str(tmp_path / "files"), 2, 16)
    total = sum(n + 1 for _, n in want)
    assert blocks.selectExpr("sum(length(data))").first()[0] == 2 * total
    small = t.separator_scan(blocks, 50256, 2)
    assert sorted(r.n_tokens for r in small.collect()) == sorted(n for _, n in want)


def test_names_hold_when_the_number_of_cores_changes(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randrange(1, 60)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "d"))
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    write = t.write_token_files

    def then_fewer(*a, **k):
        write(*a, **k)
        spark.conf.set(names[0], "2")  # as when executors are lost between the jobs

    monkeypatch.setattr(t, "write_token_files", then_fewer)
    try:
        spark.conf.set(names[1], "1")
        spark.conf.set(names[0], "7")
        got = t.token_counts(spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "f"), RANKS, public_tokenizers.PATTERN, 50256)
        counts = {r.doc_id: r.n_tokens for r in got.collect()}
    finally:
        for n in names:
            spark.conf.unset(n)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert counts == {a: len(e.encode_ordinary(x)) for a, x in rows}


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert t.token_counts(docs, str(tmp_path / "f"), RANKS, public_tokenizers.PATTERN, 50256).count() == 0


def test_torn_file(spark):
    blocks = spark.createDataFrame([("a", 0, b"123")], "file string, block long, data binary")
    with pytest.raises(Exception, match="multiple"):
        t.separator_scan(blocks, 1, 2).collect()


def test_sample_files(spark, sf):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: len(e.encode_ordinary(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = t.query(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
    starts = sorted((r.file, r.start, r.n_tokens) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] + 1 == b[1] for a, b in zip(starts, starts[1:]))


@pytest.mark.parametrize("ranges", [True, False])
def test_files_by_range(spark, tmp_path, monkeypatch, ranges):
    """Files of many blocks and groups, by byte ranges and as whole values."""
    monkeypatch.setattr(t, "GROUP", 3)
    if not ranges:
        monkeypatch.setattr(t, "_by_range", lambda address: False)
    rng = np.random.default_rng(5)
    folder = tmp_path / "a folder"
    folder.mkdir()
    files = {f"part-{i}": rng.choice([1, 9, 50256, 0xC4, 0x50], n, p=[0.3, 0.3, 0.01, 0.29, 0.1]) for i, n in enumerate([0, 1, 7, 8, 200, 1003])}
    for name, ids in files.items():
        (folder / name).write_bytes(ids.astype("<u2").tobytes())
    got = t.stitched(t.file_search(spark, str(folder), 50256, block=8))
    want = [(f, k, *x) for f, ids in files.items() for k, x in enumerate(slow(ids.tolist(), 50256))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_files(spark, tmp_path):
    assert t.stitched(t.file_search(spark, str(tmp_path), 50256)).count() == 0


def test_odd_size(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"abc")
    with pytest.raises(Exception, match="buffer size"):
        t.stitched(t.file_search(spark, str(tmp_path), 50256)).count()


def test_file_above_2_gb(spark, tmp_path):
    """A sparse file; documents end before, across and after the 2 GB."""
    ends = [5, 6, (1 << 20) - 1, 1 << 20, (1 << 30) - 1, (1 << 30) + 3, (1 << 30) + (1 << 21)]
    total = (1 << 30) + (1 << 21) + 10
    with open(tmp_path / "part-0", "wb") as f:
        f.truncate(2 * total)
        for at in ends:
            f.seek(2 * at)
            f.write((50256).to_bytes(2, "little"))
    got = t.stitched(t.file_search(spark, str(tmp_path), 50256)).orderBy("ordinal").collect()
    starts = [0, *(e + 1 for e in ends)]
    want = [("part-0", k, a, e - a, k < len(ends)) for k, (a, e) in enumerate(zip(starts, [*ends, total], strict=True))]
    assert [tuple(r) for r in got] == want
