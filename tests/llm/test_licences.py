import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lenscape.llm import licences as x


def prose(rng, n):
    return " ".join(rng.choice("the of and a stone river tree walks under copy license form is to work version part".split()) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return x.fit([prose(rng, rng.randint(1, 40)) for _ in range(800)])


def test_templates_are_found(model):
    for family, texts in x.TEMPLATES.items():
        for text in texts:
            assert model.classify(text)[0] == family, text


def test_clean_held_out_paragraphs_are_unknown(model):
    rng = random.Random(2)
    assert all(model.classify(prose(rng, rng.randint(0, 60)))[0] == x.UNKNOWN for _ in range(500))
    for text in ("", "...", "Licensed under", "the driver lost the license", "x " * 50000):
        assert model.classify(text)[0] == x.UNKNOWN


def test_calibration(model):
    """Of held-out noisy templates those that the classifier is sure of (before templates confirm) are nearly all right."""
    rows = x.examples(9, 6, ["stone", "river"])
    sure = right = 0
    for family, own in rows:
        p = model.probabilities([model.ids[g] for g in sorted(x.grams(own)) if g in model.ids])
        if p.max() >= 0.9:
            sure += 1
            right += model.families[int(p.argmax())] == family
    assert sure > 0.6 * len(rows) and right >= 0.95 * sure


def test_skipping_changes_nothing(model):
    rng = random.Random(3)
    texts = [prose(rng, 20) for _ in range(200)] + [" ".join(w) for _, w in x.examples(4, 3, ["stone"])]
    got = [model.classify(t)[0] for t in texts]
    skips, model.skips = model.skips, False
    assert [model.classify(t)[0] for t in texts] == got
    model.skips = skips


def test_tables(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + "\n" + prose(rng, 5)) for i in range(60)]
    mit = "é Start.\nReleased under the MIT License.\nEnd"
    rows += [(100, mit), (101, None), (102, ""), (103, "\n\n"), (None, mit), (100, mit), (104, "word " * 60000 + "\nLicensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(a, t, 1) for a, t in rows], "doc_id long, text string, licences int")
    model = x.trained(docs)
    got = x.scanned(docs, model).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append([(f.family, f.start, f.end) for f in r.licences])
    at = mit.index("Rel")
    assert by[100] == [[("MIT", at, at + 31)]] * 2 and by[None] == [[("MIT", at, at + 31)]]
    assert by[101] == by[102] == by[103] == [[]] and by[104][0][0][0] == "CC-BY-NC"
    assert all(by[i] == [[]] for i in range(60))
    assert x.scanned(docs.limit(0), x.trained(docs.limit(0))).count() == 0


def test_sample_files(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in x.query(spark, sf).collect():
        lines = r"(?m)^(?:(?:Released under|Licensed under|This work is licensed under) .*|All rights reserved\.)$"
        want = [m.span() for m in re.finditer(lines, texts[r.doc_id])]
        assert [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] == want


def test_short_lines(model):
    for text in ("All rights reserved.", "ALL RIGHTS RESERVED", "Copyright 2020. All rights reserved."):
        assert model.classify(text)[0] == "Proprietary", text
    for text in ("all rights", "rights reserved", "he reserved all seats", "all human rights", "reserved"):
        assert model.classify(text)[0] == x.UNKNOWN, text


def test_short_lines_of_sample_files(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = r"(?m)^(?:(?:Released under|Licensed under|This work is licensed under) .*|All rights reserved\.)$"
    want = {i: [m.span() for m in re.finditer(lines, t or "")] for i, t in texts.items()}
    assert any(t[a:b] == "All rights reserved." for i, t in texts.items() for a, b in want[i])
    for r in x.query(spark, sf).collect():
        assert [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] == want[r.doc_id]


def plainly(text, model):
    """Brute force: every line, all weights, every template, nothing skipped."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        own = re.findall(r"[^\W_]+(?:\.[^\W_]+)*", line.lower())
        parts = {" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}
        x_ = np.zeros(len(model.ids))
        for g in parts & set(model.ids):
            x_[model.ids[g]] = 1
        z = (model.bias + x_ @ model.weights / max(1.0, np.sqrt(x_.sum()))) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        family = model.families[int(p.argmax())]
        if own and family != x.UNKNOWN and p.max() >= x.THRESHOLD:
            threes = lambda w: {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
            mine, best = threes(own), 0.0
            for t in x.TEMPLATES[family]:
                theirs = threes(re.findall(r"[^\W_]+(?:\.[^\W_]+)*", t.lower()))
                whole = min(len(mine), len(theirs)) if len(own) >= 8 else len(theirs)
                best = max(best, len(mine & theirs) / whole)
            if best >= x.SIMILARITY:
                out.append((family, at, at + len(line), pytest.approx(p.max()), pytest.approx(best)))
        at += len(line) + 1
    return out


def test_brute_force(model):
    rng = random.Random(11)
    lines = [" ".join(w) for _, w in x.examples(12, 5, ["stone", "river"])] + [prose(rng, rng.randint(0, 30)) for _ in range(300)]
    lines += [t for ts in x.TEMPLATES.values() for t in ts] + ["", "  ", "É Ünï_code 2.0 v1.2.3"]
    found = 0
    for _ in range(150):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))
        got = [(f["family"], f["start"], f["end"], f["probability"], f["similarity"]) for f in x.scan(text, model)]
        assert got == plainly(text, model), text
        found += len(got)
    assert found > 100


def test_temperature_is_of_rows_held_back(monkeypatch):
    """What the weights are learned from holds no paragraph that the temperature is fitted on."""
    rng = random.Random(21)
    corpus = [prose(rng, rng.randint(3, 40)) for _ in range(200)]
    learned, fit = [], x._logistic
    monkeypatch.setattr(x, "_logistic", lambda rows, *more: (learned.extend(tuple(w) for _, w in rows), fit(rows, *more))[1])
    x.fit(corpus)
    rest = sorted({tuple(x.words(p)) for p in corpus} - {()})
    apart = [w for w in rest if w not in set(learned)]
    assert len(rest) / 10 < len(apart) < len(rest) / 3


def test_wrapped_lines(model):
    """Of a licence paragraph its family is found whatever width it is wrapped to, within its place; prose around it, wrapped
    alike, is not. (A single line between lines that were found alone may stay out.)"""
    rng = random.Random(31)
    for family, text in (("MIT", x.TEMPLATES["MIT"][4]), ("BSD", x.TEMPLATES["BSD"][-1]), ("Unlicense", x.TEMPLATES["Unlicense"][-1])):
        for width in (30, 50, 75, 100):
            own = textwrap.fill(text, width)
            before = textwrap.fill(prose(rng, 60), width) + "\n\n"
            found = x.scan(before + own + "\n\n" + textwrap.fill(prose(rng, 60), width), model)
            assert {f["family"] for f in found} == {family}, (width, found)
            assert all(len(before) <= f["start"] < f["end"] <= len(before) + len(own) for f in found)


def test_runs_by_brute_force(model):
    """Runs of two or more lines that are no licence's alone: all weights and templates, nothing left out early."""
    rng = random.Random(33)
    pieces = [w for _, w in x.examples(34, 2, ["stone"])]
    model_known = model.known
    for _ in range(300):
        own = [w for p in rng.sample(pieces, rng.randint(1, 3)) for w in p][rng.randint(0, 5) :] + prose(rng, rng.choice((0, 0, 5, 30))).split()
        parts = {tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))}
        family, p, similar = model.classify_words(own, wrapped=True)
        of_any = sum(w in model_known.holders for w in parts) / len(parts)
        if of_any < x.SIMILARITY:
            assert family == x.UNKNOWN
        else:
            assert model_known.may_cover(own)
        if family != x.UNKNOWN:
            held = {w for t in x.TEMPLATES[family] for w in x.shingles(x.words(t))}
            assert similar == pytest.approx(len(parts & held) / len(parts)) and similar >= x.SIMILARITY and p >= x.THRESHOLD


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not (COMMON / "MPL-2.0").exists(), reason="no licence texts on this machine")
def test_whole_licence_texts():
    """Texts given as further templates give their own family, most of each text; a family may be a new one."""
    files = {"Apache": "Apache-2.0", "MPL": "MPL-2.0", "CC0": "CC0-1.0", "Artistic": "Artistic"}
    texts = {f: (COMMON / n).read_text() for f, n in files.items()}
    rng = random.Random(35)
    own = x.fit([prose(rng, rng.randint(1, 40)) for _ in range(200)], texts)
    for family, text in texts.items():
        found = x.scan(text, own)
        assert Counter(f["family"] for f in found).most_common(1)[0][0] == family
        assert sum(f["end"] - f["start"] for f in found if f["family"] == family) > 0.5 * len(text)
    assert all(x.scan(textwrap.fill(prose(rng, 200), 60), own) == [] for _ in range(50))
