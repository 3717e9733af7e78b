"""Toxicity: subwords against a plain loop, held-out rows, unseen misspellings, and odd inputs."""

import zlib

import numpy as np
import pytest

from stridelake.llm import toxicity as X


def plain_buckets(text):
    """Every word's hash and those of its n-grams with a space at both ends, one at a time."""
    base, spread, mask = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    out = []
    for w in text.lower().split():
        codes = [ord(c) for c in f" {w} "]
        word = sum(c * pow(base, i + 1, 1 << 64) for i, c in enumerate(codes[:-1]) if i) & mask
        found = [word * spread & mask]
        for n in X.GRAMS:
            for i in range(len(codes) - n + 1):
                h = 0
                for c in codes[i : i + n]:
                    h = (h * base + c) & mask
                found.append((h + n) * spread & mask)
        out.append(sorted(h >> (64 - X.BITS) for h in found))
    return out


@pytest.mark.parametrize("text", ["a", "An idiot", "  Ünïcode\t𝔘nd\nmore  ", "x" * 300, "ab cd " * 50])
def test_subwords_are_the_plain_ones(text):
    (piece,) = X._pieces(text)
    buckets, word, n = X.subwords(piece)
    assert [sorted(buckets[word == i].tolist()) for i in range(n)] == plain_buckets(text)


def test_pieces_dont_change_a_bag(monkeypatch):
    text = "some words of a longer text " * 40
    whole = X.bag(text)
    monkeypatch.setattr(X, "PIECE", 50)
    assert len(list(X._pieces(text))) > 5
    for a, b in zip(whole, X.bag(text)):
        assert a == pytest.approx(b)
    assert len(X.bag("")[0]) == 0 and len(X.bag(" \n ")[0]) == 0


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["th", "an", "re", "in", "on", "er", "es", "ti", "at", "ou"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(20, 60))]
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["idiot", "moron", "worthless"])))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_rows_and_misspellings(spark):
    rows = corpus(500, 1)
    extra = [(9001, "the tion an idiiot moronn in re worthles an", None), (9002, "the tion an there ones in re ation an", None), (9003, None, None), (9004, "", None), (None, "an idiot", None), (9001, "again " * 3, None)]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t, _ in rows + extra], "doc_id long, text string, label int, score string")
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows] + [(9002, 5), (9001, None), (None, 1)], "doc_id long, toxic int")  # labels of held-out rows are wrong, and not learned
    found = X.toxicity(docs, labels).collect()
    assert len(found) == len(rows) + len(extra) and all(r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 5 == 0) for r in found)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found)
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.id] for r in found if r.id in held]
    assert np.mean(right) > 0.97
    by = {}
    for r in found:
        by.setdefault(r.id, []).append(r.score)
    assert max(by[9001]) > 0.5 > by[9002][0] and len(by[9001]) == 2 and by[9003] == by[9004]


def test_without_both_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "an idiot"), (2, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in X.toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert X.toxicity(docs.where("false"), labels).isEmpty()


def test_a_long_text_is_scored_whole():
    margins = np.zeros(1 << X.BITS, np.float32)
    margins[X.subwords(" idiot ")[0]] = 50.0
    calm, late = "word " * 200_000, "word " * 200_000 + "idiot " * 100_000
    assert X.score_of(calm, margins, -1.0) < 0.5 < X.score_of(late, margins, -1.0)
    assert 0 < X.score_of("y" * 3_000_000, margins, -1.0) < 1
