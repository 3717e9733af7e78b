"""Near copies by wide fingerprints: against all pairs of fingerprints, and against whole shingle sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from stridelake.llm import simhash

SCHEMA = "doc_id long, text string, score double"
SEGMENT, RADIUS = simhash.NEAR["segment"], simhash.NEAR["radius"]


def documents():
    """Copies with a few words changed, chains of them, plain copies, other documents, short, empty and very long ones."""
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    texts = [None, "", " ", "one two", "one two", "one three", " ".join(words(60_000))]
    texts.append(texts[-1] + " and one word more")
    for n in (40, 100, 300, 800):
        for edits in (0.5, 1, 2, 3):
            chain = words(n)
            texts.append(" ".join(chain))
            for _ in range(5):
                changed = list(chain)
                for at in rng.sample(range(n), max(1, round(n * edits / 100))):
                    changed[at] = "zz" + changed[at]
                texts.append(" ".join(changed))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def groups_of(n, linked):
    root = list(range(n))
    for i, j in linked:
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if r == old else r for r in root]
    return root


def brute_links(rows):
    """Pairs of all fingerprints within the radius that lack one bit at most of a common value of some segment, as Python numbers."""
    fps = [int.from_bytes(simhash.fingerprint(t or "", 5, 256).tobytes(), "little") for _, t in rows]
    mask = (1 << SEGMENT) - 1
    cuts = [64 * w + i * SEGMENT for w in range(4) for i in range(64 // SEGMENT)]
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            parts = [(a >> c & mask, b >> c & mask) for c in cuts]
            if (a ^ b).bit_count() <= RADIUS and any((x & ~y).bit_count() <= 1 and (y & ~x).bit_count() <= 1 for x, y in parts):
                yield i, j


def test_groups_are_those_of_all_pairs(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], SCHEMA).withColumn("node", F.lit("clash")).repartition(3)
    root = groups_of(len(rows), brute_links(rows))
    got = simhash.near_dedup(df)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root)) and got.columns == df.columns
    assert simhash.near_dedup(df.limit(0)).count() == 0
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near, alike = [], []
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            share = len(x & y) / len(x | y) if x | y else 1.0
            if share >= 0.8:
                near.append(root[i] == root[j])
            elif share < 0.5:
                alike.append(root[i] == root[j])
    assert len(near) > 100 and np.mean(near) >= 0.95 and not any(alike)


def test_null_ids_are_one_document_after_all_others(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (7, text), (None, "alone here"), (None, "alone here"), ((1 << 63) - 1, "x y z"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_dedup(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "9223372036854775807", "None", "None"]


def test_wide_fingerprints_by_counting():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon"]) for _ in range(9000))
    words = text.lower().split()
    import xxhash

    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(len(words) - 4)]
    wide = 0
    for k in range(4):
        if k:
            values = [(h ^ (h >> (29 + k))) * simhash.MIX[k] % (1 << 64) for h in hashes]
            values = [v ^ (v >> 32) for v in values]
        else:
            values = hashes
        wide |= sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)) << (64 * k)
    assert int.from_bytes(simhash.fingerprint(text, 5, 256).tobytes(), "little") == wide
