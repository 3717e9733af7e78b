"""Toxicity: bags of subword embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import small_batches, table, whole_text, written

#: Lengths of character n-grams, a word's two ends counted as characters; log2 of the rows of the embedding table, and its width.
GRAMS, BITS, WIDTH = (3, 4, 5), 18, 4
#: The training sample: documents of each class at most, and distinct subwords of all of them together.
SAMPLE, SUBWORDS = 1500, 5_000_000
#: Passes over the sample, documents of a step, documents that a subword must be in; step sizes and dampers of the table, the weights and the biases.
EPOCHS, BATCH, SEEN = 25, 64, 3
RATES, DAMPERS = (10.0, 0.02, 0.02), (1e-4, 1e-4, 1e-4)
#: Code points that are worked on at once, and of a word; a longer word counts as several.
PIECE, WORD = 1 << 17, 1 << 12
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(WORD + 2, _BASE))


def _pieces(text: str) -> Iterator[str]:
    """The text's words in lower case with a space before, between and after them, in pieces of bounded size."""
    words, size = [], 0
    for word in text.lower().split():
        for part in (word,) if len(word) <= WORD else (word[i : i + WORD] for i in range(0, len(word), WORD)):
            words.append(part)
            size += len(part) + 1
            if size >= PIECE:
                yield f" {' '.join(words)} "
                words, size = [], 0
    if words:
        yield f" {' '.join(words)} "


def subwords(piece: str) -> tuple[np.ndarray, np.ndarray, int]:
    """``(bucket, word, words)``: the buckets of every word and of its n-grams, each with the number of its word."""
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = codes == 32
    starts = np.flatnonzero(space)[:-1]
    ends = np.cumsum(space)  # spaces up to here; a space belongs to the word after it
    word = ends - 1
    inside = np.arange(len(codes)) - starts[np.minimum(word, len(starts) - 1)]
    whole = np.add.reduceat(np.where(space, np.uint64(0), codes) * _POWERS[np.minimum(inside, WORD + 1)], starts)
    buckets, words = [whole * _SPREAD >> np.uint64(64 - BITS)], [np.arange(len(starts))]
    gram = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        if n > len(codes):
            break
        gram = gram[:-1] * _BASE + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(ends[n - 2 : len(codes) - 1] == ends[: len(codes) - n + 1])  # no space but at the first and the last place
            buckets.append((gram[at] + np.uint64(n)) * _SPREAD >> np.uint64(64 - BITS))
            words.append(word[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(words), len(starts)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, share)`` of a whole text: every word counts alike, and every subword of a word; empty without words."""
    total, n_words = np.zeros(1 << BITS), 0
    for piece in _pieces(text):
        buckets, word, n = subwords(piece)
        total += np.bincount(buckets, (1.0 / np.bincount(word, minlength=n))[word], minlength=1 << BITS)
        n_words += n
    some = np.flatnonzero(total)
    return some, total[some] / max(1, n_words)


@dataclass(frozen=True)
class Softmax:
    """Embeddings of the buckets, weights and biases of the two classes."""

    table: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def margins(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the difference of the two classes, and their biases' difference: the softmax is linear in the mean, so the mean of these is its input."""
        return self.table @ (self.weights[:, 1] - self.weights[:, 0]), float(self.biases[1] - self.biases[0])


def trained(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Softmax | None:
    """Embeddings and softmax, fitted together by steps of bounded size (Adam); both classes weigh the same. None unless both have documents."""
    counts = np.bincount(labels, minlength=2)
    if counts.min() == 0:
        return None
    rng = np.random.default_rng(seed)
    seen = np.zeros(1 << BITS, np.int32)
    for index, _ in bags:
        seen[index] += 1  # a bag names a bucket once
    known = np.flatnonzero(seen >= SEEN)
    row = np.full(1 << BITS, -1, np.int32)
    row[known] = np.arange(len(known))
    bags = [(row[i][row[i] >= 0], w[row[i] >= 0]) for i, w in bags]
    size = len(known)
    params = [rng.normal(0, 0.1, (size, WIDTH)), rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)]
    class_weight = len(labels) / (2.0 * counts)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, EPOCHS * -(-len(bags) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), BATCH):
            docs = [bags[i] for i in order[at : at + BATCH]]
            y = labels[order[at : at + BATCH]]
            index, share = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
            doc = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
            vectors, weights, biases = params
            mean = np.stack([np.bincount(doc, vectors[index, j] * share, minlength=len(docs)) for j in range(WIDTH)], axis=1)
            logits = mean @ weights + biases
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            wrong = (p - np.eye(2)[y]) * class_weight[y][:, None] / len(docs)
            pulled = np.stack([np.bincount(index, share * wrong[doc, k], minlength=size) for k in (0, 1)], axis=1)
            grads = [pulled @ weights.T, (mean.T @ wrong), wrong.sum(axis=0)]
            step += 1
            for x, g, m, v, rate, damper in zip(params, grads, first, second, RATES, DAMPERS):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + damper)
    table = np.zeros((1 << BITS, WIDTH))
    table[known] = params[0]
    return Softmax(table, params[1], params[2])


def score_of(text: str, margins: np.ndarray, bias: float) -> float:
    """The softmax's probability of label 1 for a whole text: its words' mean of their subwords' mean margins, plus the bias (alone without words)."""
    total, n_words = 0.0, 0
    for piece in _pieces(text):
        buckets, word, n = subwords(piece)
        total += float((np.bincount(word, margins[buckets], minlength=n) / np.bincount(word, minlength=n)).sum())
        n_words += n
    return float(1 / (1 + np.exp(-np.clip(total / max(1, n_words) + bias, -700, 700))))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5: never trained on. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Softmax | None:
    """Fits on at most ``sample`` labelled documents of each class that are not held out, those whose ids have the least hashes, and whole texts of them.

    Labels other than 0 and 1 are ignored, of several the largest counts; of rows that repeat an id the least text. The driver gets the sample's bags, in the order of the hashes until
    they have ``SUBWORDS`` entries together.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("id is not null")
    known = df.select(F.col(f"`{id_col}`").cast("long").alias("id")).where(~held_out("id")).distinct()
    marks = written(known.join(marks, "id").withColumn("place", F.xxhash64("id")))
    chosen = [marks.where(F.col("label") == k).orderBy("place", "id").limit(sample) for k in (0, 1)]
    chosen = written(chosen[0].unionByName(chosen[1]))
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), "id")  # 2 * sample ids at most
    texts = texts.groupBy("id", "label", "place").agg(F.min("text").alias("text"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t) for t in batch.column(3).to_pylist()]
            columns = [pa.array([len(b[0]) for b in bags], pa.int64()), pa.array([b[0].astype(np.int32).tobytes() for b in bags], pa.binary()), pa.array([b[1].astype(np.float32).tobytes() for b in bags], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["id", "label", "place", "size", "buckets", "shares"])

    bags = written(small_batches(texts.select("id", "label", "place", "text"), 256).mapInArrow(of_batches, "id long, label int, place long, size long, buckets binary, shares binary"))
    used, ids = 0, []
    for r in sorted(bags.select("place", "id", "size").collect()):
        used += r["size"]
        if ids and used > SUBWORDS:
            break
        ids.append(r["id"])
    place = {i: n for n, i in enumerate(ids)}
    sample = {}
    for r in bags.where(F.col("id").isin(ids)).select("id", "label", "buckets", "shares").toLocalIterator() if ids else ():  # a part of the sample at a time
        sample[place[r["id"]]] = (np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"])
    ordered = [sample[n] for n in sorted(sample)]
    return trained([x[:2] for x in ordered], np.array([x[2] for x in ordered], np.int64))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row of ``df``.

    Null and empty texts have the score of the bias alone, long texts are scored whole, equal texts equally, every row of a repeated id gives a row. Without labels of both classes all
    scores are 0. Columns besides id and text are never read.
    """
    model = fit(df, labels, id_col, text_col)
    margins, bias = (None, 0.0) if model is None else model.margins()
    margins = None if margins is None else margins.astype(np.float32)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [0.0 if margins is None else score_of(t, margins, bias) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text"))
    found = small_batches(rows).mapInArrow(of_batches, "id long, score double")
    return found.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; see :func:`toxicity` for nulls, empty texts and repeats."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
