"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import small_batches, table, whole_text, written

#: Share of the pooled covariance in a class covariance, and of the diagonal in both.
TOWARDS_POOLED, TOWARDS_DIAGONAL = 0.5, 0.01
_KIND = np.zeros(256, np.int64)  # of a byte: 0 other ASCII mark, 1 lower, 2 upper, 3 digit, 4 white space, 5 . and ,  6 beyond ASCII, 7 control
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 6 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t\n\x0b\x0c\r" else 5 if _c in ".," else 7 if _b < 32 or _b == 127 else 0
_LINE_ENDS = (".", "!", "?", ":", '"', "'", ")", "…")

NAMES = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "marks", "lower", "upper", "digits", "spaces", "stops", "beyond",
    "control", "distinct_words", "commonest_word", "shouted_words", "capital_words", "marked_words", "bare_words", "single_letters", "repeated_pairs",
    "repeated_lines", "ended_lines", "short_lines", "words_a_line", "log_stop_gap",
)


def _logit(share: float, n: float) -> float:
    """Log odds of a share of n, moved half a case inwards."""
    hits = share * n
    return float(np.log((hits + 0.5) / (n - hits + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text: logarithms of counts, log odds of shares. Empty texts have those of zero counts."""
    data = text.encode()
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=8)
    words, lines = text.split(), text.split("\n")
    n, n_words, n_lines = max(1, len(data)), max(1, len(words)), len(lines)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    folded = [w.lower() for w in words]
    seen = set(folded)
    pairs = set(zip(folded, folded[1:]))
    counts: dict[str, int] = {}
    for w in folded:
        counts[w] = counts.get(w, 0) + 1
    bare = sum(map(str.isalpha, words))
    letters_inside = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?" or not w[0].isalnum() and w[0] not in "\"'(")
    shouted = sum(1 for w in words if w.isupper() and len(w) > 1)
    full = [x for x in (line.strip() for line in lines) if x]
    ended = sum(x.endswith(_LINE_ENDS) for x in full)
    short = sum(1 for x in full if len(x) < 30)
    log = np.log1p
    return [
        float(log(len(data))), float(log(len(words))), float(log(n_lines)), float(np.log(lengths.mean() + 0.5)), float(log(lengths.std())),
        *(_logit(float(kinds[k]) / n, n) for k in (0, 1, 2, 3, 4, 5, 6, 7)),
        _logit(len(seen) / n_words, n_words), _logit(max(counts.values(), default=0) / n_words, n_words), _logit(shouted / n_words, n_words),
        _logit(sum(1 for w in words if w[0].isupper()) / n_words, n_words), _logit(letters_inside / n_words, n_words), _logit(bare / n_words, n_words),
        _logit(sum(1 for w in words if len(w) == 1) / n_words, n_words), _logit(1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0, n_words),
        _logit(1 - len(set(full)) / max(1, len(full)), n_lines), _logit(ended / max(1, len(full)), n_lines), _logit(short / max(1, len(full)), n_lines),
        float(log(len(words) / max(1, len(full)))), float(log(len(words) / (1 + text.count(".")))),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): log prior, mean, inverse Cholesky factor of the shrunk covariance and its log determinant, made once."""

    log_priors: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    log_roots: tuple[float, float]

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Logistic of the difference of log densities divided by the number of statistics, so that scores of clear cases still differ.

        The division keeps the order and the side of 0.5; such a score is no probability.
        """
        logs = []
        for k in (0, 1):
            whitened = (stats - self.means[k]) @ self.factors[k].T
            logs.append(self.log_priors[k] - self.log_roots[k] - 0.5 * np.einsum("ij,ij->i", whitened, whitened))
        margin = (logs[1] - logs[0]) / stats.shape[1]
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float = TOWARDS_POOLED, diagonal: float = TOWARDS_DIAGONAL) -> Discriminant | None:
    """From count, sum and sum of products of each class; None unless both have rows."""
    if any(moments.get(k, (0,))[0] == 0 for k in (0, 1)):
        return None
    counts = [moments[k][0] for k in (0, 1)]
    means = [moments[k][1] / moments[k][0] for k in (0, 1)]
    own = [moments[k][2] / moments[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
    both = (counts[0] * own[0] + counts[1] * own[1]) / sum(counts)
    target = np.diag(np.maximum(np.diag(both), 1e-6))
    factors, roots = [], []
    for k in (0, 1):
        shrunk = (1 - diagonal) * ((1 - pooled) * own[k] + pooled * both) + diagonal * target
        lower = np.linalg.cholesky((shrunk + shrunk.T) / 2 + 1e-9 * np.eye(len(target)))
        factors.append(np.linalg.inv(lower))
        roots.append(float(np.log(np.diag(lower)).sum()))
    priors = tuple(float(np.log(c / sum(counts))) for c in counts)
    return Discriminant(priors, np.array(means), np.array(factors), tuple(roots))


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, stats)`` per row, written once: ``row`` is a hash of the text, stats the numbers of :data:`NAMES`."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                stats = pa.array([statistics(t) for t in part.column(2).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), stats], names=["id", "row", "stats"])

    text = whole_text(text_col)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    return written(small_batches(rows).mapInArrow(of_batches, "id long, row long, stats array<double>"))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3: never trained on. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | None:
    """Fits on all labelled rows that are not held out. Labels other than 0 and 1 are ignored, of several the largest counts.

    A task returns one row of sums per class, however many rows it reads; a second step adds these up in eight tasks, so the driver gets a fixed number of small
    matrices at any size. Repeated rows count each.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = stats.where(~held_out("id")).join(marks, "id").select("label", "stats")
    width = len(NAMES)

    def sent(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """One row per class: the count, the sums and the sums of products."""
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["label", "sums"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                key = batch.column(0).to_numpy()
                for k in (0, 1):
                    if len(v := x[key == k]):
                        sums[k] = sums.get(k, 0.0) + np.r_[len(v), v.sum(axis=0), (v.T @ v).ravel()]
        yield from sent(sums)

    def of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0.0) + row.values.to_numpy()
        yield from sent(sums)

    schema = "label int, sums array<double>"
    partial = rows.mapInArrow(of_rows, schema).repartition(8).mapInArrow(of_sums, schema).collect()  # 16 rows at most
    moments: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in sorted(partial, key=lambda r: (r["label"], r["sums"])):
        n, sums = int(r["sums"][0]), np.array(r["sums"][1:])
        old = moments.get(r["label"], (0, np.zeros(width), np.zeros((width, width))))
        moments[r["label"]] = old[0] + n, old[1] + sums[:width], old[2] + sums[width:].reshape(width, width)
    return discriminant(moments)


def scored(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """``(id, row, score)``. Without a model (no rows of one of the classes) every score is 0.5."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            score = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["id", "row", "score"])

    return stats.mapInArrow(of_batches, "id long, row long, score double")


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, held_out, score, predicted)`` for every row of ``df``: null and empty texts are scored like others, repeated rows each."""
    stats = document_statistics(df, id_col, text_col)
    out = scored(stats, fit(stats, labels))
    return out.select("id", "row", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are predicted to be of label 1, as they are.

    The model is fitted on the statistics of rows that may be trained on; then each row is scored where it is read, so texts are not shuffled. Null and empty texts
    are scored by the statistics of no words, long ones whole, equal rows equally; without a model all stay.
    """
    trained = df.where(~held_out(f"`{id_col}`"))
    model = fit(document_statistics(trained, id_col, text_col), labels)
    at = df.columns.index(text_col)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                yield batch
            elif batch.num_rows:
                stats = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(stats) >= 0.5))

    return small_batches(df).mapInArrow(of_batches, df.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; see :func:`classify` for nulls, empty texts and repeats."""
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
