"""Substring dedup: digests of lines and of word windows, grouped globally; the earliest occurrence stays, offsets of the rest are kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import NULL_ID, Recent, id_of, is_null, order_id, small_batches, table, whole_text, written

WORD = re.compile(r"[^\W_]+")
LINE = re.compile(r"\n\s*")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
#: What goes with the word before a cut.
TAIL = re.compile(r"[^\w\s]*\s*")
#: Words that a repeated unit has at least; shorter ones are common phrases.
MIN_WORDS = 25
#: Of so many windows that follow each other, one is chosen at least.
SPREAD = 16
#: Multipliers of the polynomial hashes of runs of words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Units(NamedTuple):
    """Units of a text by place: offsets in code points (ends take in the separator), 96-bit digests, whether the text has it before."""

    begins: np.ndarray
    ends: np.ndarray
    high: np.ndarray  # long
    low: np.ndarray  # int
    again: np.ndarray


def _runs(values: np.ndarray, base: int, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` values, put together from runs of powers of two."""
    out, length = None, 0
    power, width = values, 1
    while size:
        if size & 1:
            if out is None:
                out, length = power, width
            else:
                n = len(values) - length - width + 1
                out = out[:n] * np.uint64(pow(base, width, 1 << 64)) + power[length : length + n]
                length += width
        size >>= 1
        if size:
            power = power[: len(power) - width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
            width *= 2
    return out


def chosen(hashes: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Places whose hash is the least of some ``spread`` neighbours (of all, if there are fewer).

    The choice depends on the neighbours alone, so equal passages of ``spread`` windows choose an equal one wherever they stand.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    spread = min(spread, len(hashes))
    least, width = hashes, 1
    while width < spread:
        step = min(width, spread - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    # The greatest of the minima around a place is its own hash where that is one of the minima.
    pad = np.zeros(spread - 1, np.uint64)
    most, width = np.concatenate([pad, least, pad]), 1
    while width < spread:
        step = min(width, spread - width)
        most = np.maximum(most[: len(most) - step], most[step:])
        width += step
    return np.flatnonzero(most == hashes)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """For every code point whether words may have it; surrogates, which no text has, may not."""
    out = np.zeros(0x110000, bool)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        for m in WORD.finditer("".join(map(chr, range(lo, hi)))):
            out[lo + m.start() : lo + m.end()] = True
    return out


def word_spans(text: str) -> np.ndarray:
    """(n, 2) begins and ends of the words, in code points: the edges of what the pattern of words matches."""
    inside = _in_words()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    return np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)


def units(text: str, hashed: dict[str, int], kind: str = "all", min_words: int = MIN_WORDS) -> Units:
    """Lines (or paragraphs) of ``min_words`` words or more, and for ``all`` the chosen windows of so many words, which may cross lines.

    Words are runs of letters and digits, compared in lower case.
    """
    words = WORD.findall(text)
    if len(words) < min_words:
        none = np.zeros(0, np.int64)
        return Units(none, none, none, none.astype(np.int32), none.astype(bool))
    spans = word_spans(text)
    values = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    others = (values ^ (values >> np.uint64(31))) * np.uint64(BASES[1])
    begins, ends, high, low = [], [], [], []
    cuts = [m.end() for m in (PARAGRAPH if kind == "paragraph" else LINE).finditer(text)]
    edges = [0, *cuts, len(text)]
    firsts = np.searchsorted(spans[:, 0], edges).tolist()
    for b, e, first, last in zip(edges, edges[1:], firsts, firsts[1:]):
        if last - first >= min_words:
            begins.append(b), ends.append(e)
            for out, kept, base in ((high, values, BASES[0]), (low, others, BASES[1])):
                out.append(int(_runs(kept[first:last], base, last - first)[0]) ^ last - first)
    if kind == "all":
        windows = _runs(values, BASES[0], min_words)
        places = chosen(windows)
        nexts = np.append(spans[1:, 0], len(text))
        closing = places + min_words - 1
        begins += spans[places, 0].tolist()
        ends += [TAIL.match(text, e, n).end() for e, n in zip(spans[closing, 1].tolist(), nexts[closing].tolist())]
        high += windows[places].tolist()
        low += _runs(others, BASES[1], min_words)[places].tolist()
    order = np.lexsort((ends, begins))
    b, e = np.array(begins, np.int64)[order], np.array(ends, np.int64)[order]
    h1, h2 = np.array(high, np.uint64)[order].view(np.int64), (np.array(low, np.uint64)[order] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    again = np.zeros(len(h1), bool)
    if len(set(high)) < len(high):  # some unit is in the text twice
        closed: dict[tuple[int, int], int] = {}
        again[:] = [b0 >= closed.setdefault(key, e0) for key, b0, e0 in zip(zip(h1.tolist(), h2.tolist()), b.tolist(), e.tolist())]
    return Units(b, e, h1, h2, again)


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.lower())


def unit_table(df: DataFrame, id_col: str, text_col: str, kind: str, min_words: int) -> DataFrame:
    """``(id, none, row, begin, end, h1, h2, again)`` per unit; ``none`` marks a null id, ``row`` tells rows of one id apart by their text."""
    schema = "id long, none boolean, row int, begin int, end int, h1 long, h2 int, again boolean"
    names = [f.split()[0] for f in schema.split(", ")]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Recent(_word_hash)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [units(t, hashed, kind, min_words) for t in part.column(3).to_pylist()]
                counts = pa.array(np.repeat(np.arange(part.num_rows), [len(u.begins) for u in found]))
                columns = [part.column(i).take(counts) for i in range(3)]
                columns += [pa.array(np.concatenate([u[i] for u in found]), k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(order_id(id_col).alias("id"), is_null(id_col).alias("none"), _row(text_col).alias("row"), whole_text(text_col).alias("text"))
    return small_batches(rows).mapInArrow(of_batches, schema)


def _row(text_col: str) -> Column:
    return F.xxhash64(whole_text(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "all", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, row, begin, end, kept_id)``: the parts of a text that an earlier place has too, as disjoint spans in order of code points.

    Units are lines (``kind`` line or paragraph: nothing else) of at least ``min_words`` words, and windows of so many words wherever they
    begin. Of ``SPREAD`` windows side by side one at least is chosen by its hash, so a passage of ``min_words + SPREAD - 1`` words that
    stands in two documents always shares a chosen window; what a span misses of it is fewer than ``SPREAD`` words at either end, and
    nothing if the passage is a line. The smallest id keeps a unit, its other holders lose it; in one document the first place keeps it,
    and a window that overlaps that place is no repeat. ``kept_id`` is the smallest id that keeps a unit of the span.

    Null and empty texts and those of fewer words have no units. A null id is one more document after all others; rows that repeat an id are
    one document, which keeps what only its own rows share. Long texts yield units in proportion to their length.

    Digests (96 bits) are pre-aggregated to their least and greatest id; the shared ones are a written table, so that its join with the units has
    exchanges of its own on both sides and adaptive execution can split a digest of a third of all units. Spans are merged within a document.
    """
    found = written(unit_table(df, id_col, text_col, kind, min_words))
    shared = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("none").alias("first_none"))
    shared = written(shared.where("first < last").drop("last"))
    across = found.join(shared, ["h1", "h2"]).where("id > first").select("id", "none", "row", "begin", "end", "first", "first_none")
    within = found.where("again").select("id", "none", "row", "begin", "end", F.col("id").alias("first"), F.col("none").alias("first_none"))
    by = ["id", "none", "row"]
    own = Window.partitionBy(*by).orderBy("begin", "end")
    lost = across.unionByName(within)
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = lost.withColumn("fresh", F.coalesce(F.col("begin") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.min(F.struct("first", "first_none")).alias("kept")
    spans = runs.groupBy(*by, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), kept)
    return spans.select(id_of("id", "none").alias("id"), "row", "begin", "end", id_of("kept.first", "kept.first_none").alias("kept_id"))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "all", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with its repeated passages cut out of the text and ``removed``, the array of their (begin, end) in the original text, added.

    A column named ``removed`` is replaced; all others stay as they are.
    """
    spans = repeated_passages(df, id_col, text_col, kind, min_words)
    per_row = spans.groupBy(F.coalesce("id", F.lit(NULL_ID)).alias("__ps_id"), F.col("id").isNull().alias("__ps_none"), F.col("row").alias("__ps_row")).agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("removed")
    )
    rows = df.drop("removed").withColumns({"__ps_id": order_id(id_col), "__ps_none": is_null(id_col), "__ps_row": _row(text_col)})
    text = whole_text(text_col)
    out = rows.join(per_row, ["__ps_id", "__ps_none", "__ps_row"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<begin:int,end:int>>")))
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    ends = F.concat(F.transform("removed", lambda s: s["begin"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(begins, ends, lambda b, e: F.substring(text, b + 1, e - b)), "")
    return out.withColumn(text_col, F.when(F.size("removed") == 0, F.col(f"`{text_col}`")).otherwise(kept)).drop("__ps_id", "__ps_none", "__ps_row")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated span of every document: ``(doc_id, start, end, n_chars, kept_doc_id)``; see :func:`repeated_passages` for nulls, ties and repeats."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("begin").alias("start"), "end", (F.col("end") - F.col("begin")).cast("long").alias("n_chars"), F.col("kept_id").alias("kept_doc_id"))
