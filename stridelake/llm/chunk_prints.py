"""Document fingerprints: content-defined chunks by a normalised gear hash, digest sets weighted by length, containment."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import id_bounds, id_of, is_null, order_id, ranges_of, shuffle_parts, small_batches, table, whole_text

#: Bytes of a chunk at least, before boundaries get easier, and at most (a length is one byte of an entry).
LEAST, NORMAL, MOST = 24, 96, 255
#: Top bits of the gear hash that are zero at a boundary before and after NORMAL bytes.
STRICT, EASY = 8, 6
#: Bytes that the hash of a place depends on: 32 shifts push older ones out of 32 bits.
WINDOW = 32
#: One entry of a fingerprint: so many bytes of the chunk's digest, then one with its length.
DIGEST = 4


def _gear() -> np.ndarray:
    """256 pseudo-random 32-bit numbers, from SHA-256 of the byte value."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each place the sum of GEAR of the bytes before it, each shifted by its distance, in 32 bits; sums of 2, 4, ... places by doubling."""
    out = GEAR[data]
    width = 1
    while width < WINDOW:
        older = out[:-width] << np.uint32(width)
        out = out.copy()
        out[width:] += older
        width *= 2
    return out


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks: the first place after LEAST bytes whose hash has STRICT zero bits, or after NORMAL bytes EASY ones, MOST bytes at most."""
    n = len(data)
    if not n:
        return []
    hashes = gear_hash(np.frombuffer(data, np.uint8))
    easy_at = np.flatnonzero(hashes >> np.uint32(32 - EASY) == 0)
    strict = (hashes[easy_at] >> np.uint32(32 - STRICT) == 0).tolist()
    places = (easy_at + 1).tolist()
    ends, start = [], 0
    for end, is_strict in zip(places, strict):
        while end - start > MOST:
            start += MOST
            ends.append(start)
        length = end - start
        if length >= NORMAL or is_strict and length >= LEAST:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def print_of(text: str) -> str:
    """The fingerprint: an entry for every chunk, repeats included, sorted and in base 64, so that equal texts have equal strings."""
    data, start, out, digest = text.encode(), 0, [], xxhash.xxh3_64_digest
    for end in chunk_ends(data):
        out.append(digest(data[start:end])[:DIGEST] + bytes([end - start]))
        start = end
    return base64.urlsafe_b64encode(b"".join(sorted(out))).decode()


def entries(fingerprint: str) -> list[bytes]:
    data = base64.urlsafe_b64decode(fingerprint)
    return [data[at : at + DIGEST + 1] for at in range(0, len(data), DIGEST + 1)]


def containment(fingerprint: str, other: str) -> float:
    """The share of the bytes behind ``fingerprint`` that lie in chunks the other has too, from the two strings alone; equal ones give 1, an empty one else 0."""
    if fingerprint == other:
        return 1.0
    own, known = entries(fingerprint), set(entries(other))
    total = sum(e[DIGEST] for e in own)
    return sum(e[DIGEST] for e in own if e in known) / total if total else 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points is replaced by as many from the begin of the following text, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def next_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(part, id, none, tie, packed, own)`` dealt into ranges of descending id and sorted, each range with the row that follows it.

    A row's next is the row of the next smaller id (rows of one id follow each other by a hash of the text; null ids come first); after the last comes the first.
    Ranges are cut from a scan of the ids; a second scan gives the first row of each, which goes to the range before too (``own`` false). An id
    of many rows has as many ranges as it needs. Texts are shuffled once, compressed.
    """
    text = whole_text(text_col)
    rows = df.select(order_id(id_col).alias("id"), is_null(id_col).alias("none"), F.xxhash64(text).alias("tie"), text.alias("text"))
    bounds = id_bounds(rows, "id", shuffle_parts(df))

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        ids, none, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        return ids, none, ties, ranges_of(ids, none, ties, bounds)

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, bool, int]] = {}
        for batch in batches:
            ids, none, ties, parts = places(batch)
            order = np.lexsort((ties, none, ids, parts))
            last = order[np.flatnonzero(np.r_[parts[order][1:] != parts[order][:-1], True])] if len(order) else order
            for p, *row in zip(parts[last].tolist(), ids[last].tolist(), none[last].tolist(), ties[last].tolist()):
                found[p] = max(tuple(row), found.get(p, tuple(row)))
        kinds = (pa.int64(), pa.bool_(), pa.int64())
        columns = [pa.array([r[k] for r in found.values()], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *columns], names=["p", "id", "none", "tie"])

    own_first = rows.select("id", "none", "tie").mapInArrow(first_rows, "p int, id long, none boolean, tie long")
    tops = {r["p"]: tuple(r["t"]) for r in own_first.groupBy("p").agg(F.max(F.struct("id", "none", "tie")).alias("t")).collect()}  # one row for each range
    order = sorted(tops, reverse=True)
    before = {part: order[i - 1] for i, part in enumerate(order)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, none, ties, parts = (x.tolist() for x in places(part))
                dealt: list[tuple[int, int, bool, int, bytes, bool]] = []
                for i, null, tie, p, text in zip(ids, none, ties, parts, part.column(3).to_pylist()):
                    data = zlib.compress(text.encode(), 1)
                    dealt.append((p, i, null, tie, data, True))
                    if (i, null, tie) == tops[p]:
                        dealt.append((before[p], i, null, tie, data, False))
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in dealt], kind) for k, kind in enumerate(kinds)], names=["part", "id", "none", "tie", "packed", "own"])

    dealt = small_batches(rows).mapInArrow(pack, "part int, id long, none boolean, tie long, packed binary, own boolean")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.desc("own"), F.desc("id"), F.desc("none"), F.desc("tie"), "packed")


def fingerprint_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprint of the text, of the edited text, and the :func:`containment` of the first in the edited and in the next text's.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. Null texts are empty; an empty text has the
    empty fingerprint. The next row is the one of :func:`next_documents`; a table of one row follows itself.
    Rows of one id are ordered by a hash of their text. Long texts are chunked whole.
    """
    schema = "id long, none boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[int, bool, str, str]]:
            """The range's own rows, then the first of the rows that follow it."""
            for batch in batches:
                for i, none, data, own in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4, 5))):
                    text = zlib.decompress(data).decode()
                    yield i, none, text, print_of(text)
                    if not own:
                        return

        out: list[tuple] = []
        previous = None
        for this in documents():
            if previous is not None:
                doc, none, text, own_print = previous
                following, next_print = this[2:]
                new = edited(text, following)
                new_print = own_print if new == text else print_of(new)
                sha = hashlib.sha256(new.encode()).hexdigest()
                out.append((doc, none, len(text), sha, own_print, new_print, containment(own_print, new_print), containment(own_print, next_print)))
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            previous = this
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return next_documents(df, id_col, text_col).mapInArrow(of_partition, schema).withColumn("id", id_of("id", "none")).drop("none")


def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text with their likeness; see :func:`fingerprint_pairs` for nulls, empty texts and ties."""
    return fingerprint_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
