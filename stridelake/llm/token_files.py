"""Token ids in binary files: one zstandard dictionary, one frame per document, an index of offsets."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from re import compile as pattern
from re import escape

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import Recent, id_bounds, is_null, order_id, ranges_of, shared_dir, small_batches, table, shuffle_parts, whole_text, written

MAGIC = b"SLTOKENS"
#: magic, format version, number of documents, ids in the file, length of all frames, sha256 of the dictionary
HEADER = struct.Struct("<8sIQQQ32s")
#: document id, whether it is null, first id of the document in its file, number of ids, offset of the frame, length of the frame
ENTRY = np.dtype([("doc_id", "<i8"), ("none", "u1"), ("start", "<u8"), ("n_ids", "<u8"), ("offset", "<u8"), ("length", "<u8")])
#: A file is closed once its frames have this many bytes.
FILE_BYTES = 32 << 20
#: The dictionary is trained on so many documents at most, and on so many bytes of ids of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 8192, 64 << 10
#: Distinct pieces of one generation whose ids a worker remembers, and the longest piece that is remembered.
REMEMBERED, LONGEST = 300_000, 48
LEVEL = 3

# The tokenizer's pattern never goes on from other text into white space, so chunks (white space and the run after it) are encoded
# apart. Of a chunk that is a word of Latin letters, perhaps with a space before, and punctuation, both are units of the pattern.
# \x1c-\x1f are white space for Python alone: texts with them are encoded whole.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]"
_pieces = pattern(rf" ?{_LETTERS}(?={_MARKS}*(?:\s|\Z))|{_MARKS}+(?=\s|\Z)|\s*\S+|\s+").findall
_unit = pattern(rf" ?{_LETTERS}|{_MARKS}+").fullmatch
_UNSURE = pattern("[\x1c-\x1f]").search


class IdEncoder:
    """Ids of whole texts as the tokenizer gives them without added special ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        first = self.tokenizer.pre_tokenizer
        self.parts = type(first).__name__ == "ByteLevel" and not first.add_prefix_space and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.special_in = pattern("|".join(map(escape, self.special)) or r"(?!)").search
        self.known = Recent(self._piece, REMEMBERED, LONGEST)
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level alphabet: other bytes follow from U+0100
        self.alphabet = dict(zip([b for b in range(256) if b not in shown], range(0x100, 0x200)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Units go to the tokenizer's merges at once, all else through its pattern."""
        if not _unit(piece):
            return self._whole(piece)
        mapped = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = [self.packed[t.id] for t in self.model.tokenize(mapped)]
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def encode(self, text: str) -> bytes:
        if not self.parts or self.special_in(text) or _UNSURE(text):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, _pieces(text)))


@lru_cache(maxsize=4)
def id_encoder(path: str) -> IdEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
    return IdEncoder(path)


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def write_file(uri: str, dictionary: bytes, entries: np.ndarray, frames: bytes) -> None:
    """Header, index, frames. The name is new at every attempt of a task, so a lost attempt leaves a file that no manifest names."""
    header = HEADER.pack(MAGIC, 2, len(entries), int(entries["n_ids"].sum()), len(frames), hashlib.sha256(dictionary).digest())
    fs, path = _files(uri)
    with fs.open_output_stream(path) as out:
        out.write(header)
        out.write(entries.tobytes())
        out.write(frames)


class TokenFile:
    """Reads a file: the index at once, a document's frame by its offset."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _files(uri)
        self.file = fs.open_input_file(path)
        magic, version, n, self.n_ids, _, digest = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC or version != 2:
            raise ValueError(f"{uri} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.entries = np.frombuffer(self.file.read(n * ENTRY.itemsize), ENTRY)
        self.base = HEADER.size + n * ENTRY.itemsize
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document, as little-endian unsigned 32-bit integers."""
        entry = self.entries[k]
        self.file.seek(self.base + int(entry["offset"]))
        return self.unpack(self.file.read(int(entry["length"])), max_output_size=4 * int(entry["n_ids"]))

    def frames(self) -> bytes:
        self.file.seek(self.base)
        return self.file.read()

    def close(self) -> None:
        self.file.close()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary for serialised id arrays; empty if there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def spread_ids(ids: bytes) -> bytes:
    """``ids`` if they are at most ``SAMPLE_BYTES``, else eight runs of ids at even distances from the first to the last, so many bytes together."""
    if len(ids) <= SAMPLE_BYTES:
        return ids
    run = SAMPLE_BYTES // 8
    return b"".join(ids[at : at + run] for at in ((len(ids) - run) * i // 7 // 4 * 4 for i in range(8)))


def sample_ids(df: DataFrame, tokenizer: str, end_id: int) -> list[bytes]:
    """Ids, from the whole of long texts, of at most ``SAMPLE_DOCS`` documents, those of the least id hashes: bounded for any table."""
    hashed = df.select(F.xxhash64("id").alias("h"))
    last = hashed.orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer)
        for batch in batches:
            some = [spread_ids(encoder.encode(t) + struct.pack("<I", end_id)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(some, pa.binary())], names=["h", "ids"])

    chosen = df.select(F.xxhash64("id").alias("h"), "text").where(F.col("h") <= last)
    found = chosen.mapInArrow(of_batches, "h long, ids binary").orderBy("h", "ids").limit(SAMPLE_DOCS).collect()
    return [bytes(r["ids"]) for r in found]


def write_token_files(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> tuple[DataFrame, bytes]:
    """Encodes every whole text, appends ``end_id`` and writes ids in ascending id order; returns the manifest and the dictionary.

    Null texts are empty (the end id alone); a null id is one more document after all others; rows that repeat an id
    stand beside each other by a hash of the text, over as many ranges as they need. The manifest ``(part, file, uri, n_docs, n_ids, start)`` has files in document order with the number
    of ids before each; it names files of finished tasks only. Ids are compressed where they are made, so the
    one shuffle (by ranges of the id, cut from a scan of that column alone) moves frames, not texts.
    """
    text = whole_text(text_col)
    rows = df.select(order_id(id_col).alias("id"), is_null(id_col).alias("none"), F.xxhash64(text).alias("tie"), text.alias("text"))
    dictionary = train_dictionary(sample_ids(rows, tokenizer, end_id))
    parts = shuffle_parts(df)
    bounds = id_bounds(rows, "id", parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compress = id_encoder(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)).compress
        end = struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(t) + end for t in part.column(3).to_pylist()]
                range_ = pa.array(ranges_of(*(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)), bounds))
                made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(list(map(compress, ids)), pa.binary())]
                yield pa.RecordBatch.from_arrays([range_, *(part.column(i) for i in range(3)), *made], names=["range", "id", "none", "tie", "n_ids", "frame"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        entries: list[tuple[int, bool, int, int, int, int]] = []
        frames: list[bytes] = []
        size = start = 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{part:06d}-{number:05d}-{uuid.uuid4().hex}.ids"
            index = np.array(entries, ENTRY)
            write_file(uri, dictionary, index, b"".join(frames))
            values = [[part], [number], [uri], [len(index)], [int(index["n_ids"].sum())]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["part", "file", "uri", "n_docs", "n_ids"])

        for batch in batches:
            for doc, none, n, frame in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5))):
                entries.append((doc, none, start, n, size, len(frame)))
                frames.append(frame)
                size, start = size + len(frame), start + n
                if size >= FILE_BYTES:
                    yield close()
                    entries, frames, size, start, number = [], [], 0, 0, number + 1
        if entries:
            yield close()

    fs, path = _files(folder)
    fs.create_dir(path, recursive=True)
    packed = small_batches(rows).mapInArrow(pack, "range int, id long, none boolean, tie long, n_ids long, frame binary")
    ranged = packed.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("id", "none", "tie", "frame")
    files = written(ranged.mapInArrow(store, "part long, file long, uri string, n_docs long, n_ids long"))
    # One row for each file of up to 32 MB; summed per part first, so a single task only orders the parts.
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = per_part.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = files.withColumn("inside", inside).join(before, "part")
    return written(manifest.select("part", "file", "uri", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("start"))), dictionary


def read_token_files(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document in the files: each frame is read by the index and unpacked."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(uri, dictionary)
                entries, frames = file.entries, memoryview(file.frames())
                crcs = np.empty(len(entries), np.int64)
                for k, (offset, length, n) in enumerate(zip(entries["offset"].tolist(), entries["length"].tolist(), entries["n_ids"].tolist())):
                    crcs[k] = zlib.crc32(file.unpack(frames[offset : offset + length], max_output_size=4 * n))
                file.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(entries["doc_id"].astype("i8"), mask=entries["none"].astype(bool)), pa.array(entries["start"].astype("i8") + first), pa.array(entries["n_ids"].astype("i8")), pa.array(crcs)],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    named = manifest.select("uri", "start")
    spread = named.repartition(shuffle_parts(manifest), "uri")
    return spread.mapInArrow(of_batches, "id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document as its files hold it; see :func:`write_token_files` for nulls, empty texts and repeats."""
    folder = _uri(f"{shared_dir(spark)}-tokens")
    manifest, dictionary = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_token_files(manifest, dictionary).withColumnRenamed("id", "doc_id")
