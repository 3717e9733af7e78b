"""SentencePiece encoding and decoding with spans: normalisation through the compiled character map, BPE merges, byte fallback."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import Recent, small_batches, table, whole_text

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Rows that a worker encodes before it returns them, chunks of one generation whose ids it remembers, and the longest one that is remembered.
ROWS, REMEMBERED, LONGEST = 512, 400_000, 48
#: Characters of a chunk up to which pairs are scanned anew after each merge; longer chunks use a queue.
SCANNED = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one serialised protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift += 7
            at += 1
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: a double array of prefixes and, for each, the text that replaces it."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""
        self.empty = not self.units

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[at:]`` in the map and its replacement."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, place = found
        return length, self.texts[place : self.texts.index(b"\0", place)]


class Encoded(NamedTuple):
    ids: np.ndarray  # with the begin and end id
    begins: np.ndarray  # byte offsets in the original UTF-8 text, one per id; begin and end ids are empty spans
    ends: np.ndarray


class PieceModel:
    """A BPE model file: vocabulary, normaliser and the encoder over both."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models without user-defined or unused pieces and without suffix spaces are supported")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.space = SPACE if self.escape else " "
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        special = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == CONTROL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.begin, self.end = special.get(trainer.get(78, b"<s>").decode(), special.get("<s>", -1)), special.get("</s>", -1)
        widths = {BYTE: lambda p: 1, CONTROL: lambda p: 0}
        self.lengths = np.array([widths.get(k, lambda p: len(p.encode()))(p) for p, k in zip(self.pieces, self.kinds)], np.int64)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        fallback = bool(trainer.get(35, 0)) and len(self.byte_ids) == 256
        self.fallback = self.byte_ids if fallback else None
        if not self.fallback:
            raise ValueError("only models with byte fallback are supported")
        # No piece goes on past a word's end or has a line feed, so merges stay within such chunks.
        inner = re.compile(f"[^{self.space}]{self.space}|\n")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)  # for decoding
        self.whole = any(inner.search(p) for p in self.ids)
        self.chunks = re.compile(f"\n|{self.space}+[^{self.space}\n]*|[^{self.space}\n]+").findall
        self.costs = {p: -self.scores[i] for p, i in self.ids.items()}
        self.known = Recent(self._chunk_ids, REMEMBERED, LONGEST)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the original byte offset of each of its bytes and of its end.

        The longest prefix in the character map is replaced at each place, else one character is taken as it is. A map
        without entries leaves only spaces to escape, which whole arrays do.
        """
        if self.map.empty and not self.squeeze:
            source = np.frombuffer(text.encode(), np.uint8)
            mark = len(self.space.encode())
            origin = np.repeat(np.arange(len(source), dtype=np.int32), np.where(source == 0x20, mark, 1))
            prefix = self.space if self.dummy_prefix and text else ""
            origin = np.concatenate([np.zeros(len(prefix.encode()), np.int32), origin, [len(source)]])
            return prefix + text.replace(" ", self.space), origin
        data = text.encode()
        out, origin, at = bytearray(), [], 0
        space = self.space.encode()
        units: list[tuple[bytes, int, int]] = []
        while at < len(data):
            hit = None if self.map.empty else self.map.longest(data, at)
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            length, new = hit or (width, data[at : at + width])
            units.append((new, at, at + length))
            at += length
        if self.squeeze:
            first = next((i for i, u in enumerate(units) if u[0] != b" "), len(units))
            units = units[first:]
        if self.dummy_prefix and units:
            out += space
            origin += [units[0][1]] * len(space)
        previous_space = self.squeeze
        for new, begin, _ in units:
            if self.squeeze and previous_space:
                new = new.lstrip(b" ")
            for byte in new:
                code = space if byte == 0x20 else bytes([byte])
                out += code
                origin += [begin] * len(code)
            if new:
                previous_space = new.endswith(b" ")
        end = units[-1][2] if units else len(data)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = origin[len(out)]
                del origin[len(out) :]
        return out.decode(errors="replace"), np.array([*origin, end], dtype=np.int64)

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk: the best scored adjacent pair that is a piece is merged, the leftmost of equals first."""
        parts: list[str] = list(chunk)
        if len(parts) < 2:
            return parts
        if len(parts) <= SCANNED:
            return self._scanned(parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ids, scores, queue = self.ids, self.scores, []

        def offer(left: int, right: int) -> None:
            joined = parts[left] + parts[right]
            if (i := ids.get(joined)) is not None:
                queue.append((-scores[i], left, joined)) if filling else heapq.heappush(queue, (-scores[i], left, joined))

        filling = True
        for i in range(len(parts) - 1):
            offer(i, i + 1)
        heapq.heapify(queue)
        filling = False
        while queue:
            _, left, joined = heapq.heappop(queue)
            right = after[left]
            if not parts[left] or right >= len(parts) or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p]

    def _scanned(self, parts: list[str]) -> list[str]:
        """The same for few parts: costs of all pairs stand in a list, whose first least one is merged."""
        cost, never = self.costs.get, float("inf")
        costs = [cost(a + b, never) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == never:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], never)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], never)
        return parts

    def _chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.merge(chunk):
            i = self.ids.get(piece)
            ids += [i] if i is not None else [self.fallback[b] for b in piece.encode()]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> Encoded:
        """Ids as the library gives them, each with the span of original bytes that it stands for.

        The normalised text is merged chunk by chunk; the spans come from the alignment of the normalisation.
        """
        normal, origin = self.normalise(text)
        body = self._chunk_ids(normal) if self.whole else b"".join(map(self.known.__getitem__, self.chunks(normal)))
        ids = np.frombuffer(b"".join((struct.pack("<I", self.begin), body, struct.pack("<I", self.end))), "<u4")
        places = origin[np.cumsum(self.lengths[ids])]
        return Encoded(ids, np.concatenate([origin[:1], places[:-1]]), places)

    def decode(self, ids: np.ndarray) -> str:
        """The text as the library decodes it."""
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, begins, ends, decoded)`` per row: all ids, the byte span of each in the original text, and the text decoded from the ids.

    Null texts are empty, and an empty text is begin and end id alone. Any id, null ones and repeated ones too, is returned as it is. Rows
    are independent: no shuffle, and no state but the model in each worker.
    """
    schema = "id long, ids array<int>, begins array<int>, ends array<int>, decoded string"

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        flat = np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def columns(model: PieceModel, texts: list[str]) -> list[pa.Array]:
        found = [model.encode(t) for t in texts]
        spans = [lists([getattr(e, k) for e in found]) for k in ("ids", "begins", "ends")]
        return [*spans, pa.array([model.decode(e.ids) for e in found], pa.string())]

    return _each_batch(df, model_path, id_col, text_col, schema, columns)


def encode_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` with digests in place of lists: ``(id, n_tokens, ids_sha256, decoded_sha256, bytes_spanned)``."""
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_spanned long"

    def columns(model: PieceModel, texts: list[str]) -> list[pa.Array]:
        rows = []
        for text in texts:
            e = model.encode(text)
            ids = hashlib.sha256(e.ids.tobytes()).hexdigest()
            rows.append((len(e.ids), ids, hashlib.sha256(model.decode(e.ids).encode()).hexdigest(), int((e.ends - e.begins).sum())))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return _each_batch(df, model_path, id_col, text_col, schema, columns)


def _each_batch(df: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, columns: Callable[[PieceModel, list[str]], list[pa.Array]]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(model, part.column(1).to_pylist())], names=names)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text"))
    return small_batches(rows).mapInArrow(of_batches, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests, and the bytes its pieces span; see :func:`encode_documents` for nulls, empty texts and repeats."""
    return encode_digests(table(spark, sf_dir, "documents"), model_path()).withColumnRenamed("id", "doc_id")
