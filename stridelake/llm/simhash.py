"""SimHash near-duplicates: fingerprints of word shingles, multi-index hashing, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import id_of, is_null, order_id, shuffle_parts, small_batches, table, whole_text, written
from stridelake.llm.components import components

#: Shingles whose bits are counted at once: bounds the memory for texts of any length.
BLOCK = 1 << 13
#: Members of a bucket that are compared at once by block; buckets of at most SMALL members are compared without a forest.
TILE, SMALL = 2048, 16
#: Members that one task compares as one bucket (about): larger buckets are dealt to pairs of blocks.
BUCKET = 1 << 14
#: Multipliers that make further words of a fingerprint from the hash of a shingle.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Near copies by five words: bits of a fingerprint, of a segment, and by which two may differ. Sets of equal size and Jaccard 0.8
#: have a cosine of 8/9 and differ in 0.1515 of the bits, 38.8 of 256 with a deviation of 5.7; the radius takes in half a deviation more.
NEAR = {"words": 5, "bits": 256, "segment": 20, "radius": 42}


def fingerprint(text: str, words: int = 3, bits: int = 64) -> np.ndarray:
    """SimHash as 64-bit words: bit i is set if it is set in over half of the hashes of the word shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by one space; fewer words than a
    shingle needs are one shingle, none give zero. The first 64 bits are of XXH64 (seed 42), further ones of mixes of it.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(bits // 64, np.uint64)
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=len(shingles))
    counts = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        wide = np.empty((len(part), bits // 64), "<u8")
        wide[:, 0] = part
        for k in range(1, bits // 64):
            mixed = (part ^ (part >> np.uint64(29 + k))) * np.uint64(MIX[k % len(MIX)])
            wide[:, k] = mixed ^ (mixed >> np.uint64(32))
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def node_of(fps: np.ndarray) -> np.ndarray:
    """One long per row of fingerprint words: the word itself if there is one, else a mix of all."""
    out = fps[:, 0].copy()
    for k in range(1, fps.shape[1]):
        out = ((out ^ (out >> np.uint64(31))) * np.uint64(MIX[0])) ^ fps[:, k]
    return out.view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64) -> DataFrame:
    """``(id, none, row, node, f0, f1, ...)`` per row: order key of the id, whether it is null, a hash of the text, node and fingerprint words as signed longs."""
    names = ["id", "none", "row", "node", *(f"f{k}" for k in range(bits // 64))]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words, bits) for t in batch.column(3).to_pylist()], np.uint64).reshape(-1, bits // 64)
            columns = [*(batch.column(i) for i in range(3)), node_of(values), *(np.ascontiguousarray(v).view(np.int64) for v in values.T)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    rows = df.select(order_id(id_col).alias("id"), is_null(id_col).alias("none"), F.xxhash64(whole_text(text_col)).alias("row"), whole_text(text_col).alias("text"))
    return small_batches(rows).mapInArrow(of_batches, "id long, none boolean, " + ", ".join(f"{n} long" for n in names[2:]))


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (places of member and root) of the components of the fingerprints of one bucket, at most one per member.

    Members are compared in tiles against those not yet reached, by breadth-first growth, so memory is linear in the
    bucket and a dense bucket is eaten up after a few steps instead of listing its pairs.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(members))
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 32):
                some = members[front[at : at + 32]]
                for lo in range(0, len(rest), TILE):
                    part = members[rest[lo : lo + TILE]]
                    near[lo : lo + TILE] |= (np.bitwise_count(part[:, None, :] ^ some[None, :, :]).sum(axis=2, dtype=np.uint16) <= radius).any(axis=1)
            front, rest = rest[near], rest[~near]
            out += [(int(f), int(root)) for f in front]
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Links (two node columns) within the runs of equal keys that are at most ``radius`` bits apart: all of small runs, a forest of others."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    run = np.repeat(np.arange(len(sizes)), sizes)
    nodes, found = node_of(fps), [np.zeros((0, 2), np.int64)]
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, int(sizes.max(initial=0)))):
        at = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]).sum(axis=1, dtype=np.uint16) <= radius]
        found.append(np.stack([nodes[near], nodes[near + d]], axis=1))
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own, first = np.unique(nodes[start : start + size], return_index=True)
        links = np.array(_forest(fps[start : start + size][first], radius), np.int64).reshape(-1, 2)
        found.append(own[links])
    links = np.concatenate(found)
    return links[links[:, 0] != links[:, 1]]


def _links_of_buckets(radius: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the last bucket, which may go on in the next batch: two keys and the fingerprint in each row
        last = None

        def links() -> pa.RecordBatch:
            rows = np.concatenate(held)
            key = np.zeros(len(rows), np.int64)
            key[1:] = np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            ends = bucket_links(key, np.ascontiguousarray(rows[:, 2:]).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            cut = len(rows) - int(np.argmin((rows[::-1, :2] == rows[-1, :2]).all(axis=1))) if (rows[:, :2] != rows[-1, :2]).any() else 0
            if cut or held and tuple(rows[0, :2]) != last:
                held.append(rows[:cut])
                yield links()
                held.clear()
            held.append(rows[cut:])
            last = tuple(rows[-1, :2])
        if held:
            yield links()

    return of_batches


def _segments(bits: int, segment: int) -> list[Column]:
    """The whole segments of each 64-bit word, as longs with the segment's number above them."""
    mask, per_word = F.lit((1 << segment) - 1).cast("long"), 64 // segment
    cut = lambda w, i: F.shiftrightunsigned(f"f{w}", i * segment) if i else F.col(f"f{w}")
    return [cut(w, i).bitwiseAND(mask) + F.lit((w * per_word + i) << segment) for w in range(bits // 64) for i in range(per_word)]


def _ball(key: Column, segment: int) -> Column:
    """A segment's key and those with one more bit set: any two segments one bit apart share the greater one."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(segment - 1)), lambda i: key.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.array_distinct(F.concat(F.array(key), flips))


def fingerprint_links(nodes: DataFrame, radius: int = 3, bits: int = 64, segment: int = 32, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``nodes(node, f0, ...)`` that differ in at most ``radius`` bits.

    Each fingerprint is filed under every segment and under the keys that one more set bit gives, which meets every pair some segment of which differs in
    one bit, from the side that lacks it, or in one bit either way. With m segments no pair of up to 2 m - 1 bits is missed; a farther one is met with the chance
    that some segment differs so little. Complete distances decide. A bucket is read from a sorted stream and returns the links of a spanning forest, never its pairs.

    Buckets are sized beforehand from the counts of the segments' own keys; one of more than about ``bucket`` members is dealt to pairs of blocks, each a bucket
    of its own, so a segment that a third of all fingerprints share is compared by many tasks.
    """
    words = [f"f{k}" for k in range(bits // 64)]
    own = nodes.select(F.explode(F.array(*_segments(bits, segment))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    least = -(-bucket // (segment + 1))
    spread = own.where(F.col("n") > least).select("n", F.explode(_ball(F.col("key"), segment)).alias("key"))
    sizes = spread.groupBy("key").agg(F.ceil((F.sum("n") + (segment + 1) * least) / bucket).cast("int").alias("blocks"))
    posted = nodes.select("node", *words, F.explode(F.concat(*(_ball(s, segment) for s in _segments(bits, segment)))).alias("key"))
    dealt = posted.join(written(sizes), "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("other", other)
    low, high = F.coalesce(F.least("own", "other"), F.lit(0)).cast("long"), F.coalesce(F.greatest("own", "other"), F.lit(0)).cast("long")
    dealt = dealt.select("key", (low * F.lit(1 << 31) + high).alias("pair"), *words)
    buckets = dealt.repartition(shuffle_parts(nodes), "key", "pair").sortWithinPartitions("key", "pair")
    return buckets.mapInArrow(_links_of_buckets(radius), "a long, b long")


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, bits: int = 64, segment: int = 32
) -> DataFrame:
    """``(id, row, fp, component)`` per row: a hash of the text, the node (for 64 bits the fingerprint) as a signed long and the smallest id that links of ``radius`` bits reach.

    Null and empty texts have fingerprint zero and are copies of each other. A null id is one more document after all others: its component is the
    smallest id it reaches, or null if only null ids are there. Repeated rows are members like others. Documents that share a fingerprint are one node,
    so copies cost one row per task in the shuffle of fingerprints. Long texts are counted block by block, whole.
    """
    names = [f"f{k}" for k in range(bits // 64)]
    rows = written(fingerprints(df, id_col, text_col, words, bits))
    nodes = written(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("none").alias("none"), *(F.min(n).alias(n) for n in names)))
    roots = components(fingerprint_links(nodes.select("node", *names), radius, bits, segment))
    held = nodes.select("node", "least", "none").join(roots.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = held.groupBy("root").agg(F.min("least").alias("component"), F.min("none").alias("only_null"))
    named = held.join(first, "root").select("node", "component", "only_null")
    out = rows.join(named, "node")
    return out.select(id_of("id", "none").alias("id"), "row", F.col("node").alias("fp"), id_of("component", "only_null").alias("component"))


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR["words"], radius: int = NEAR["radius"], bits: int = NEAR["bits"], segment: int = NEAR["segment"]
) -> DataFrame:
    """The rows of ``df``, all columns, whose id is the smallest of their group (null only if the group has no other); copies of one id all stay.

    By default groups are of near copies by five words; ties can't be, as ids are compared. Null, empty and very long texts as in :func:`simhash_groups`.
    """
    groups = simhash_groups(df, id_col, text_col, words, radius, bits, segment)
    keep = groups.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("__sh_id"), F.col("row").alias("__sh_row")).distinct()
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__sh_id")) & (F.xxhash64(whole_text(text_col)) == F.col("__sh_row"))
    return df.join(keep, same, "left_semi")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document, 64 bits of three words; see :func:`simhash_groups` for nulls, empty texts and repeats."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
