"""Exact deduplication behind a two-pass Bloom filter.

Pass 1 hashes each text and sets bits in a sharded filter that keeps, per bit, "set once" and "set again". Tasks send only bit
positions, merged per task and shard. Pass 2 tests each hash against the "set again" bits: a hash with any bit set only once
occurs once in the table, and its row passes straight through. Only the rest is grouped by the full SHA-256, so the result is
exact whatever the filter says. Tasks read at most `max_bits` of filter at a time: a larger table is cut by a hash of the digest into
segments, which go through both passes one after the other, each with a filter of its own, so a row has its bits at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import documents, settle, shared_folder

SHARD = 20  # bits of a position inside a shard: 2**20 bits, 128 KB
HASHES = 4
BITS_PER_ROW = 16


def positions(digests: pa.Array, bits: int) -> np.ndarray:
    """(rows, HASHES) bit positions by double hashing the first 16 bytes of each 32-byte digest."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
    step = raw[:, 1] | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    return (raw[:, :1] + k * step[:, None]) & np.uint64(bits - 1)


def _mark(bits: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, count = np.unique(positions(batch.column(0), bits), return_counts=True)
            shard = (pos >> np.uint64(SHARD)).astype(np.int32)
            local = (pos & np.uint64((1 << SHARD) - 1)).astype("<u4")
            names, first = np.unique(shard, return_index=True)
            ends = [*first[1:], len(pos)]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(names, pa.int32()),
                "once": pa.array([local[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                "again": pa.array([local[a:b][count[a:b] > 1].tobytes() for a, b in zip(first, ends)], pa.binary()),
            })

    return run


def _merge(batches):
    """Rows sorted by shard -> one packed bitmap of the bits that were set again, per shard."""
    at, once, again = None, None, None

    def out():
        return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "bitmap": pa.array([np.packbits(again).tobytes()], pa.binary())})

    for batch in batches:
        for shard, one, two in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != at:
                if at is not None:
                    yield out()
                at, once, again = shard, np.zeros(1 << SHARD, bool), np.zeros(1 << SHARD, bool)
            new = np.frombuffer(one, "<u4")
            again[new[once[new]]] = True
            again[np.frombuffer(two, "<u4")] = True
            once[new] = True
    if at is not None:
        yield out()


def repeat_filter(hashed: DataFrame, bits: int) -> np.ndarray:
    """Packed bitmap (bits / 8 bytes) of the positions that two or more rows of `hashed` (digest) set."""
    marks = hashed.select("digest").mapInArrow(_mark(bits), "shard int, once binary, again binary")
    shards = max(1, bits >> SHARD)
    merged = marks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_merge, "shard int, bitmap binary")
    bitmap = np.zeros(max(bits, 1 << SHARD) // 8, np.uint8)
    width = (1 << SHARD) // 8
    for row in merged.toLocalIterator():  # at most max_bits / 8 bytes in all
        bitmap[row.shard * width : (row.shard + 1) * width] = np.frombuffer(row.bitmap, np.uint8)
    return bitmap


def _flag(shared, bits: int):
    def run(batches):
        bitmap = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = positions(batch.column("digest"), bits)
            hit = (bitmap[pos >> np.uint64(3)] >> (7 - (pos & np.uint64(7))).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1))], names=[*batch.schema.names, "maybe"])

    return run


def filter_shape(rows: int, max_bits: int) -> tuple[int, int]:
    """(segments, bits of a segment's filter): BITS_PER_ROW bits a row or more, never over `max_bits` at a time."""
    segments = max(1, math.ceil(BITS_PER_ROW * rows / max_bits))
    bits = 1 << SHARD
    while bits < BITS_PER_ROW * rows / segments:
        bits *= 2
    return segments, bits


def flag_repeats(hashed: DataFrame, rows: int, max_bits: int) -> DataFrame:
    """(doc_id, digest, maybe) of `hashed` (doc_id, digest): `maybe` is false only where the digest comes once.

    Digests are written once, in a folder per segment; each segment reads its own folder twice and shuffles bit positions only.
    """
    spark = hashed.sparkSession
    segments, bits = filter_shape(rows, max_bits)
    held, out = shared_folder(spark), shared_folder(spark)
    hashed.withColumn("segment", F.pmod(F.xxhash64("digest"), F.lit(segments)).cast("int")).write.partitionBy("segment").parquet(held)
    schema = "doc_id long, digest binary"
    for s in range(segments if rows else 0):
        own = spark.read.schema(f"{schema}, segment int").parquet(held).where(F.col("segment") == s).select("doc_id", "digest")
        shared = spark.sparkContext.broadcast(repeat_filter(own, bits))
        own.mapInArrow(_flag(shared, bits), f"{schema}, maybe boolean").write.parquet(f"{out}/part={s}")
        shared.unpersist()
    if not rows:
        return spark.createDataFrame([], f"{schema}, maybe boolean")
    return spark.read.schema(f"{schema}, maybe boolean, part int").parquet(out).drop("part")


def exact_dedup(docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, shuffled): one row per row of `docs`.

    Of rows with the same text the one with the largest doc_id stays. `shuffled` says whether the filter let the row into the
    grouping. `max_bits` bounds the filter that tasks read (2**28 bits are 32 MB). NULL text counts as empty. Rows that repeat
    a doc_id and its text count in `group_size` each and share their verdict. A NULL doc_id is smaller than any other; a group
    of only such rows keeps them (keep_id NULL). An empty table gives no rows.
    """
    flagged = flag_repeats(documents(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), docs.count(), max_bits)
    repeated = flagged.where("maybe")
    groups = settle(repeated.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    passed = flagged.where("NOT maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "maybe")
    met = repeated.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size", "maybe")
    return passed.unionByName(met).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("maybe").alias("shuffled"))
