"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits lies on a ring of M segments. If two fingerprints differ in at most T bits, some start on the ring has
every chain of l consecutive segments from there within l * T / M differences (rounded down). With M = 5 and T = 2 these
budgets are 0, 0, 1, 1, 2: the first two segments agree exactly, which is the key candidates meet on (25 to 26 bits, five keys
for each fingerprint); the longer chains prune the candidates before the full Hamming distance is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import documents, fresh, partitions, settle
from hirelens.llm.graph import components

RING, MOST = 5, 2
EDGES = [64 * i // RING for i in range(RING + 1)]
BUDGETS = [(i + 1) * MOST // RING for i in range(RING)]
ZERO_CHAIN = sum(b == 0 for b in BUDGETS)
SEED = 42


def _mask(i: int) -> int:
    lo, hi = EDGES[i % RING], EDGES[i % RING + 1]
    return (1 << hi) - (1 << lo)


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Bit set if set in over half of the XXH64 (seed 42) of the text's shingles; no word gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the white space of the contract only
    if not words:
        return 0
    n = words_per_shingle
    shingles = zip(*(words[i:] for i in range(n))) if len(words) > n else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return documents(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _linked(fp: np.ndarray, start: int) -> np.ndarray:
    """Boolean matrix of the pairs that pass every chain from `start`, and then the full check."""
    diff = fp[:, None] ^ fp[None, :]
    ok, total = np.ones(diff.shape, bool), np.zeros(diff.shape, np.uint8)
    for length in range(RING):
        total += np.bitwise_count(diff & np.uint64(_mask(start + length)))
        ok &= total <= BUDGETS[length]
    return ok & (np.bitwise_count(diff) <= MOST)


def _forest(fp: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket as one edge per node that is not the root of its part: (node, root)."""
    met = _linked(fp, start)
    label = np.arange(len(fp))
    while True:
        new = np.where(met, label[None, :], len(fp)).min(axis=1)
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(fp))
    return fp[own], fp[label[own]]


def _buckets(batches):
    """Rows sorted by (start, segments) -> edges of each bucket; the caller bounds the size of a bucket."""
    at, held = None, []

    def out():
        if len(held) < 2:
            return None
        a, b = _forest(np.array(held, np.int64).view(np.uint64), at[0])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"]) if len(a) else None

    for batch in batches:
        for start, key, fp in zip(*(c.to_pylist() for c in batch.columns)):
            if (start, key) != at:
                if (found := out()) is not None:
                    yield found
                at, held = (start, key), []
            held.append(fp)
    if (found := out()) is not None:
        yield found


def near_links(distinct: DataFrame, bucket: int = 1024) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` exactly as "differ in at most two bits" does.

    Buckets of up to `bucket` fingerprints are compared inside a task and send a spanning forest, not their pairs. The
    fingerprints of larger buckets meet, as exactly, on common neighbours instead: two fingerprints differ in at most two bits
    if and only if some value lies within one bit of both. Each has 65 such values, so a crowd of near copies costs 65 rows a
    member, and never its square.
    """
    spark = distinct.sparkSession
    agree = lambda s: sum(_mask(s + i) for i in range(ZERO_CHAIN))
    key = lambda s: F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(_signed(agree(s))).alias("key"))
    keyed = distinct.select("fp", F.explode(F.array(*[key(s) for s in range(RING)])).alias("k")).select("k.start", "k.key", "fp")
    crowded = settle(keyed.groupBy("start", "key").count().where(F.col("count") > bucket).select("start", "key"))
    n = partitions(spark)
    small = keyed.join(crowded, ["start", "key"], "left_anti").repartition(n, "start", "key").sortWithinPartitions("start", "key").mapInArrow(_buckets, "a long, b long")
    crowd = keyed.join(crowded, ["start", "key"], "left_semi").select("fp").distinct()
    around = [F.col("fp"), *[F.col("fp").bitwiseXOR(_signed(1 << i)) for i in range(64)]]
    meeting = crowd.select("fp", F.explode(F.array(*around)).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("fps"))  # at most 65 within one bit of z
    large = meeting.where(F.size("fps") > 1).select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b")
    return small.unionByName(large)


def _signed(x: int):
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of `docs`; see the contract of `near_links`.

    component_id is the smallest doc_id reachable over links between fingerprints at two or fewer differing bits. Texts with
    no word have fingerprint zero and are linked like any other; NULL text counts as empty. Rows with equal fingerprints meet
    as one node. A NULL doc_id is never chosen as component_id unless its group has no other. An empty table gives no rows.
    """
    marked = settle(fingerprints(docs))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(near_links(nodes.select("fp")))
    part = F.coalesce("component", "fp")
    placed = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", part.alias("part"), "least")
    least = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = settle(placed.join(least, "part").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is their group's component_id, with every column: one document of each group.

    Those that go are fewer than those that stay, so they are what the texts are held against. A doc_id that rows of several
    groups have stays if it is the component_id of one.
    """
    name = fresh(docs, "goes")
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    goes = settle(simhash_dedup(docs).groupBy(F.col("doc_id").alias(name)).agg(stays.alias("_stays")).where("NOT _stays").select(name))
    return docs.join(goes, docs["doc_id"].eqNullSafe(goes[name]), "left_anti")
