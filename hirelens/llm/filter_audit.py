"""How filters interact, in every order of application, kept up to date by an incremental stream.

Each document has a mask of the filters it fails. Four of them depend on its text alone; the fifth (E) on whether a smaller doc_id has the
same text, so it changes as files arrive. All files are taken as available-now micro-batches. State is kept per text: its smallest doc_id
and what that document adds to the counters. When a smaller id arrives, the document that held the place is retracted from its counter
and added to the one of its mask with E. What the stream writes are signed changes to (part, mask) counters, a batch at a time; their sum is
exact at any moment, and the 120 orders are expanded from at most 32 masks a part, never from documents.
"""

from __future__ import annotations

import hashlib
import json
from itertools import groupby, permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from hirelens.llm.common import settle, shared_folder

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

MEASURED = "doc_id long, part string, mask int, text_key string"
PARTIAL = "text_key string, part string, mask int, least long, n long, good long, toxic long, least_n long, least_good long, least_toxic long"
CHANGE = "part string, mask int, n long, good long, toxic long"
COUNTS = ["n", "good", "toxic"]
BUCKETS = 4096  # groups of texts that one call serves; as many tasks can work on the state at a time


def own_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D and at nothing else
    capitals, signs = len(raw) - len(raw.translate(None, CAPITALS)), len(raw.translate(None, SIGNS)) < len(raw)
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | signs << 3


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, text_key): the filters that a text fails by itself, and the SHA-256 of the text."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def measure(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            masks = pa.array([own_mask(t) for t in texts], pa.int32())
            keys = pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), masks, keys], names=["doc_id", "part", "mask", "text_key"])

    return own.mapInArrow(measure, MEASURED)


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): one row per labelled doc_id; where labels repeat, a document is good or toxic if any says so."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    named = labels.where(F.col("doc_id").isNotNull())
    return named.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def _combined(frames):
    """Rows of a text and part in one Arrow batch to one row: a text that fills a batch leaves its task as a single row."""
    for f in frames:
        if len(f):
            by = f.groupby(["text_key", "part"], sort=False)
            f["first"] = f["doc_id"] == by["doc_id"].transform("min")
            f["n"] = 1
            for c in COUNTS:
                f[f"least_{c}"] = f[c].where(f["first"], 0)
            sums = {c: (c, "sum") for c in [*COUNTS, *(f"least_{c}" for c in COUNTS)]}
            yield by.agg(mask=("mask", "first"), least=("doc_id", "min"), **sums).reset_index()[[x.split(" ")[0] for x in PARTIAL.split(", ")]]


class _Least(StatefulProcessor):
    """Per text its smallest doc_id and what that document adds to the counters, by part; a batch's rows come out as counter changes.

    The grouping key is a bucket of text hashes, so that one call serves several texts; the state is an entry for each text.
    """

    def init(self, handle) -> None:
        self.texts = handle.getMapState("texts", "text_key string", "least long, held string")

    def handleInputRows(self, key, rows, timerValues):
        changes: dict[tuple[str, int], list[int]] = {}
        for text, group in groupby(rows, key=lambda r: r.text_key):  # rows of a text that lie apart only meet the state twice
            self._text(text, list(group), changes)
        for (part, mask), counts in changes.items():
            if any(counts):
                yield Row(part=part, mask=mask, **dict(zip(COUNTS, counts)))

    def _text(self, text, rows, changes) -> None:
        was = self.texts.getValue((text,))
        mask = rows[0].mask
        held = json.loads(was[1]) if was else {}
        least = min([r.least for r in rows] + ([was[0]] if was else []))
        if was and was[0] > least:  # a smaller id has come: the document that held the place is a copy now
            for part, counts in held.items():
                _add(changes, (part, mask), counts, -1)
                _add(changes, (part, mask | COPY), counts)
            held = {}
        for r in rows:
            every, first = (r.n, r.good, r.toxic), (r.least_n, r.least_good, r.least_toxic) if r.least == least else (0, 0, 0)
            if r.least == least:
                _add(held, r.part, first)
                _add(changes, (r.part, mask), first)
            _add(changes, (r.part, mask | COPY), [x - y for x, y in zip(every, first)])
        if not was or was[0] > least or any(r.least == least for r in rows):
            self.texts.updateValue((text,), (least, json.dumps(held)))


def _add(to: dict, at, counts, sign: int = 1) -> None:
    kept = to.setdefault(at, [0, 0, 0])
    for i, c in enumerate(counts):
        kept[i] += sign * c


def _changes(found: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """Measured rows of a stream to signed counter changes."""
    named = found.join(verdicts(labels), "doc_id", "left").select(
        "doc_id", "part", "mask", "text_key", F.coalesce("good", F.lit(0)).cast("long").alias("good"), F.coalesce("toxic", F.lit(0)).cast("long").alias("toxic"))
    partial = named.mapInPandas(_combined, PARTIAL).withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)))
    return partial.groupBy("bucket").transformWithState(_Least(), CHANGE, "Append", "None")


def audit_stream(files: DataFrame, labels: DataFrame, checkpoint: str, changes: str, buckets: int = BUCKETS) -> None:
    """Take the files of the stream `files` (columns of `documents`) that are new since the last call, batch by batch, and stop.

    `checkpoint` holds the state and what has been read; `changes` a folder per batch, which a batch that is run again overwrites.
    The state stays in RocksDB on the executors' disks, in bounded memory, and is saved to the checkpoint with each batch.
    """
    spark = files.sparkSession
    found = measured(files).where(F.col("doc_id").isNotNull())

    def write(batch: DataFrame, i: int) -> None:
        batch.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS)).write.mode("overwrite").parquet(f"{changes}/batch={i}")

    state = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition of the state takes some MB at once
    }
    before = {k: spark.conf.get(k, None) for k in state}
    try:
        for k, v in state.items():
            spark.conf.set(k, v)
        run = _changes(found, labels, buckets).writeStream.outputMode("append").foreachBatch(write)
        run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counters(spark: SparkSession, changes: str) -> DataFrame:
    """(part, mask, n, good, toxic): the sum of all changes so far; a mask whose documents were all retracted is gone."""
    rows = spark.read.schema(CHANGE).parquet(f"{changes}/batch=*")
    return rows.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS)).where("n <> 0")


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) out of (part, mask) counters.

    One row per part, order and step, also where nothing is removed. `shapley`: over all orders a document that fails k filters goes at
    a given one of them in 120 / k.
    """
    steps = F.array(*(
        F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(1 << FILTERS.index(o[i])).alias("bit"),
                 F.lit(sum(1 << FILTERS.index(f) for f in o[:i])).alias("earlier")) for o in ORDERS for i in range(len(FILTERS))))
    each = counts.select("part", "mask", *COUNTS, F.explode(steps).alias("s")).select("part", "mask", *COUNTS, "s.*")
    fails, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) == 0
    total = lambda c, name, of="n": F.sum(F.when(c, F.col(of)).otherwise(0)).cast("long").alias(name)
    orders = F.lit(len(ORDERS)) / F.bit_count("mask")
    return each.groupBy("part", "filter_order", "step").agg(
        total(passed & ~fails, "kept"), total(fails & passed, "removed"), total(fails & ~passed, "redundant"), total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(fails & passed, "good_lost", "good"), total(fails & passed, "toxic_lost", "toxic"),
        F.sum(F.when(fails, F.col("n") * orders.cast("long")).otherwise(0)).cast("long").alias("shapley"))


def stream_files(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """The files at `path` (one file or a folder) as a stream that takes them in about `batches` micro-batches."""
    known = spark.read.parquet(path)
    at_once = max(1, -(-len(known.inputFiles()) // batches))
    pattern = path[:-1] + f"[{path[-1]}]"  # a pattern also where `path` is a single file
    return spark.readStream.schema(known.schema).option("maxFilesPerTrigger", at_once).parquet(pattern)


def audit_files(spark: SparkSession, documents: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """The audit of all documents in the files at `documents`, taken as `batches` available-now micro-batches.

    NULL text and lang count as empty. A document is a row: rows that repeat the smallest doc_id of a text all stay; a row without doc_id
    is neither smaller nor larger than another, so E passes it and it makes no other fail. No documents give no rows.
    """
    base = shared_folder(spark)
    audit_stream(stream_files(spark, documents, batches), settle(verdicts(labels)).withColumnsRenamed({"good": "quality"}), f"{base}/checkpoint", f"{base}/changes")
    nameless = measured(spark.read.parquet(documents).where("doc_id IS NULL")).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    both = counters(spark, f"{base}/changes").unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return audit(settle(both))
