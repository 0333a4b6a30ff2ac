"""Incremental ingest of captured files, dedup across runs and snapshot upkeep.

A run takes the files that are new since the last one (`availableNow`) and stops; where it stopped
is kept in the checkpoint, so a later run neither repeats nor skips a page.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hirelens.operators.collect import first_seen, merge_details, require_id
from hirelens.sources.listings import explode_listings, parse_responses, quarantine
from hirelens.streaming.store import BucketStore, read_if_any


def stream_responses(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Listing responses (JSON lines) that keep arriving in a folder, broken ones too, with their status."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_responses(lines)


def stream_listings(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Posting rows of the responses with status ok; see `ingest_responses` for a run that keeps the others too."""
    return explode_listings(stream_responses(spark, folder, max_files))


def stream_table(spark: SparkSession, folder: str, schema: str, pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """Rows from Parquet files that keep arriving in a folder; `pattern` selects them by name."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", pattern).parquet(folder)
    )


def _firsts(rows: pa.Table, order: list[str]) -> pa.Table:
    """The first row of each key."""
    rows = rows.combine_chunks()
    row = rows.column("row").combine_chunks()
    sorted_by = {"key": rows.column("key"), **{f"o{i}": pc.struct_field(row, c) for i, c in enumerate(order)}}
    at = pc.sort_indices(pa.table(sorted_by), sort_keys=[(c, "ascending") for c in sorted_by], null_placement="at_start")
    keys = rows.column("key").combine_chunks().take(at)
    new = pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])])
    return rows.take(at.filter(new))


def _first_of_each(order: list[str]):
    """Within an Arrow batch the first row of each key, so that a key with very many copies leaves its task as a few rows."""
    def keep(batches):
        for b in batches:
            if b.num_rows:
                yield from _firsts(pa.Table.from_batches([b]), order).to_batches()
    return keep


def _first_of_all(order: list[str], most: int = 100_000):
    """Within a task the first row of each key; held are the keys met so far and as many rows again, or `most`."""
    def keep(batches):
        held, kept, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size > max(2 * kept, most):
                held = _firsts(pa.Table.from_batches(held), order).to_batches()
                kept = size = sum(h.num_rows for h in held)
        if held:
            yield from _firsts(pa.Table.from_batches(held), order).to_batches(max_chunksize=10_000)
    return keep


def stream_dedup(df: DataFrame, key: str, order: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """First arrival per key over all batches and runs of a checkpoint: no watermark, so no key is lost however late it comes.

    The state holds every key for good, in RocksDB on the executors' disks (see `run_available`). With `order` the first row of a key's
    first batch passes, which takes two Arrow passes; ties must be broken by the caller. Without it some row of that batch passes.
    Keys are held against the state by Spark's own deduplication, whatever `order`. Rows without a key are dropped. `buckets`: into how
    many pieces the keys of a batch are dealt, each of which a task brings down to one row a key; the session's shuffle partitions if
    not given.
    """
    rows = require_id(df, key)
    if order is None:
        return rows.dropDuplicates([key])
    held = rows.select(F.col(key).alias("key"), F.struct(*df.columns).alias("row"))
    few = held.mapInArrow(_first_of_each(order), held.schema)
    dealt = few.repartition(*([buckets] if buckets else []), "key")
    return dealt.mapInArrow(_first_of_all(order), held.schema).select("row.*").dropDuplicates([key])


# A snapshot folder holds two tables that only grow, each in hash buckets (see `store`): new postings, and descriptions that arrived
# for known ones. Batch numbers start at 0 for every checkpoint, so the stream's id, which is kept with the checkpoint, names a batch
# together with its number. One stream writes at a time.

def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream with this checkpoint: made at its first use and kept in the checkpoint folder."""
    path = f"{checkpoint.rstrip('/')}/stream_id"
    known = read_if_any(spark, path)
    if known is None:
        spark.createDataFrame([(f"s-{uuid.uuid4().hex}",)], "id string").coalesce(1).write.parquet(path)
        known = spark.read.parquet(path)
    return known.first()["id"]


def postings_store(spark: SparkSession, path: str, key: str = "job_id", **settings) -> BucketStore:
    """The postings of the snapshot at `path`; keep it over the batches of a run to read the list of runs once only."""
    return BucketStore(spark, f"{path.rstrip('/')}/postings", key, **settings)


def _last_details(rows: DataFrame) -> DataFrame:
    """Of every id the text that arrived last: the last batch counts, and in it the last fetch."""
    newest = F.max_by(F.struct("description", "fetched_seq", "batch", "stream"), F.struct("batch", "fetched_seq", "stream"))
    return rows.where(F.col("description").isNotNull()).groupBy("job_id").agg(newest.alias("_d")).select("job_id", "_d.*")


def details_store(spark: SparkSession, path: str, **settings) -> BucketStore:
    """The descriptions of the snapshot at `path`; merged runs keep the last one of every id."""
    return BucketStore(spark, f"{path.rstrip('/')}/details", "job_id", merge=_last_details, **settings)


def upsert_batch(
    batch: DataFrame, batch_id: int, path: str | BucketStore, key: str = "job_id", order: list[str] | None = None,
    keep: Column | None = None, stream: str = "main",
) -> None:
    """Add the batch's first row of every id that the snapshot does not hold, whatever the order of arrival.

    `path`: the snapshot's folder, or its `postings_store`. `stream`: see `stream_id`; batches of one stream have numbers of their own.
    """
    store = path if isinstance(path, BucketStore) else postings_store(batch.sparkSession, path, key)
    rows = require_id(batch, store.key)
    if keep is not None:
        rows = rows.where(keep)
    store.add_new(first_seen(rows, store.key, order or ["keyword", "page_no", "pos_in_page"]), stream, batch_id)


def add_details(batch: DataFrame, batch_id: int, path: str | BucketStore, stream: str = "main") -> None:
    """Add descriptions (job_id, description, fetched_seq) for postings of the snapshot.

    The last batch counts, and in it the last fetch; of batches with one number in two streams the later fetch.
    """
    store = path if isinstance(path, BucketStore) else details_store(batch.sparkSession, path)
    rows = batch.select("job_id", "description", "fetched_seq")
    store.append(rows.withColumns({"batch": F.lit(batch_id).cast("long"), "stream": F.lit(stream)}), stream, batch_id)


def ingest_responses(
    batch: DataFrame, batch_id: int, path: str | BucketStore, quarantined: str, keep: Callable[[DataFrame], DataFrame] | None = None,
    order: list[str] | None = None, stream: str = "main",
) -> None:
    """A batch of `stream_responses`: postings into the snapshot, everything else into the table `quarantined`.

    `keep` filters the postings. A batch that is run again overwrites its own part of the quarantine.
    """
    rows = batch.persist()  # parsed once for both
    try:
        quarantine(rows).write.mode("overwrite").parquet(f"{quarantined.rstrip('/')}/stream={stream}/batch={batch_id}")
        postings = explode_listings(rows)
        upsert_batch(keep(postings) if keep else postings, batch_id, path, order=order, stream=stream)
    finally:
        rows.unpersist()


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot: all postings with the last description that arrived for each."""
    postings = postings_store(spark, path).read()
    if postings is None:
        raise ValueError(f"no postings were ever added at {path}")
    postings = postings.drop("run", "bucket")
    details = details_store(spark, path).read()
    return postings if details is None else merge_details(postings, _last_details(details.drop("run", "bucket")))


KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition of the state takes some MB at once
}


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Take what is new since the last run with this checkpoint, batch by batch, and stop.

    State of keyed operators is kept on disk by RocksDB, in bounded memory, and saved to the checkpoint with every batch.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in KEYED_STATE}
    for k, v in KEYED_STATE.items():
        conf.set(k, v)
    try:  # a query keeps the settings it was started with
        return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
