"""A keyed table that only grows, in hash buckets: what a batch costs depends on the batch, not on what is already there.

A table is a set of runs. A run is a folder partitioned by `bucket`, a hash of the key, one file to a bucket, sorted by key. A batch reads
only the buckets that its own keys fall into, and of these only the key column. `fanout` runs of one level are merged into one of the next,
so a row is rewritten once per level and the number of runs and files stays bounded however many batches come.

Which runs are live stands in a list of at most (levels x fanout) rows. A list is written whole, into the one of two slots that does not hold
the current one, after the runs that it names: a job that fails half way leaves the old list and folders that no list names. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

LIST = "number long, buckets int, level int, run string, stream string, batch long, columns string"


@dataclass(frozen=True)
class Run:
    level: int
    run: str
    stream: str | None  # of the one batch it holds; NULL once runs are merged
    batch: int | None
    columns: str  # the schema as JSON: a run without rows has no file to tell it


def read_if_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _placed(columns: StructType) -> StructType:
    return StructType([*columns.fields, StructField("run", StringType()), StructField("bucket", IntegerType())])


class BucketStore:
    """The table in folder `path`; `buckets` counts at its first use only and is kept with it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, fanout: int = 8,
                 merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.path, self.key, self.fanout = spark, path.rstrip("/"), key, fanout
        self.merge = merge or (lambda rows: rows)  # what remains of the rows of merged runs
        known = read_if_any(spark, f"{self.path}/lists/slot=*", LIST)
        rows = known.collect() if known is not None else []
        self.number = max((r.number for r in rows), default=0)
        live = [r for r in rows if r.number == self.number]
        self.buckets = live[0].buckets if live else buckets
        self.runs = [Run(r.level, r.run, r.stream, r.batch, r.columns) for r in live]

    def _folder(self, run: str) -> str:
        return f"{self.path}/runs/run={run}"

    def _write(self, rows: DataFrame) -> str:
        run = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self.bucket_of(rows))
        placed.repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(self._folder(run))
        return run

    def _load(self, columns: StructType, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(_placed(columns)).option("basePath", f"{self.path}/runs").parquet(*folders)

    def _commit(self, runs: list[Run]) -> None:
        self.number += 1
        rows = json.dumps([{"number": self.number, "buckets": self.buckets, **asdict(r)} for r in runs])
        listed = self.spark.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{LIST.replace(' ', ':')}>>".replace(",:", ","))))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/slot={self.number % 2}")
        self.runs = runs

    def bucket_of(self, rows: DataFrame):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, runs: list[Run] | None = None) -> DataFrame | None:
        """The rows of the live (or the given) runs with their bucket; None where there is no run yet."""
        runs = self.runs if runs is None else runs
        by_columns: dict[str, list[str]] = {}
        for r in runs:
            by_columns.setdefault(r.columns, []).append(self._folder(r.run))
        parts = [
            self._load(StructType.fromJson(json.loads(c)), folders) for c, folders in by_columns.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def known(self, keys: DataFrame, buckets: list[int], runs: list[Run] | None = None) -> DataFrame | None:
        """Those of `keys` (key) that the runs hold: only files of `buckets` are read, and the key column alone.

        The table is the streamed side of a semi-join, so a small batch is broadcast to it and the table is not shuffled.
        """
        held = self.read(runs)
        if held is None:
            return None
        return held.where(F.col("bucket").isin(buckets)).select(self.key).join(keys.select(self.key), self.key, "left_semi")

    def append(self, rows: DataFrame, stream: str, batch: int) -> None:
        """Add the rows as a run. A batch that is run again replaces what it added before."""
        self._add(self._write(rows), rows.schema, stream, batch)

    def add_new(self, rows: DataFrame, stream: str, batch: int) -> None:
        """Add those rows (one a key) whose key no run holds, but for what an earlier try of this very batch has left."""
        others = [r for r in self.runs if (r.stream, r.batch) != (stream, batch)]
        staged = self._write(rows)
        if others:
            came = self._load(rows.schema, [self._folder(staged)])
            touched = sorted({int(f.rsplit("/bucket=", 1)[1].split("/")[0]) for f in came.inputFiles()})
            fresh = came.drop("run", "bucket").join(self.known(came, touched, others), self.key, "left_anti").select(*rows.columns)
            staged = self._write(fresh)
        self._add(staged, rows.schema, stream, batch)

    def _add(self, run: str, schema: StructType, stream: str, batch: int) -> None:
        runs = [r for r in self.runs if (r.stream, r.batch) != (stream, batch)] + [Run(0, run, stream, batch, schema.json())]
        level = 0
        while sum(r.level == level for r in runs) >= self.fanout:
            merged = self.merge(self.read([r for r in runs if r.level == level]).drop("run", "bucket"))
            runs = [r for r in runs if r.level != level] + [Run(level + 1, self._write(merged), None, None, merged.schema.json())]
            level += 1
        self._commit(runs)

    def unlisted(self) -> DataFrame:
        """(path): files of runs that are no longer live. They may be deleted once their readers have ended."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/runs").select("path")
        live = [r.run for r in self.runs]
        return files.where(~F.regexp_extract("path", "/runs/run=([0-9a-f]+)/", 1).isin(live))
