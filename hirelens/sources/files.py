"""Snapshots, running files and exports."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.functions.text import join_tags, normalise_source, sentinel_to_null


# A snapshot folder holds versions, each in a folder of its own, and a list of the complete ones. A version enters the list when
# it has been written in full, so a job that fails half way, or one that reads the snapshot it replaces, changes nothing.

_LIST = "version string, number long"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LIST).parquet(f"{path.rstrip('/')}/versions")
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Load the last complete version of a snapshot; a NULL description or text id becomes ''.

    A plain Parquet folder, without versions, is read as it is.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    known = _versions(spark, path)
    last = known.orderBy(F.desc("number")).first() if known is not None else None
    df = reader.parquet(f"{path.rstrip('/')}/{last.version}" if last else path)
    text = [c for c, kind in df.dtypes if c in ("description", "job_id") and kind == "string"]
    return df.fillna("", subset=text) if text else df


def write_snapshot(df: DataFrame, path: str) -> bool:
    """Replace the snapshot at `path`; an empty frame leaves the old one as it is.

    The new version is written beside the old one, so `df` may read the snapshot itself. One writer at a time. Versions that
    are no longer the last may be deleted at any time after their readers have ended.
    """
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    if not spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/{version}").limit(1).count():
        return False
    known = _versions(spark, path)
    last = known.agg(F.max("number")).first()[0] if known is not None else None
    spark.createDataFrame([(version, (last or 0) + 1)], _LIST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/versions")
    return True


def append_page(df: DataFrame, path: str) -> None:
    """Append rows to a running table; nothing that is already there is read or rewritten."""
    df.write.mode("append").parquet(path)


def export_final(df: DataFrame, folder: str, prefix: str = "jobs_final") -> str:
    """CSV with header under a time-stamped name, without the id column; returns the path."""
    path = f"{folder.rstrip('/')}/{prefix}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
    _flat(df.drop("job_id")).write.option("header", True).option("escape", '"').csv(path)
    return path


def export_cleaned(df: DataFrame, path: str) -> None:
    """Cleaned postings as CSV with header, arrays as comma text."""
    _flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[join_tags(F.col(c)).alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes])


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All platforms under one schema; `source` holds the site key, absent columns are NULL."""
    named = [df.withColumn("source", normalise_source(F.lit(name))) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def null_sentinels(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fold the texts for "no value" into NULL in the given (default: all) text columns."""
    text = cols or [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: sentinel_to_null(F.col(c)) for c in text})
