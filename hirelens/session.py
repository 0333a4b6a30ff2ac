"""Session settings and the shared folder for small settled tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot partition even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort where every partition of one side is small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "hirelens", **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; `conf` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="hirelens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hirelens-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Meant for results that are much smaller than their input (fences, cut points, cells, term
    weights) and are then joined to the full table. It cuts the lineage, survives lost executors,
    and gives the optimizer the true size: it broadcasts the table when that is under
    `spark.sql.autoBroadcastJoinThreshold` and shuffles when it is not.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A feature table that is built once per application and inputs, and read by everything that needs it afterwards.

    `paths`: the files it is made from. Their names, sizes and times are part of its name, so that changed inputs give a new table.
    A table that was not written to its end is built again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    # added up by the executors: a corpus may have a million files
    state = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()["s"]
    base = shared_folder(spark).rsplit("/", 1)[0]
    path = f"{base}/hirelens-{spark.sparkContext.applicationId}-{name}-{state}"
    try:
        spark.read.schema("id long").parquet(f"{path}/done")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        build().write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/rows")
