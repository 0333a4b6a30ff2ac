"""Running totals, exact quantiles and null-safe joins that do not put one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelens.session import settle


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where NULL equals NULL; the keys come once, from the left."""
    if not keys:
        raise ValueError("give at least one key")
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_bucket(col: Column, resolution: int = 1024) -> Column:
    """An order-keeping bucket number: smaller values never get a larger bucket.

    Buckets are narrow near zero and widen with the logarithm of the value, so that neither
    shares (0..1) nor money (1..1e9) fall into a few buckets, and no pass for min and max is needed.
    """
    c = col.cast("double")
    return F.floor(F.signum(c) * F.log2(F.lit(1.0) + F.abs(c)) * F.lit(float(resolution)))


def running_totals(df: DataFrame, values: list[str], by: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Add, for every column v in `values`, `v_before`: its total over the rows sorted ahead of this
    one in the group, and `v_total`: its total over the group.

    Two levels: each (group, bucket) is sorted and summed on its own, then only the bucket totals
    are summed along the group. `bucket` must keep the order of `order`, and `order` must have no ties.
    """
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)

    rows = df.withColumn("_bucket", bucket)
    rows = rows.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), none) for v in values})
    sums = df.groupBy(*by, bucket.alias("_bucket")).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    offsets = sums.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_sum_{v}").over(ahead), none).alias(f"_ahead_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(group).alias(f"{v}_total") for v in values])
    joined = same_keys(rows, offsets, [*by, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_ahead_{v}") + F.col(f"_in_{v}")).alias(f"{v}_before") for v in values],
        *[f"{v}_total" for v in values])


def ranked_rows(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Number the rows 1, 2, 3, ... in `order` (which has no ties) without putting them into one task.

    The rows are dealt into ranges by sampled splitters and written, since a second sampling may split elsewhere; each range is numbered by
    itself and then moved by the sizes of the ranges ahead of it, of which there are as many as shuffle partitions.
    """
    part, ahead_of = "_range", Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    ahead = sizes.select(part, F.coalesce(F.sum("_size").over(ahead_of), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return rows.withColumn(out, inside).join(ahead, part).withColumn(out, F.col(out) + F.col("_ahead")).drop(part, "_ahead")


def value_counts(df: DataFrame, col: str, by: list[str], keep_groups: bool = False) -> DataFrame:
    """(group, value, n): rows collapse to distinct values before anything is sorted.

    NULL and NaN are left out; with `keep_groups` they stay as one NULL value with n = 0, so that a
    group without any value is not lost.
    """
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, value.alias("value"))
    if not keep_groups:
        rows = rows.where(F.col("value").isNotNull())
    return rows.groupBy(*by, "value").agg(F.count("value").alias("n"))


def ranked_counts(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """`value_counts` with the number of rows below each value and the group size."""
    return running_totals(value_counts(df, col, by), ["n"], by, ["value"], value_bucket(F.col("value")))


def quantiles_of(
    ranked: DataFrame, by: list[str], probs: dict[str, float], also: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact interpolated quantiles from `ranked_counts`: one column per name in `probs`, after the
    aggregates in `also`."""
    aggs = [agg.alias(name) for name, agg in (also or {}).items()]
    outs = [F.col(name) for name in also or {}]
    for i, (name, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("n_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        aggs += [
            F.max(F.when(holds(low), F.col("value"))).alias(f"_lo{i}"),
            F.max(F.when(holds(high), F.col("value"))).alias(f"_hi{i}"),
            F.max(at - low).alias(f"_f{i}"),
        ]
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name))
    return ranked.groupBy(*by).agg(*aggs).select(*by, *outs)


def exact_quantiles(df: DataFrame, col: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of `col` per group (linear interpolation), as columns named by `probs`."""
    return quantiles_of(ranked_counts(df, col, by), by, probs)


def salt_of(key: str | Column, salts: int) -> Column:
    """A stable salt from a key that differs from row to row."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def hot_key_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """Join `big` to `small` (one row per key, settled) with the keys in `hot` split over `salts` partitions.

    `hot` (settled) holds the few keys that occur too often; its size must be bounded by the caller's rule (for example: keys
    that hold at least a hundredth of all rows, so at most a hundred). Both small tables have known sizes, so the engine broadcasts
    them below its threshold; only the hot keys are copied on the small side.
    """
    marks = hot.select(F.col(key), F.lit(True).alias("_hot"))
    left = big.join(marks, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt_of(spread, salts)).otherwise(F.lit(0))).drop("_hot")
    right = small.join(marks, key, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    ).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")
