"""Quantiles from mergeable sketches, with a stated error: one small binary value per group instead of its sorted values.

A KLL sketch of size k answers any quantile with a normalised rank error of 2.296 / k^0.9723 at 99 % confidence (the published fit for this
sketch). `size_for` takes half of the asked error as that, so that the asked error is some five standard deviations away. Sketches of
parts (days, sources, cities) merge into the sketch of the whole without the rows; a task sends one sketch per group, whatever its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.operators.prefix import same_keys
from hirelens.session import settle

LEAST, MOST = 8, 65535  # sizes that the sketch takes


def size_for(error: float) -> int:
    """The sketch size for a normalised rank error: a quantile p is answered by a value of rank p - error to p + error."""
    k = int((2.296 / (error / 2)) ** (1 / 0.9723)) + 1
    if k > MOST:
        raise ValueError(f"no sketch is that exact: the least error is {2 * 2.296 / MOST ** 0.9723:.1e}")
    return max(LEAST, k)


def sketched(df: DataFrame, col: str, by: list[str], error: float = 0.01) -> DataFrame:
    """(by..., sketch, n): a sketch of `col` per group; NULL and NaN are left out, groups without values have an empty sketch."""
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(value, F.lit(size_for(error))).alias("sketch"), F.count(value).alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of parts to those of coarser groups."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantile(p: float) -> Column:
    """The value of rank p in `sketch`; NULL where it is empty."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))


def sketch_quantiles(sketches: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """(by..., n, one column per name in `probs`)."""
    return sketches.select(*by, "n", *[quantile(p).alias(name) for name, p in probs.items()])


def approx_summary(df: DataFrame, col: str, by: list[str] | None = None, error: float = 0.01) -> DataFrame:
    """Count, mean, median and sample standard deviation in one pass without a sort; the median by sketch."""
    by = by or []
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    out = df.groupBy(*by).agg(
        F.kll_sketch_agg_double(value, F.lit(size_for(error))).alias("sketch"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.select(*by, "n", "mean", "std", quantile(0.5).alias("median"))


def approx_box_stats(df: DataFrame, col: str, by: list[str], reach: float = 1.5, error: float = 0.01) -> DataFrame:
    """Box-plot table per group with quartiles by sketch; whiskers and outliers are exact for those quartiles.

    Two passes over the rows and no sort; what meets them in the second is one row per group.
    """
    q = sketch_quantiles(sketched(df, col, by, error), by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fences = settle(q.withColumns({"low": F.col("q1") - F.lit(reach) * iqr, "high": F.col("q3") + F.lit(reach) * iqr}))
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    rows = same_keys(df.select(*by, value.alias("value")).where(F.col("value").isNotNull()), fences, by)
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return rows.groupBy(*by, "q1", "median", "q3").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"), F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"))
