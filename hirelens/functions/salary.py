"""Salary text to monthly thousands, and salary bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.constants import (
    BAND3_HIGH, BAND3_LOW, FLOW_BANDS, MEAN_BANDS, SALARY_PATTERN, WORK_DAYS_PER_MONTH,
)

_MARK = "\u0001"


def parse_salary(df: DataFrame, col: str = "raw_salary") -> DataFrame:
    """Add salary_min_k, salary_max_k, salary_month_k (K per month) and salary_status.

    The mean also spreads extra months ("13薪") over the year; the two ends do not. The pattern
    runs once per row: its six groups come back as one marked text that is split.
    """
    groups = F.split(F.regexp_replace(F.col(col), SALARY_PATTERN, _MARK.join(f"${i}" for i in range(1, 7))), _MARK)
    parts = df.withColumn("_parts", F.when(~F.contains(F.col(col), F.lit(_MARK)), groups))
    # a text that does not match stays whole, as one part
    group = lambda i: F.when(F.size("_parts") == 6, F.nullif(F.get("_parts", F.lit(i)), F.lit("")))
    read = parts.select(
        *df.columns,
        group(0).cast("double").alias("_lo"),
        F.coalesce(group(1), group(3), F.lit("元")).alias("_lo_unit"),
        group(2).cast("double").alias("_hi"),
        F.coalesce(group(3), F.lit("元")).alias("_hi_unit"),
        group(4).alias("_period"),
        F.coalesce(group(5).cast("double"), F.lit(12.0)).alias("_months"),
    )
    scaled = read.select(
        *df.columns,
        (F.col("_lo") * _unit_factor("_lo_unit") * _period_factor("_period")).alias("salary_min_k"),
        (F.col("_hi") * _unit_factor("_hi_unit") * _period_factor("_period")).alias("salary_max_k"),
        "_months",
    )
    # The generator keeps the optimizer from copying the parsed expressions into every filter and
    # aggregate above: the pattern runs once per row, whatever is done with the result.
    month = (F.col("salary_min_k") + F.col("salary_max_k")) / F.lit(2.0) * F.col("_months") / F.lit(12.0)
    status = F.when(F.col("salary_min_k").isNull(), "unparsed").otherwise("parsed")
    parsed = F.struct("salary_min_k", "salary_max_k", month.alias("salary_month_k"), status.alias("salary_status"))
    return scaled.select(*df.columns, F.inline(F.array(parsed)))


def _unit_factor(name: str) -> Column:
    unit = F.col(name)
    return F.when(unit.isin("K", "k", "千"), F.lit(1.0)).when(unit == "万", F.lit(10.0)).otherwise(F.lit(0.001))


def _period_factor(name: str) -> Column:
    period = F.col(name)
    return (
        F.when(period.isin("天", "day"), F.lit(WORK_DAYS_PER_MONTH))
        .when(period.isin("年", "year"), F.lit(1.0) / F.lit(12.0))
        .otherwise(F.lit(1.0))
    )


def salary_band3(col: Column) -> Column:
    """low below 8K, high above 20K, medium between (both ends included)."""
    return F.when(col < BAND3_LOW, "low").when(col <= BAND3_HIGH, "medium").when(col > BAND3_HIGH, "high")


def flow_band(col: Column) -> Column:
    """Four bands of the career flow."""
    return (
        F.when(col < 10.0, FLOW_BANDS[0]).when(col < 20.0, FLOW_BANDS[1])
        .when(col <= 35.0, FLOW_BANDS[2]).when(col > 35.0, FLOW_BANDS[3])
    )


def mean_band(col: Column) -> Column:
    """Five bands of a mean salary, each closed on the right."""
    out = F.when(col > MEAN_BANDS[-2][0], MEAN_BANDS[-1][1])
    for edge, label in reversed(MEAN_BANDS[:-1]):
        out = F.when(col <= edge, label).otherwise(out)
    return out
