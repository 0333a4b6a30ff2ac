"""Education and experience labels to numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.constants import EDUCATION_LEVELS, EXPERIENCE_LEVELS


def _lookup(col: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def edu_level(col: Column) -> Column:
    """Ordinal of an education label; NULL for an unknown label."""
    return _lookup(col, EDUCATION_LEVELS)


def exp_level(col: Column) -> Column:
    """Years that stand for an experience label; NULL for an unknown label."""
    return _lookup(col, EXPERIENCE_LEVELS)


def ordinal_table(spark: SparkSession, kind: str) -> DataFrame:
    """The fixed label table as a DataFrame (label, level), for `map_ordinal`."""
    table = {"education": EDUCATION_LEVELS, "experience": EXPERIENCE_LEVELS}[kind]
    return spark.createDataFrame(list(table.items()), "label string, level double")


def map_ordinal(df: DataFrame, col: str, dim: DataFrame, out: str) -> DataFrame:
    """Left join of a label column to a (label, level) table with one row per label."""
    return df.join(dim.select(F.col("label").alias(col), F.col("level").alias(out)), col, "left")


def parse_experience(df: DataFrame, col: str = "raw_experience") -> DataFrame:
    """Add exp_min and exp_max in years: "1-3" -> 1, 3; "10+" or "10年以上" -> 10, NULL; "1年以内" -> 0, 1."""
    text = F.col(col)
    low = F.nullif(F.regexp_extract(text, r"([0-9]+)", 1), F.lit("")).try_cast("int")
    high = F.nullif(F.regexp_extract(text, r"[0-9]+\s*-\s*([0-9]+)", 1), F.lit("")).try_cast("int")
    within = text.rlike("以内|以下|less than")
    return df.withColumns({
        "exp_min": F.when(within & low.isNotNull(), F.lit(0)).otherwise(low),
        "exp_max": F.when(within, low).otherwise(high),
    })


def career_stage(level: Column) -> Column:
    """Four stages by years of experience."""
    return (
        F.when(level < 2.0, "junior").when(level < 7.5, "middle")
        .when(level < 12.0, "senior").when(level >= 12.0, "expert")
    )
