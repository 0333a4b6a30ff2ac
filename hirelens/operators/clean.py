"""Missing values, standard forms, outliers and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.functions.text import WORD_OR_GAP, clean_symbols
from hirelens.operators.prefix import quantiles_of, ranked_counts, same_keys
from hirelens.session import settle


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, missing count and share, from one pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.col(c).alias("missing")) for c, kind in df.dtypes])
    return counts.select("_rows", F.inline(entries)).select(
        "column_name", "data_type", F.col("_rows").alias("row_count"), "missing",
        F.try_divide(F.col("missing"), F.col("_rows")).alias("missing_share"))


def drop_sparse(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Drop the columns whose missing share is above `limit` (runs one count over the table)."""
    shares = {r["column_name"]: r["missing_share"] for r in missing_profile(df).collect()}  # one row per column
    return df.select(*[c for c in df.columns if (shares[c] or 0.0) <= limit])


def impute_mode(df: DataFrame, cols: list[str], limit: float = 0.1) -> DataFrame:
    """Fill NULLs of key fields with the most frequent value (ties: the smallest), if under `limit` are missing."""
    for c in cols:
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        known = F.col(c).isNotNull()
        best = counts.agg(
            F.struct(
                # the smallest value among those with the highest count
                F.min_by(F.when(known, F.col(c)), F.when(known, F.struct(-F.col("_n"), F.col(c)))).alias("value"),
                (F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)) / F.sum("_n")).alias("share"),
            ).alias("best")).scalar()
        df = df.withColumn("_best", best).withColumn(
            c, F.when(F.col("_best.share") < limit, F.coalesce(F.col(c), F.col("_best.value"))).otherwise(F.col(c))).drop("_best")
    return df


def fill_unknown(df: DataFrame, cols: list[str], text: str = "unknown") -> DataFrame:
    """NULLs of secondary fields to a marker text."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(text)) for c in cols})


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def clean_text(df: DataFrame, col: str, canon: dict[str, str] | None = None) -> DataFrame:
    """Line breaks and symbols to blanks, and keywords in their standard spelling ("python" -> "Python").

    `canon` is a short list of standard spellings; every word that equals one without regard to
    case takes that spelling, also next to punctuation or Han text.
    """
    out = clean_symbols(F.col(col))
    if canon:
        pairs = F.create_map(*[F.lit(x) for low, std in canon.items() for x in (low.lower(), std)])
        parts = F.regexp_extract_all(out, F.lit(WORD_OR_GAP), 0)
        out = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(pairs, F.lower(w)), w)), "")
    return df.withColumn(col, out)


def salary_fences(df: DataFrame, by: list[str], col: str = "salary_month_k", reach: float = 1.5) -> DataFrame:
    """Per group: q1, q3 and the fences q1 - reach*IQR, q3 + reach*IQR."""
    q = quantiles_of(ranked_counts(df, col, by), by, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"low_fence": F.col("q1") - F.lit(reach) * iqr, "high_fence": F.col("q3") + F.lit(reach) * iqr})


def flag_salary_outliers(df: DataFrame, by: list[str], col: str = "salary_month_k", reach: float = 1.5) -> DataFrame:
    """Add low_fence, high_fence of the row's group and `salary_outlier`; no row is removed.

    The fences (one row per group) are settled first, so the wide rows meet a table of known size.
    """
    fences = settle(salary_fences(df, by, col, reach).select(*by, "low_fence", "high_fence"))
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))  # NaN is no value
    flag = F.coalesce((value < F.col("low_fence")) | (value > F.col("high_fence")), F.lit(False))
    return same_keys(df, fences, by, "left").withColumn("salary_outlier", flag)


def contradiction(exp_min: Column, edu: Column, salary: Column, high_fence: Column, max_edu: float = 2.0) -> Column:
    """Long experience and low education asked for, with a salary above the group's high fence."""
    return F.coalesce((exp_min >= 5) & (edu <= max_edu) & (salary > high_fence), F.lit(False))


def flag_contradictions(df: DataFrame) -> DataFrame:
    """Add `contradiction`; needs the columns of `flag_salary_outliers`, exp_min and edu_level."""
    return df.withColumn(
        "contradiction",
        contradiction(F.col("exp_min"), F.col("edu_level"), F.col("salary_month_k"), F.col("high_fence")))
