"""Shares, summaries, rankings, trends and other descriptive tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelens.operators.prefix import quantiles_of, ranked_counts, ranked_rows, running_totals, same_keys, value_bucket, value_counts
from hirelens.session import settle


def category_share(df: DataFrame, col: str) -> DataFrame:
    """Rows and share per category, NULL being a category of its own."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def numeric_summary(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, exact median and sample standard deviation, over all rows or per group."""
    by = by or []
    counts = value_counts(df, col, by, keep_groups=True).withColumn("sum", F.col("n") * F.coalesce("value", F.lit(0.0)))
    ranked = running_totals(counts, ["n", "sum"], by, ["value"], value_bucket(F.col("value")))
    # the group mean is known on every row, so deviations are taken from it directly
    mean = F.try_divide(F.col("sum_total"), F.col("n_total"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    out = quantiles_of(ranked, by, {"median": 0.5}, {
        "n": n, "mean": F.max(mean), "_sq": F.sum(F.col("n") * (F.col("value") - mean) * (F.col("value") - mean))})
    return out.select(*by, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_sq") / (F.col("n") - 1))).alias("std"), "median")


def mean_by(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Rows and mean of `col` per group."""
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"))


def rank_groups(df: DataFrame, measure: str, tie: str, out: str = "rank") -> DataFrame:
    """Number the rows of a result table by a measure, highest first, however many groups it has."""
    return ranked_rows(df, [F.desc(measure), F.asc(tie)], out)


def rank_by_median(df: DataFrame, by: str, col: str) -> DataFrame:
    """Groups ranked by the exact median of `col`."""
    return rank_groups(numeric_summary(df, col, [by]).select(by, "n", "median"), "median", by)


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) and their share within a."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def composition(df: DataFrame, place: str, part: str) -> DataFrame:
    """What each place is made of; the known parts only."""
    return crosstab_share(df.where(F.col(part).isNotNull()), place, part)


def skill_freq(df: DataFrame, by: str = "job_type", skills: str = "skills") -> DataFrame:
    """Postings per group that ask for a skill, and their share of the group's postings."""
    size = df.groupBy(by).agg(F.count(F.lit(1)).alias("postings"))
    # a skill named twice in one posting counts once: made distinct inside the row, not by a shuffle
    per_skill = df.select(by, F.explode(F.array_distinct(skills)).alias("skill")).groupBy(by, "skill").agg(F.count(F.lit(1)).alias("n"))
    return same_keys(per_skill, size, [by]).withColumn("share", F.col("n") / F.col("postings"))


def skill_corr(df: DataFrame, col: str, skills: str = "skills") -> DataFrame:
    """Correlation of `col` with the presence (0/1) of each skill, from sums per skill; no column per skill."""
    known = df.where(F.col(col).isNotNull())
    y = F.col(col)
    total = known.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss")).alias("t")).scalar()
    per_skill = (
        known.select(F.explode(F.array_distinct(skills)).alias("skill"), y.alias("_y"))
        .groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_s"))
    ).withColumn("_t", total)
    n, s, ss, n1 = F.col("_t.n"), F.col("_t.s"), F.col("_t.ss"), F.col("n")
    spread = F.sqrt(n * ss - s * s) * F.sqrt(n * n1 - n1 * n1)
    return per_skill.select("skill", "n", F.try_divide(n * F.col("_s") - n1 * s, spread).alias("corr"))


def trend_counts(df: DataFrame, date: str, unit: str = "month", by: list[str] | None = None) -> DataFrame:
    """Rows per period with the change and growth against the period before (in the data)."""
    by = by or []
    periods = df.where(F.col(date).isNotNull()).groupBy(*by, F.to_date(F.date_trunc(unit, date)).alias("period")).agg(
        F.count(F.lit(1)).alias("n"))
    return _with_change(periods, "n", by)


def trend_salary(df: DataFrame, date: str, col: str, unit: str = "month", by: list[str] | None = None) -> DataFrame:
    """Mean and exact median of `col` per period, with the change of the mean."""
    by = by or []
    dated = df.where(F.col(date).isNotNull()).withColumn("period", F.to_date(F.date_trunc(unit, date)))
    return _with_change(numeric_summary(dated, col, [*by, "period"]).drop("std"), "mean", by)


def _with_change(periods: DataFrame, measure: str, by: list[str]) -> DataFrame:
    before = F.lag(measure).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("period"))
    return periods.withColumn("change", F.col(measure) - before).withColumn(
        "growth", F.try_divide(F.col("change"), F.col(measure) - F.col("change")))


def box_stats(df: DataFrame, col: str, by: list[str], reach: float = 1.5) -> DataFrame:
    """Box-plot table per group: five numbers, whisker ends and the number of points beyond them."""
    counts = settle(ranked_counts(df, col, by))  # distinct values: read for the quartiles, then for the whiskers
    q = quantiles_of(counts, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fenced = same_keys(counts, q, by)
    inside = F.col("value").between(F.col("q1") - F.lit(reach) * iqr, F.col("q3") + F.lit(reach) * iqr)
    return fenced.groupBy(*by, "q1", "median", "q3").agg(
        F.sum("n").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def histogram(df: DataFrame, col: str, width: float) -> DataFrame:
    """Counts and shares of bins [k*width, (k+1)*width); empty bins are left out."""
    bins = df.where(F.col(col).isNotNull()).groupBy((F.floor(F.col(col) / F.lit(width)) * F.lit(width)).alias("bin_from")).agg(
        F.count(F.lit(1)).alias("n"))
    return bins.withColumn("share", F.col("n") / bins.agg(F.sum("n")).scalar())


def share_above(df: DataFrame, col: str, cut: float) -> DataFrame:
    """Number and share of values above a cut."""
    above = F.count_if(F.col(col) > cut)
    return df.agg(F.count(col).alias("n"), above.alias("above"), F.try_divide(above, F.count(col)).alias("share_above"))


def premium(df: DataFrame, by: str, base: str, col: str) -> DataFrame:
    """Mean of each group over the mean of the base group."""
    means = mean_by(df, [by], col)
    return means.withColumn("premium", F.col("mean") / means.where(F.col(by) == base).select("mean").scalar())


def with_city_tier(df: DataFrame, tiers: DataFrame, city: str = "city") -> DataFrame:
    """Add the columns of a (city, ...) table; a city without an entry gets NULLs."""
    return df.join(tiers, city, "left")


def city_map(df: DataFrame, places: DataFrame, col: str, city: str = "city") -> DataFrame:
    """Count and mean per city with the columns of a place table: aggregated first, joined after."""
    return with_city_tier(mean_by(df, [city], col), places, city)


def top_k(df: DataFrame, parent: list[str], k: int, *order: str | Column, out: str = "rank") -> DataFrame:
    """The first k rows per parent. Each task cuts to k rows per parent before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*parent).orderBy(*order))).where(F.col(out) <= k)


def overview(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source and the number of sources."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("sources", counts.agg(F.count(source)).scalar())


def sample_rows(df: DataFrame, order: str, k: int = 5, source: str = "source") -> DataFrame:
    """The first k rows of every source, as a sample to show."""
    return top_k(df, [source], k, order)


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise correlations in long form (a, b, corr), all from one pass; rows with a NULL are left out per pair."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cell = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("corr"))
    cells = [cell(c, c, F.lit(1.0)) for c in cols]
    for i, (a, b) in enumerate(pairs):
        cells += [cell(a, b, F.col(f"c{i}")), cell(b, a, F.col(f"c{i}"))]
    return wide.select(F.inline(F.array(*cells)))


def salary_group(df: DataFrame, col: str, q: float = 0.25, cuts_from: DataFrame | None = None) -> DataFrame:
    """Add `salary_group`: 'low' up to the q quantile, 'high' from the 1-q quantile on, else 'middle'; NULL stays NULL.

    `cuts_from`: the same rows before joins that the quantiles do not need.
    """
    cuts = settle(quantiles_of(ranked_counts(df if cuts_from is None else cuts_from, col, []), [], {"low_cut": q, "high_cut": 1.0 - q}))
    both = cuts.select(F.struct("low_cut", "high_cut").alias("cuts")).scalar()
    marked = df.withColumn("_cuts", both)
    return marked.withColumn(
        "salary_group",
        F.when(F.col(col) <= F.col("_cuts.low_cut"), "low").when(F.col(col) >= F.col("_cuts.high_cut"), "high")
        .when(F.col(col).isNotNull(), "middle")).drop("_cuts")


def quartile_profile(df: DataFrame, col: str, measures: list[str], cuts_from: DataFrame | None = None) -> DataFrame:
    """Means of the measures for the bottom and the top salary quarter; `cuts_from` as in `salary_group`."""
    ends = salary_group(df, col, cuts_from=cuts_from).where(F.col("salary_group").isin("low", "high"))
    return ends.groupBy("salary_group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures])
