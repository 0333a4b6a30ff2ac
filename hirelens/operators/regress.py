"""Linear salary models from moments: one pass over the rows, small algebra per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hirelens.constants import PUBLISHED_EQUATION
from hirelens.operators.describe import salary_group
from hirelens.operators.prefix import exact_quantiles
from hirelens.session import settle

FIT_FIELDS = "term string, estimate double, std_err double, t_value double, p_value double, std_coef double, r2 double, n long"


def _complete(df: DataFrame, y: str, xs: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in [y, *xs]]).dropna("any", subset=[y, *xs])


def moments(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group: row count, means and centred co-moments (sum of products of deviations) of y and all x.

    One aggregation with map-side partial results; rows with a NULL in y or any x are left out.
    """
    cols = [y, *xs]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [
        (F.covar_pop(cols[i], cols[j]) * F.count(F.lit(1))).alias(f"c{i}_{j}")
        for i in range(len(cols)) for j in range(i, len(cols))
    ]
    return _complete(df, y, xs, by or []).groupBy(*(by or [])).agg(*aggs)


def _tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: the incomplete beta function by its continued fraction."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    a, b = df / 2.0, 0.5
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_part(b, a, 1.0 - x)
    return _beta_part(a, b, x)


def _beta_part(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * value


def solve_moments(stats: DataFrame, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """Normal equations of every moments row: one output row per group and term.

    A group with fewer rows than terms, or with dependent regressors, gives NULL estimates.
    """
    by = by or []
    k = len(xs)
    schema = T.StructType([stats.schema[c] for c in by] + T.StructType.fromDDL(FIT_FIELDS).fields)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                n = int(rec["n"])
                mean = np.array([rec[f"m{i}"] for i in range(k + 1)], dtype=float)
                c = np.array([[rec[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
                keys = [rec[b] for b in by]
                free = n - k - 1
                sxx, sxy, syy = c[1:, 1:], c[1:, 0], c[0, 0]
                scale = np.sqrt(np.diag(sxx)) if n else np.zeros(k)
                usable = free >= 0 and np.all(scale > 0)
                corr = sxx / np.outer(scale, scale) if usable else None
                if not usable or np.linalg.cond(corr) > 1e10:
                    rows += [keys + [t, None, None, None, None, None, None, n] for t in ["const", *xs]]
                    continue
                inv = np.linalg.inv(corr) / np.outer(scale, scale)
                beta = inv @ sxy
                rss = max(syy - float(beta @ sxy), 0.0)
                const = mean[0] - float(beta @ mean[1:])
                s2 = rss / free if free > 0 else float("nan")
                errs = [math.sqrt(s2 * (1.0 / n + float(mean[1:] @ inv @ mean[1:])))] + [math.sqrt(s2 * v) for v in np.diag(inv)]
                std = [None] + [float(b * math.sqrt(v / syy)) if syy > 0 else None for b, v in zip(beta, np.diag(sxx))]
                r2 = 1.0 - rss / syy if syy > 0 else None
                for term, est, err, sc in zip(["const", *xs], [const, *beta], errs, std):
                    t = float(est) / err if err > 0 else float("nan")
                    p = _tail(t, free)
                    rows.append(keys + [term, float(est), _num(err), _num(t), _num(p), sc, r2, n])
            yield pd.DataFrame(rows, columns=schema.names)

    return stats.mapInPandas(fit, schema)


def _num(value: float) -> float | None:
    return None if math.isnan(value) else value


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Multiple linear regression: term, estimate, std_err, t_value, p_value, std_coef, r2, n."""
    return solve_moments(moments(df, y, xs), xs)


def ols_by(df: DataFrame, y: str, xs: list[str], by: list[str], z: float = 1.96) -> DataFrame:
    """The same model per group, with a confidence interval of z standard errors."""
    fits = solve_moments(moments(df, y, xs, by), xs, by)
    half = F.lit(z) * F.col("std_err")
    return fits.withColumns({"ci_low": F.col("estimate") - half, "ci_high": F.col("estimate") + half})


def ols_interaction(df: DataFrame, y: str, xs: list[str], a: str, b: str) -> DataFrame:
    """The model with the product a*b as one more regressor, named a_x_b."""
    name = f"{a}_x_{b}"
    return ols(df.withColumn(name, F.col(a).cast("double") * F.col(b).cast("double")), y, [*xs, name])


def std_coef(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Standardised coefficients by size: comparable where the raw ones are not."""
    return rank_by_size(ols(df, y, xs).where(F.col("term") != "const").select("term", "estimate", "std_coef"))


def rank_by_size(fit: DataFrame) -> DataFrame:
    """Rank the handful of terms of one fit by the size of their standardised coefficient."""
    return fit.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("std_coef")), "term")))


def contribution(df: DataFrame, y: str, xs: list[str], group_col: str | None = None) -> DataFrame:
    """Coefficient times group mean of every term, per salary group (or per `group_col`)."""
    group = group_col or "salary_group"
    rows = df if group_col else salary_group(df, y)
    means = _complete(rows, y, xs, [group]).groupBy(group).agg(*[F.avg(x).alias(x) for x in xs])
    long = means.select(group, F.inline(F.array(
        F.struct(F.lit("const").alias("term"), F.lit(1.0).alias("mean")),
        *[F.struct(F.lit(x).alias("term"), F.col(x).alias("mean")) for x in xs])))
    coef = ols(df, y, xs).select("term", "estimate")
    return long.join(coef, "term").select(group, "term", "mean", (F.col("estimate") * F.col("mean")).alias("contribution"))


def compare_sources(df: DataFrame, y: str, xs: list[str], sources: list[str], source: str = "source") -> DataFrame:
    """One row per term, one estimate column per source."""
    fits = solve_moments(moments(df.where(F.col(source).isin(sources)), y, xs, [source]), xs, [source])
    return fits.groupBy("term").pivot(source, sources).agg(F.first("estimate"))


def predict(df: DataFrame, coef: dict[str, float] | None = None, out: str = "predicted") -> DataFrame:
    """Score rows with a linear equation (default: the published one)."""
    coef = coef or PUBLISHED_EQUATION
    value = F.lit(coef.get("const", 0.0))
    for name, beta in coef.items():
        if name != "const":
            value = value + F.lit(beta) * F.col(name)
    return df.withColumn(out, value)


def leave_one_out(df: DataFrame, y: str, xs: list[str], by: str) -> DataFrame:
    """The model refitted without each group in turn, from moments alone: all groups minus one.

    The groups are pooled around the overall mean, so the rows are read once.
    """
    cols = range(len(xs) + 1)
    groups = settle(moments(df, y, xs, [by]))
    n = F.col("n").cast("double")
    all_means = groups.agg(F.struct(
        F.sum("n").alias("n"), *[(F.sum(n * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in cols]).alias("t")).scalar()
    shifted = groups.withColumn("_t", all_means)
    # sums and products of deviations from the overall mean: additive over groups
    dev = lambda i: F.col(f"m{i}") - F.col(f"_t.m{i}")
    shifted = shifted.select(
        by, "n",
        *[(n * dev(i)).alias(f"s{i}") for i in cols],
        *[(F.col(f"c{i}_{j}") + n * dev(i) * dev(j)).alias(f"q{i}_{j}") for i in cols for j in cols if j >= i])
    names = [f"s{i}" for i in cols] + [f"q{i}_{j}" for i in cols for j in cols if j >= i]
    totals = shifted.agg(F.struct(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).alias("t")).scalar()
    rest = shifted.withColumn("_a", totals).withColumn("_m", all_means).select(
        by, "_m", (F.col("_a.n") - F.col("n")).alias("n"), *[(F.col(f"_a.{c}") - F.col(c)).alias(c) for c in names])
    left = rest.where(F.col("n") > 0).select(
        by, "n",
        *[(F.col(f"_m.m{i}") + F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in cols],
        *[(F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"c{i}_{j}") for i in cols for j in cols if j >= i])
    return solve_moments(left, xs, [by]).withColumnRenamed(by, "left_out")


def trimmed_fit(df: DataFrame, y: str, xs: list[str], tail: float = 0.01) -> DataFrame:
    """The model without the rows in the two tails of y."""
    cuts = settle(exact_quantiles(df, y, [], {"low": tail, "high": 1.0 - tail}))
    both = cuts.select(F.struct("low", "high").alias("cuts")).scalar()
    kept = df.withColumn("_cuts", both).where(F.col(y).between(F.col("_cuts.low"), F.col("_cuts.high"))).drop("_cuts")
    return ols(kept, y, xs)


def sensitivity(df: DataFrame, y: str, xs: list[str], by: str, tail: float = 0.01) -> DataFrame:
    """Refits without each group and without the tails: (variant, term, estimate, n). The few columns needed are settled once."""
    df = settle(df.select(by, y, *xs))
    loo = leave_one_out(df, y, xs, by).select(
        F.concat(F.lit(f"without {by}="), F.coalesce(F.col("left_out").cast("string"), F.lit("NULL"))).alias("variant"), "term", "estimate", "n")
    trim = trimmed_fit(df, y, xs, tail).select(F.lit(f"without {tail:g} tails").alias("variant"), "term", "estimate", "n")
    return loo.unionByName(trim)
