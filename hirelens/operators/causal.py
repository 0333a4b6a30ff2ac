"""Propensity, nearest-control matching, balance and placebo checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelens.operators.prefix import same_keys
from hirelens.session import settle


# --- propensity -----------------------------------------------------------------------------

def propensity_cells(df: DataFrame, treated: str, covs: list[str]) -> DataFrame:
    """Share of treated rows in every cell of the covariates: the saturated model, exact."""
    return df.groupBy(*covs).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(treated).cast("double")).alias("score"))


def propensity(df: DataFrame, treated: str, covs: list[str]) -> DataFrame:
    """Add `score`, the treated share of the row's cell. The cells are settled, then joined."""
    cells = settle(propensity_cells(df, treated, covs).select(*covs, "score"))
    return same_keys(df, cells, covs, "left")


def logistic_propensity(df: DataFrame, treated: str, categorical: list[str], numeric: list[str], max_iter: int = 100) -> DataFrame:
    """Add `score` from a logistic model, for covariates that are not all categorical.

    The fit runs on distinct covariate rows weighted by their count, which gives the same maximum
    and is read many times. Rows with a NULL covariate or treatment are left out of the fit; their score is
    NULL. Categorical covariates have few labels (their list is held by the driver). A fit that has not
    converged after `max_iter` rounds raises.
    """
    rows = df.dropna("any", subset=[treated, *categorical, *numeric])
    covs = [*categorical, *numeric]
    cells = settle(
        rows.groupBy(*covs, F.col(treated).cast("double").alias("_label")).agg(F.count(F.lit(1)).cast("double").alias("_weight")))
    indexed, encoded = [f"_i_{c}" for c in categorical], [f"_e_{c}" for c in categorical]
    steps = []
    if categorical:
        steps = [
            StringIndexer(inputCols=categorical, outputCols=indexed, stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded),
        ]
    steps += [
        VectorAssembler(inputCols=[*encoded, *numeric], outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_prob", maxIter=max_iter, tol=1e-9),
    ]
    model = Pipeline(stages=steps).fit(cells)
    if model.stages[-1].summary.totalIterations >= max_iter:
        raise RuntimeError(f"the logistic fit has not converged after {max_iter} rounds")
    scores = settle(model.transform(cells).withColumn("score", vector_to_array("_prob")[1]).select(*covs, "score").distinct())
    return same_keys(df, scores, covs, "left").withColumn("score", F.when(F.col(treated).isNotNull(), F.col("score")))


# --- matching -------------------------------------------------------------------------------

def nearest_controls(
    df: DataFrame, treated: str, score: str, unit: str, carry: list[str], caliper: float,
) -> DataFrame:
    """For every distinct score of a treated row: the control with the nearest score within the caliper.

    With replacement; of controls with one score the smallest id counts, and so it does between a
    control below and one above at the same distance. Rows collapse to distinct scores first, and
    the nearest one below and above is found by carrying values along the sorted scores inside
    narrow score buckets, so no treated-control pairs are formed. Columns: score, m_<unit>, m_<carry>...,
    distance.
    """
    t = F.col(treated).cast("boolean")
    s = F.col(score).cast("double") + F.lit(0.0)
    control = F.struct(F.col(unit).alias("unit"), *[F.col(c).alias(c) for c in carry])
    points = (
        df.where(t.isNotNull() & F.col(score).isNotNull())
        .groupBy(s.alias("score"))
        .agg(
            F.max(t).alias("wanted"),
            F.min_by(F.when(~t, control), F.when(~t, F.col(unit))).alias("control"))
    )
    points = settle(points)  # used by rows and by buckets: the full table is read once
    # bucket far finer than the caliper; the nearest control may lie in another bucket, so each
    # bucket also hands its first and last control on to its neighbours
    width = F.lit(float(caliper) / 8.0)
    held = F.when(F.col("control").isNotNull(), F.struct("score", "control"))
    points = points.withColumns({"_bucket": F.floor(F.col("score") / width), "_held": held})
    up = Window.partitionBy("_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"_below": F.last("_held", True).over(up), "_above": F.last("_held", True).over(down)})
    ends = points.groupBy("_bucket").agg(
        F.max_by("_held", F.when(F.col("_held").isNotNull(), F.col("score"))).alias("_last"),
        F.min_by("_held", F.when(F.col("_held").isNotNull(), F.col("score"))).alias("_first"))
    # buckets are few: the range of scores over the width
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "_bucket", F.last("_last", True).over(before).alias("_last_before"), F.last("_first", True).over(after).alias("_first_after"))
    found = points.where("wanted").join(ends, "_bucket").select(
        "score", F.coalesce("_below", "_last_before").alias("_below"), F.coalesce("_above", "_first_after").alias("_above"))
    distance = lambda side: F.abs(F.col("score") - F.col(f"{side}.score"))
    choice = F.least(*[
        F.when(distance(side) <= F.lit(float(caliper)), F.struct(
            # twelve decimals: equal distances above and below must not differ by rounding noise
            F.round(distance(side), 12).alias("distance"), F.col(f"{side}.control.unit").alias("unit"), F.col(f"{side}.control").alias("control")))
        for side in ("_below", "_above")])
    return found.select("score", choice.alias("_pick")).where(F.col("_pick").isNotNull()).select(
        "score", F.col("_pick.unit").alias(f"m_{unit}"),
        *[F.col(f"_pick.control.{c}").alias(f"m_{c}") for c in carry],
        F.col("_pick.distance").alias("distance"))


def matched_pairs(
    df: DataFrame, treated: str, score: str, unit: str, carry: list[str], caliper: float,
) -> DataFrame:
    """Treated rows (unit, score, carry...) with the columns of their matched control; unmatched ones are left out."""
    picks = settle(nearest_controls(df, treated, score, unit, carry, caliper))
    rows = df.where(F.col(treated).cast("boolean")).select(unit, (F.col(score).cast("double") + F.lit(0.0)).alias("score"), *carry)
    return rows.join(picks, "score")


def psm_att(df: DataFrame, treated: str, y: str, score: str, unit: str, caliper: float) -> DataFrame:
    """Effect on the treated: mean of y minus the matched control's y, over matched treated rows.

    Treated rows are summed per score before they meet the matches.
    """
    rows = df.where(F.col(y).isNotNull())
    picks = nearest_controls(rows, treated, score, unit, [y], caliper)
    sums = rows.where(F.col(treated).cast("boolean") & F.col(score).isNotNull()).groupBy(
        (F.col(score).cast("double") + F.lit(0.0)).alias("score")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"))
    both = sums.join(picks, "score", "left")
    hit = F.col(f"m_{unit}").isNotNull()
    n = F.sum(F.when(hit, F.col("_n")))
    return both.agg(
        F.sum("_n").alias("n_treated"),
        F.coalesce(n, F.lit(0)).alias("n_matched"),
        F.try_divide(F.sum(F.when(hit, F.col("_y"))), n).alias("mean_treated"),
        F.try_divide(F.sum(F.when(hit, F.col("_n") * F.col(f"m_{y}"))), n).alias("mean_matched"),
    ).withColumn("att", F.col("mean_treated") - F.col("mean_matched"))


def balance(df: DataFrame, treated: str, score: str, unit: str, covs: list[str], caliper: float) -> DataFrame:
    """Standardised mean difference of every covariate before and after matching.

    Both are scaled by the spread before matching. After matching, treated rows are compared with
    their matched controls, each control weighted by how often it was taken.
    """
    t = F.col(treated).cast("boolean")
    before = df.agg(*[
        agg for i, c in enumerate(covs) for agg in (
            F.avg(F.when(t, F.col(c))).alias(f"t{i}"), F.avg(F.when(~t, F.col(c))).alias(f"c{i}"),
            F.var_samp(F.when(t, F.col(c))).alias(f"vt{i}"), F.var_samp(F.when(~t, F.col(c))).alias(f"vc{i}"))])
    picks = nearest_controls(df, treated, score, unit, covs, caliper)
    sums = df.where(t & F.col(score).isNotNull()).groupBy((F.col(score).cast("double") + F.lit(0.0)).alias("score")).agg(
        *[agg for i, c in enumerate(covs) for agg in (F.count(c).alias(f"_n{i}"), F.sum(c).alias(f"_s{i}"))],
        F.count(F.lit(1)).alias("_n"))
    after = sums.join(picks, "score").agg(*[
        agg for i, c in enumerate(covs) for agg in (
            F.try_divide(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(f"mt{i}"),
            F.try_divide(F.sum(F.col("_n") * F.col(f"m_{c}")), F.sum(F.when(F.col(f"m_{c}").isNotNull(), F.col("_n")))).alias(f"mc{i}"))])
    wide = before.withColumn("_after", after.select(F.struct("*").alias("s")).scalar())
    entries = []
    for i, c in enumerate(covs):
        spread = F.sqrt((F.col(f"vt{i}") + F.col(f"vc{i}")) / F.lit(2.0))
        entries.append(F.struct(
            F.lit(c).alias("covariate"),
            F.try_divide(F.col(f"t{i}") - F.col(f"c{i}"), spread).alias("smd_before"),
            F.try_divide(F.col(f"_after.mt{i}") - F.col(f"_after.mc{i}"), spread).alias("smd_after")))
    return wide.select(F.inline(F.array(*entries)))


# --- placebo --------------------------------------------------------------------------------

# The two rounds of integer mixing that order rows for draw k.
MIX_PRIME, MIX_BASE, MIX_STEP = 2147483647, 48271, 15838


def shuffle_keys(ids: np.ndarray, k: int) -> np.ndarray:
    """Pseudo-random integers that order the rows of a bucket for draw k (ties are broken by id)."""
    h = (ids % MIX_PRIME) * (MIX_BASE + MIX_STEP * k) % MIX_PRIME
    return (h * h + k) % MIX_PRIME


def placebo_slopes(df: DataFrame, x: str, y: str, unit: str, k: int, bucket: Column) -> DataFrame:
    """Slope of y on x after shuffling x inside each bucket, for draws 1..k: (draw, slope).

    A shuffle changes only the sum of products, so each bucket sends k numbers instead of k copies
    of its rows. `bucket` must hold a bounded number of rows (some thousands), for example the id
    divided into ranges or the id modulo a number that grows with the table; any bucket fixed
    without regard to the outcome gives a valid restricted permutation.
    """
    rows = df.select(
        F.col(unit).cast("long").alias("u"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        bucket.cast("long").alias("b")).dropna("any")

    def draws(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        u, xv, yv = (pdf[c].to_numpy() for c in ("u", "x", "y"))
        sums = [float(np.dot(xv[np.argsort(shuffle_keys(u, i), kind="stable")], yv)) for i in range(1, k + 1)]
        return pd.DataFrame({"draw": np.arange(1, k + 1, dtype=np.int32), "sxy": sums})

    products = rows.groupBy("b").applyInPandas(draws, "draw int, sxy double").groupBy("draw").agg(F.sum("sxy").alias("sxy"))
    fixed = rows.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx")).alias("f")).scalar()
    return products.withColumn("_f", fixed).select(
        "draw", F.try_divide(F.col("sxy") / F.col("_f.n") - F.col("_f.mx") * F.col("_f.my"), F.col("_f.vx")).alias("slope"))


def placebo(df: DataFrame, x: str, y: str, unit: str, k: int, bucket: Column) -> DataFrame:
    """True slope against k shuffled ones: their mean, spread and the empirical two-sided p-value."""
    true = df.agg(F.regr_slope(y, x).alias("s")).scalar()
    slopes = placebo_slopes(df, x, y, unit, k, bucket).withColumn("true_slope", true)
    return slopes.groupBy("true_slope").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("slope").alias("placebo_mean"), F.stddev_samp("slope").alias("placebo_std"),
        F.count_if(F.abs("slope") >= F.abs("true_slope")).alias("as_large"),
    ).withColumn("p_value", (F.col("as_large") + 1) / (F.col("draws") + 1))
