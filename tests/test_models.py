import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hirelens.operators import causal as M
from hirelens.operators import regress as R


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(13)
    n = 900
    edu, exp, sim = rng.integers(0, 6, n), rng.choice([0, 0.5, 2, 4, 7.5, 12], n), rng.uniform(0, 1, n)
    pay = 8.1 + 2.8 * edu + 1.7 * exp + 58 * sim + 0.05 * rng.normal(size=n)
    group = rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1])
    rows = [(i, str(g), float(e), float(x), float(s), float(p)) for i, (g, e, x, s, p) in enumerate(zip(group, edu, exp, sim, pay))]
    return spark.createDataFrame(rows, "id long, g string, edu_level double, exp_level double, similarity double, pay double").cache()


XS = ["edu_level", "exp_level", "similarity"]


def test_ols_recovers_planted_values(planted):
    fit = {r["term"]: r for r in R.ols(planted, "pay", XS).collect()}
    for term, want in {"const": 8.1, "edu_level": 2.8, "exp_level": 1.7, "similarity": 58.0}.items():
        assert abs(fit[term]["estimate"] - want) < 0.03 and fit[term]["p_value"] < 0.001
    assert fit["const"]["r2"] > 0.999 and fit["const"]["n"] == 900


def test_errors_and_p_values_match_ml(planted):
    noisy = planted.withColumn("pay", F.col("id") % 17 + 0.05 * F.col("edu_level"))
    fit = {r["term"]: r for r in R.ols(noisy, "pay", XS).collect()}
    data = VectorAssembler(inputCols=XS, outputCol="f").transform(noisy)
    summary = LinearRegression(featuresCol="f", labelCol="pay", solver="normal").fit(data).summary
    for i, term in enumerate([*XS, "const"]):
        assert math.isclose(fit[term]["std_err"], summary.coefficientStandardErrors[i], rel_tol=1e-6)
        assert math.isclose(fit[term]["p_value"], summary.pValues[i], rel_tol=1e-6, abs_tol=1e-12)


def test_leave_one_out_equals_refit(planted):
    got = {(r["left_out"], r["term"]): r["estimate"] for r in R.leave_one_out(planted, "pay", XS, "g").collect()}
    for g in "abc":
        for r in R.ols(planted.where(F.col("g") != g), "pay", XS).collect():
            assert math.isclose(got[g, r["term"]], r["estimate"], rel_tol=1e-8)


def test_degenerate_groups_give_null(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0, 3.0), ("y", 1.0, 1.0, 5.0), ("y", 2.0, 2.0, 6.0), ("y", 3.0, 3.0, 8.0)], "g string, a double, b double, pay double")
    rows = R.ols_by(df, "pay", ["a", "b"], ["g"]).collect()
    assert len(rows) == 6 and all(r["estimate"] is None for r in rows)


def test_contribution_adds_up_to_group_means(planted):
    got = R.contribution(planted, "pay", XS, "g").groupBy("g").agg(F.sum("contribution").alias("s"))
    means = {r["g"]: r["m"] for r in planted.groupBy("g").agg(F.avg("pay").alias("m")).collect()}
    assert all(abs(r["s"] - means[r["g"]]) < 0.1 for r in got.collect())


def test_predict_uses_the_published_equation(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.5)], "edu_level double, exp_level double, similarity double")
    assert math.isclose(R.predict(df).first()["predicted"], 8.10 + 2.81 * 3 + 1.70 * 4 + 58.0 * 0.5)


@pytest.mark.parametrize("digits,caliper", [(2, 0.03), (6, 0.005), (1, 0.15)])
def test_nearest_controls_match_brute_force(spark, digits, caliper):
    rng = random.Random(digits)
    rows = [(i, rng.random() < 0.2, round(rng.random() ** 3, digits), rng.uniform(1, 50)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, t boolean, score double, y double")
    got = {r["score"]: (r["m_id"], r["m_y"]) for r in M.nearest_controls(df, "t", "score", "id", ["y"], caliper).collect()}
    controls = [(s, i, y) for i, t, s, y in rows if not t]
    want = {}
    for s in {s for _, t, s, _ in rows if t}:
        near = [(round(abs(s - c), 12), i, y) for c, i, y in controls if abs(s - c) <= caliper]
        if near:
            want[s] = min(near)[1:]
    assert got == want
    pairs = M.matched_pairs(df, "t", "score", "id", ["y"], caliper).count()
    hits = [(y, want[s][1]) for _, t, s, y in rows if t and s in want]
    att = M.psm_att(df, "t", "y", "score", "id", caliper).first()
    assert pairs == att["n_matched"] == len(hits)
    assert math.isclose(att["att"], sum(a - b for a, b in hits) / len(hits), rel_tol=1e-9)


def test_balance_improves(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        e = rng.randint(0, 5)
        rows.append((i, rng.random() < 0.1 + 0.12 * e, float(e)))
    df = M.propensity(spark.createDataFrame(rows, "id long, t boolean, e double"), "t", ["e"])
    row = M.balance(df, "t", "score", "id", ["e"], 0.01).first()
    assert abs(row["smd_before"]) > 0.3 and abs(row["smd_after"]) < 1e-9


def test_logistic_propensity_matches_cells(spark):
    rows = [(i, i % 10 < (3 if i % 2 else 6), "x" if i % 2 else "y") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, t boolean, c string")
    got = {r["c"]: r["s"] for r in M.logistic_propensity(df, "t", ["c"], []).groupBy("c").agg(F.avg("score").alias("s")).collect()}
    want = {r["c"]: r["score"] for r in M.propensity_cells(df, "t", ["c"]).collect()}
    assert all(abs(got[c] - want[c]) < 1e-3 for c in want)


def test_placebo(planted):
    out = M.placebo(planted, "similarity", "pay", "id", 40, F.floor(F.col("id") / 100)).first()
    assert out["true_slope"] > 50 and out["as_large"] == 0 and math.isclose(out["p_value"], 1 / 41)
    assert abs(out["placebo_mean"]) < 3 * out["placebo_std"] / math.sqrt(40) + 1.0
    one = M.placebo_slopes(planted, "similarity", "pay", "id", 5, F.floor(F.col("id") / 100))
    assert one.count() == 5 and sorted(one.collect()) == sorted(one.collect())


def test_trimmed_fit_drops_the_tails(planted):
    assert R.trimmed_fit(planted, "pay", XS, 0.01).first()["n"] == 900 - 18
