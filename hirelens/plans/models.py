"""Queries on salary models and causal checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.operators import causal as M
from hirelens.operators import regress as R
from hirelens.plans.registry import as_double, as_long, query, rounded
from hirelens.plans.views import CLEAN_SQL, MODELLED_SQL, clean, modelled
from hirelens.session import settle

Y = "salary_month_k"
XS = ["edu_level", "exp_level", "similarity"]


# --- SQL twin of the normal equations -------------------------------------------------------

def _det(m: list[list[str]]) -> str:
    """Determinant of a small matrix of SQL expressions, written out by minors."""
    if len(m) == 1:
        return m[0][0]
    terms = []
    for j, head in enumerate(m[0]):
        minor = [[v for i, v in enumerate(row) if i != j] for row in m[1:]]
        terms.append(f"{'-' if j % 2 else '+'} {head} * ({_det(minor)})")
    return "(" + " ".join(terms) + ")"


def ols_sql(source: str, xs: list[str], by: str | None = None, y: str = Y) -> str:
    """CTEs ending in fit(by, term, estimate, std_err, t_value, std_coef, r2, n) in closed form."""
    k, keys = len(xs), f"{by} AS g" if by else "0 AS g"
    c = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    cols = [y, *xs]
    mom = ", ".join([f"avg({v}) AS m{i}" for i, v in enumerate(cols)]
                    + [f"covar_pop({cols[i]}, {cols[j]}) * count(*) AS c{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)])
    s = [[c(i, j) for j in range(1, k + 1)] for i in range(1, k + 1)]
    minor = lambda i, j: [[v for b, v in enumerate(row) if b != j] for a, row in enumerate(s) if a != i]
    inv = ", ".join(
        f"{'-' if (i + j) % 2 else ''}({_det(minor(i, j)) if k > 1 else '1.0'}) / det AS v{i + 1}_{j + 1}" for i in range(k) for j in range(k))
    beta = ", ".join("(" + " + ".join(f"v{i}_{j} * c0_{j}" for j in range(1, k + 1)) + f") AS b{i}" for i in range(1, k + 1))
    const = "m0" + "".join(f" - b{i} * m{i}" for i in range(1, k + 1))
    rss = "c0_0" + "".join(f" - b{i} * c0_{i}" for i in range(1, k + 1))
    quad = " + ".join(f"m{i} * m{j} * v{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1))
    rows = [f"SELECT g, 'const' AS term, b0 AS estimate, sqrt(s2 * (1.0 / n + {quad})) AS std_err, NULL::DOUBLE AS std_coef, r2, n FROM e"]
    rows += [f"SELECT g, '{x}', b{i}, sqrt(s2 * v{i}_{i}), b{i} * sqrt(c{i}_{i} / c0_0), r2, n FROM e" for i, x in enumerate(xs, 1)]
    return f"""mo AS (SELECT {keys}, count(*) AS n, {mom} FROM {source} WHERE {' AND '.join(f'{v} IS NOT NULL' for v in cols)} GROUP BY 1),
dt AS (SELECT *, {_det(s)} AS det FROM mo), iv AS (SELECT *, {inv} FROM dt), be AS (SELECT *, {beta} FROM iv),
ee AS (SELECT *, {const} AS b0, {rss} AS rss FROM be), e AS (SELECT *, rss / (n - {k + 1}) AS s2, 1 - rss / c0_0 AS r2 FROM ee),
fit AS ({' UNION ALL '.join(rows)})"""


# bounds of |t| at 5, 1 and 0.1 percent: those of the normal distribution with the first term in 1 / degrees of freedom
_BOUND = [f"(abs(estimate / std_err) > {z} + {(z**3 + z) / 4} / n)::INT" for z in (1.959964, 2.575829, 3.290527)]
_OUT = f"{' + '.join(_BOUND)} AS p_level, term, round(estimate, 4) AS estimate, round(std_err, 4) AS std_err, round(estimate / std_err, 4) AS t_value, round(r2, 6) AS r2, n"


def _fit(df: DataFrame) -> DataFrame:
    """`p_level`: how many of the levels 5, 1 and 0.1 percent the p-value is below."""
    level = sum((F.col("p_value") < p).cast("int") for p in (0.05, 0.01, 0.001))
    return rounded(rounded(df.withColumn("p_level", level).drop("p_value", "std_coef"), "estimate", "std_err", "t_value", digits=4), "r2")


@query(f"WITH {MODELLED_SQL}, {ols_sql('modelled', XS)} SELECT {_OUT} FROM fit")
def ols_salary(spark, sf_dir):
    return _fit(R.ols(modelled(spark, sf_dir), Y, XS))


@query(f"""WITH {MODELLED_SQL}, i AS (SELECT *, edu_level * similarity AS edu_level_x_similarity FROM modelled),
{ols_sql('i', XS + ['edu_level_x_similarity'])} SELECT {_OUT} FROM fit""")
def ols_interaction(spark, sf_dir):
    return _fit(R.ols_interaction(modelled(spark, sf_dir), Y, XS, "edu_level", "similarity"))


@query(f"""WITH {MODELLED_SQL}, {ols_sql('modelled', XS, 'city_tier')} SELECT g AS city_tier, {_OUT},
round(estimate - 1.96 * std_err, 4) AS ci_low, round(estimate + 1.96 * std_err, 4) AS ci_high FROM fit""")
def ols_by_tier(spark, sf_dir):
    return rounded(_fit(R.ols_by(modelled(spark, sf_dir), Y, XS, ["city_tier"])), "ci_low", "ci_high", digits=4)


@query(f"""WITH {MODELLED_SQL}, {ols_sql('modelled', XS)} SELECT term, round(estimate, 4) AS estimate, round(std_coef, 6) AS std_coef,
row_number() OVER (ORDER BY abs(std_coef) DESC, term) AS rank FROM fit WHERE term <> 'const'""")
def std_coef(spark, sf_dir):
    return as_long(rounded(rounded(R.std_coef(modelled(spark, sf_dir), Y, XS), "estimate", digits=4), "std_coef"), "rank")


@query(f"""WITH {MODELLED_SQL}, {ols_sql('modelled', XS)},
q AS (SELECT quantile_cont(round({Y}, 6), 0.25) AS q1, quantile_cont(round({Y}, 6), 0.75) AS q3 FROM modelled),
g AS (SELECT CASE WHEN round({Y}, 6) <= q1 THEN 'low' WHEN round({Y}, 6) >= q3 THEN 'high' ELSE 'middle' END AS salary_group, edu_level, exp_level, similarity
  FROM modelled, q WHERE {Y} IS NOT NULL AND edu_level IS NOT NULL AND exp_level IS NOT NULL AND similarity IS NOT NULL),
m AS (SELECT salary_group, avg(edu_level) AS e, avg(exp_level) AS x, avg(similarity) AS s FROM g GROUP BY 1),
l AS (SELECT salary_group, 'const' AS term, 1.0::DOUBLE AS mean FROM m UNION ALL SELECT salary_group, 'edu_level', e FROM m
  UNION ALL SELECT salary_group, 'exp_level', x FROM m UNION ALL SELECT salary_group, 'similarity', s FROM m)
SELECT salary_group, term, round(mean, 6) AS mean, round(estimate * mean, 4) AS contribution FROM l JOIN fit USING (term)""")
def contribution(spark, sf_dir):
    out = R.contribution(rounded(modelled(spark, sf_dir), Y), Y, XS)
    return rounded(rounded(out, "mean"), "contribution", digits=4)


_TWO = ["BOSS直聘", "前程无忧 (51job)"]


@query(f"""WITH {MODELLED_SQL}, {ols_sql('modelled', XS, 'source')}
SELECT term, round(max(estimate) FILTER (g = '{_TWO[0]}'), 4) AS boss, round(max(estimate) FILTER (g = '{_TWO[1]}'), 4) AS job51 FROM fit GROUP BY 1""")
def compare_sources(spark, sf_dir):
    out = R.compare_sources(modelled(spark, sf_dir), Y, XS, _TWO)
    return rounded(out.withColumnsRenamed(dict(zip(_TWO, ["boss", "job51"]))), "boss", "job51", digits=4)


@query(f"WITH {MODELLED_SQL} SELECT job_id, round(8.10 + 2.81 * edu_level + 1.70 * exp_level + 58.00 * similarity, 6) AS predicted FROM modelled")
def predict(spark, sf_dir):
    return rounded(R.predict(modelled(spark, sf_dir)).select("job_id", "predicted"), "predicted")


_XS2 = ["edu_level", "exp_level"]


@query(f"""WITH {CLEAN_SQL}, cities AS (SELECT DISTINCT city AS left_out FROM clean), loo AS (SELECT * FROM clean JOIN cities ON city <> left_out),
{ols_sql('loo', _XS2, 'left_out')} SELECT g AS left_out, {_OUT} FROM fit""")
def leave_one_city_out(spark, sf_dir):
    return _fit(R.leave_one_out(clean(spark, sf_dir), Y, _XS2, "city"))


@query(f"""WITH {CLEAN_SQL}, r AS (SELECT * REPLACE (round({Y}, 6) AS {Y}) FROM clean), q AS (SELECT quantile_cont({Y}, 0.01) AS lo, quantile_cont({Y}, 0.99) AS hi FROM r),
cut AS (SELECT r.* FROM r, q WHERE {Y} BETWEEN lo AND hi), cities AS (SELECT DISTINCT city AS left_out FROM clean),
both_ AS (SELECT r.*, concat('without city=', left_out) AS variant FROM r JOIN cities ON city <> left_out
  UNION ALL SELECT cut.*, 'without 0.01 tails' FROM cut),
{ols_sql('both_', _XS2, 'variant')} SELECT g AS variant, term, round(estimate, 4) AS estimate, n FROM fit""")
def sensitivity(spark, sf_dir):
    return rounded(R.sensitivity(rounded(clean(spark, sf_dir), Y), Y, _XS2, "city"), "estimate", digits=4)


# --- matching -------------------------------------------------------------------------------

COVS = ["edu_level", "exp_level", "city"]
CALIPER = 0.02


def treated_rows(spark, sf_dir) -> DataFrame:
    """Clean postings with known salary and covariates; the treated ones name a high-level size."""
    rows = clean(spark, sf_dir).where(F.col(Y).isNotNull() & F.col("exp_level").isNotNull())
    return rounded(rows.withColumn("treated", (F.col("job_id") * 7919 % 10 + F.col("edu_level")) >= 8), Y)


TREATED_SQL = f"""{CLEAN_SQL}, tr AS (SELECT * REPLACE (round({Y}, 6) AS {Y}), (job_id * 7919 % 10 + edu_level) >= 8 AS treated
  FROM clean WHERE {Y} IS NOT NULL AND exp_level IS NOT NULL)"""
SCORED_SQL = f"""{TREATED_SQL},
sc AS (SELECT *, round(avg(CASE WHEN treated THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY edu_level, exp_level, city), 9) AS score FROM tr)"""
# for every distinct treated score: the nearest control score, then the smallest id
PICKS_SQL = f"""{SCORED_SQL},
ctl AS (SELECT score, min(job_id) AS u FROM sc WHERE NOT treated GROUP BY 1),
want AS (SELECT DISTINCT score FROM sc WHERE treated),
near AS (SELECT w.score, c.u, round(abs(w.score - c.score), 12) AS distance,
  row_number() OVER (PARTITION BY w.score ORDER BY round(abs(w.score - c.score), 12), c.u) AS rn
  FROM want w JOIN ctl c ON abs(w.score - c.score) <= {CALIPER}::DOUBLE),
picks AS (SELECT n.score, n.u AS m_job_id, n.distance, c.{Y} AS m_{Y}, c.edu_level AS m_edu_level, c.exp_level AS m_exp_level
  FROM near n JOIN sc c ON c.job_id = n.u WHERE rn = 1)"""


def scored(spark, sf_dir) -> DataFrame:
    return rounded(M.propensity(treated_rows(spark, sf_dir), "treated", COVS), "score", digits=9)


@query(f"""WITH {TREATED_SQL} SELECT edu_level, exp_level, city, count(*) AS n,
round(avg(CASE WHEN treated THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM tr GROUP BY 1, 2, 3""")
def propensity_cells(spark, sf_dir):
    return rounded(M.propensity_cells(treated_rows(spark, sf_dir), "treated", COVS), "score")


@query(f"WITH {PICKS_SQL} SELECT s.job_id, m_job_id, round(distance, 9) AS distance FROM sc s JOIN picks p ON s.score = p.score WHERE s.treated")
def matched_pairs(spark, sf_dir):
    pairs = M.matched_pairs(scored(spark, sf_dir), "treated", "score", "job_id", [Y], CALIPER)
    return rounded(pairs.select("job_id", "m_job_id", "distance"), "distance", digits=9)


@query(f"""WITH {PICKS_SQL}, t AS (SELECT s.{Y} AS y, p.m_{Y} AS m FROM sc s LEFT JOIN picks p ON s.score = p.score WHERE s.treated)
SELECT count(*) AS n_treated, count(m) AS n_matched, round(avg(y) FILTER (m IS NOT NULL), 6) AS mean_treated, round(avg(m), 6) AS mean_matched,
  round(avg(y - m), 6) AS att FROM t""")
def psm_att(spark, sf_dir):
    out = M.psm_att(scored(spark, sf_dir), "treated", Y, "score", "job_id", CALIPER)
    return rounded(out, "mean_treated", "mean_matched", "att")


@query(f"""WITH {PICKS_SQL}, b AS (SELECT """ + ", ".join(
    f"avg({c}) FILTER (treated) - avg({c}) FILTER (NOT treated) AS d_{c}, sqrt((var_samp({c}) FILTER (treated) + var_samp({c}) FILTER (NOT treated)) / 2) AS s_{c}"
    for c in _XS2) + """ FROM sc), a AS (SELECT """ + ", ".join(f"avg(s.{c}) - avg(p.m_{c}) AS a_{c}" for c in _XS2)
    + """ FROM sc s JOIN picks p ON s.score = p.score WHERE s.treated) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS covariate, round(d_{c} / s_{c}, 6) AS smd_before, round(a_{c} / s_{c}, 6) AS smd_after FROM a, b" for c in _XS2))
def balance(spark, sf_dir):
    out = M.balance(scored(spark, sf_dir), "treated", "score", "job_id", _XS2, CALIPER)
    return rounded(out, "smd_before", "smd_after")


@query(f"""WITH {TREATED_SQL}, k AS (SELECT * FROM tr WHERE treated IS NOT NULL)
SELECT concat('city ', city) AS balanced, count(*) AS n, CAST(count(*) FILTER (treated) AS DOUBLE) AS total FROM k GROUP BY city
UNION ALL SELECT 'edu_level', count(*), CAST(sum(edu_level) FILTER (treated) AS DOUBLE) FROM k
UNION ALL SELECT 'exp_level', count(*), CAST(sum(exp_level) FILTER (treated) AS DOUBLE) FROM k
UNION ALL SELECT 'no score', count(*), 0.0::DOUBLE FROM tr WHERE treated IS NULL""")
def ml_propensity(spark, sf_dir):
    """At the maximum, scores add up to the treated rows of each city, and to their covariates overall (to the nearest half)."""
    rows = settle(M.logistic_propensity(treated_rows(spark, sf_dir), "treated", ["city"], ["edu_level", "exp_level"]).select("city", "edu_level", "exp_level", "score"))
    half = lambda c: (F.round(F.sum(c) * 2) / 2).alias("total")
    known, n = rows.where("score IS NOT NULL"), F.count(F.lit(1)).alias("n")
    out = known.groupBy(F.concat(F.lit("city "), "city").alias("balanced")).agg(n, half(F.col("score")))
    for c in ("edu_level", "exp_level"):
        out = out.unionByName(known.agg(F.lit(c).alias("balanced"), n, half(F.col("score") * F.col(c))))
    return out.unionByName(rows.where("score IS NULL").agg(F.lit("no score").alias("balanced"), n, F.lit(0.0).alias("total")))


# --- placebo --------------------------------------------------------------------------------

DRAWS = 20
_MIX = f"((job_id % {M.MIX_PRIME}) * ({M.MIX_BASE} + {M.MIX_STEP} * k) % {M.MIX_PRIME})"
PLACEBO_SQL = f"""{CLEAN_SQL}, r AS (SELECT job_id, edu_level AS x, round({Y}, 6) AS y, job_id // 1000 AS b FROM clean WHERE edu_level IS NOT NULL AND {Y} IS NOT NULL),
ks AS (SELECT unnest(range(1, {DRAWS + 1})) AS k),
ry AS (SELECT b, y, row_number() OVER (PARTITION BY b ORDER BY job_id) AS i FROM r),
rx AS (SELECT b, k, x, row_number() OVER (PARTITION BY b, k ORDER BY ({_MIX} * {_MIX} + k) % {M.MIX_PRIME}, job_id) AS i FROM r, ks),
s AS (SELECT k, regr_slope(y, x) AS slope FROM rx JOIN ry USING (b, i) GROUP BY 1)"""


def _bucket():
    # ids in ranges of a thousand: a bucket stays small whatever the size of the table
    return F.floor(F.col("job_id") / 1000)


@query(f"WITH {PLACEBO_SQL} SELECT CAST(k AS INT) AS draw, round(slope, 6) AS slope FROM s")
def placebo_slopes(spark, sf_dir):
    rows = rounded(clean(spark, sf_dir), Y)
    return rounded(M.placebo_slopes(rows, "edu_level", Y, "job_id", DRAWS, _bucket()), "slope")


@query(f"""WITH {PLACEBO_SQL}, t AS (SELECT regr_slope(y, x) AS true_slope FROM r)
SELECT round(true_slope, 6) AS true_slope, count(*) AS draws, round(avg(slope), 6) AS placebo_mean, round(stddev_samp(slope), 6) AS placebo_std,
  count(*) FILTER (abs(slope) >= abs(true_slope)) AS as_large,
  round((count(*) FILTER (abs(slope) >= abs(true_slope)) + 1)::DOUBLE / (count(*) + 1), 6) AS p_value FROM s, t GROUP BY true_slope""")
def placebo(spark, sf_dir):
    rows = rounded(clean(spark, sf_dir), Y)
    out = M.placebo(rows, "edu_level", Y, "job_id", DRAWS, _bucket())
    return rounded(out, "true_slope", "placebo_mean", "placebo_std", "p_value")
