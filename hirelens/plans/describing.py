"""Queries on descriptive results and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.constants import FLOW_BANDS, MEAN_BANDS
from hirelens.functions.levels import career_stage
from hirelens.functions.salary import flow_band
from hirelens.operators import charts as G
from hirelens.operators import describe as D
from hirelens.operators import sketches as K
from hirelens.plans.registry import as_double, as_long, query, rounded
from hirelens.plans.views import CLEAN_SQL, MODELLED_SQL, POSTINGS_SQL, clean, modelled, postings, table, tag_rows_sql, with_tags
from hirelens.session import settle

Y = "salary_month_k"


@query(f"WITH {POSTINGS_SQL} SELECT city, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM postings), 6) AS share FROM postings GROUP BY 1")
def category_share(spark, sf_dir):
    return rounded(D.category_share(postings(spark, sf_dir), "city"), "share")


_SUMMARY = f"count({Y}) AS n, round(avg({Y}), 6) AS mean, round(stddev_samp({Y}), 6) AS std, round(quantile_cont({Y}, 0.5), 6) AS median"


@query(f"WITH {CLEAN_SQL} SELECT job_type, {_SUMMARY} FROM clean GROUP BY 1")
def numeric_summary(spark, sf_dir):
    return rounded(D.numeric_summary(clean(spark, sf_dir), Y, ["job_type"]), "mean", "std", "median")


@query(f"WITH {CLEAN_SQL} SELECT {_SUMMARY} FROM clean")
def numeric_summary_all(spark, sf_dir):
    return rounded(D.numeric_summary(clean(spark, sf_dir), Y), "mean", "std", "median")


@query(f"""WITH {POSTINGS_SQL}, c AS (SELECT raw_education, raw_experience, count(*) AS n FROM postings GROUP BY 1, 2)
SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY raw_education), 6) AS row_share FROM c""")
def crosstab_share(spark, sf_dir):
    return rounded(D.crosstab_share(postings(spark, sf_dir), "raw_education", "raw_experience"), "row_share")


@query(f"""WITH {POSTINGS_SQL}, c AS (SELECT city, raw_education, count(*) AS n FROM postings GROUP BY 1, 2)
SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY city), 6) AS row_share FROM c""")
def composition(spark, sf_dir):
    return rounded(D.composition(postings(spark, sf_dir), "city", "raw_education"), "row_share")


@query(f"""WITH {POSTINGS_SQL}, {tag_rows_sql('p_name')}, size AS (SELECT job_type, count(*) AS postings FROM postings GROUP BY 1),
s AS (SELECT job_type, tag AS skill, count(*) AS n FROM postings JOIN tag_rows USING (job_id) GROUP BY 1, 2)
SELECT job_type, skill, n, postings, round(n::DOUBLE / postings, 6) AS share FROM s JOIN size USING (job_type)""")
def skill_freq(spark, sf_dir):
    rows = with_tags(postings(spark, sf_dir).select("job_id", "job_type"), spark, sf_dir, "p_name", "skills")
    return rounded(D.skill_freq(rows), "share")


@query(f"""WITH {CLEAN_SQL}, {tag_rows_sql('p_name')}, known AS (SELECT job_id, {Y} AS y FROM clean WHERE {Y} IS NOT NULL),
pairs AS (SELECT s.skill, k.y, CASE WHEN t.tag IS NULL THEN 0.0 ELSE 1.0 END AS has
  FROM known k CROSS JOIN (SELECT DISTINCT tag AS skill FROM tag_rows) s LEFT JOIN tag_rows t ON t.job_id = k.job_id AND t.tag = s.skill)
SELECT skill, CAST(sum(has) AS BIGINT) AS n, round(corr(y, has), 6) AS corr FROM pairs GROUP BY 1""")
def skill_corr(spark, sf_dir):
    rows = with_tags(clean(spark, sf_dir).select("job_id", Y), spark, sf_dir, "p_name", "skills")
    return rounded(D.skill_corr(rows, Y), "corr")


_CHANGE = "lag({0}) OVER (ORDER BY period)"


@query(f"""WITH c AS (SELECT date_trunc('month', o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT *, {_CHANGE.format('n')} AS before FROM c)
SELECT strftime(period, '%Y-%m-%d') AS period, n, CAST(n - before AS DOUBLE) AS change, round((n - before)::DOUBLE / before, 6) AS growth FROM l""")
def trend_counts(spark, sf_dir):
    out = D.trend_counts(table(spark, sf_dir, "orders"), "o_orderdate", "month")
    return rounded(as_double(out, "change").withColumn("period", F.date_format("period", "yyyy-MM-dd")), "growth")


@query(f"""WITH {CLEAN_SQL}, c AS (SELECT date_trunc('month', o_orderdate) AS period, count({Y}) AS n, avg({Y}) AS mean, quantile_cont({Y}, 0.5) AS median FROM clean GROUP BY 1),
l AS (SELECT *, {_CHANGE.format('mean')} AS before FROM c)
SELECT strftime(period, '%Y-%m-%d') AS period, n, round(mean, 6) AS mean, round(median, 6) AS median, round(mean - before, 6) AS change, round((mean - before) / before, 6) AS growth FROM l""")
def trend_salary(spark, sf_dir):
    out = D.trend_salary(clean(spark, sf_dir), "o_orderdate", Y, "month")
    return rounded(out.withColumn("period", F.date_format("period", "yyyy-MM-dd")), "mean", "median", "change", "growth")


@query(f"""WITH {CLEAN_SQL}, v AS (SELECT job_type, round({Y}, 6) AS v FROM clean WHERE {Y} IS NOT NULL),
q AS (SELECT job_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1),
f AS (SELECT *, v BETWEEN q1 - 0.5::DOUBLE * (q3 - q1) AND q3 + 0.5::DOUBLE * (q3 - q1) AS inside FROM v JOIN q USING (job_type))
SELECT job_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n, min(v) AS min, max(v) AS max,
  min(v) FILTER (inside) AS low_whisker, max(v) FILTER (inside) AS high_whisker, count(*) FILTER (NOT inside) AS outliers FROM f GROUP BY 1, 2, 3, 4""")
def box_stats(spark, sf_dir):
    return rounded(D.box_stats(rounded(clean(spark, sf_dir), Y), Y, ["job_type"], 0.5), "q1", "median", "q3")


_ERROR, _PROBS = 0.02, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


@query(f"""WITH {CLEAN_SQL}, p AS (SELECT unnest([{', '.join(f"'{k}'" for k in _PROBS)}]) AS quantile)
SELECT job_type, quantile, count({Y}) AS n, true AS within_error FROM clean, p GROUP BY 1, 2""")
def sketch_quantiles(spark, sf_dir):
    """Quantiles by job type out of merged sketches by city and job type, each held against its true rank."""
    rows = rounded(clean(spark, sf_dir), Y).select("city", "job_type", Y)
    parts = settle(K.sketched(rows, Y, ["city", "job_type"], _ERROR))
    found = settle(K.sketch_quantiles(K.merged(parts, ["job_type"]), ["job_type"], _PROBS))
    ranks = rows.join(found.drop("n"), "job_type").groupBy("job_type").agg(
        F.count(Y).alias("n"), *[F.count_if(F.col(Y) < F.col(q)).alias(f"{q}_below") for q in _PROBS], *[F.count_if(F.col(Y) <= F.col(q)).alias(f"{q}_to") for q in _PROBS])
    each = F.explode(F.array(*[F.struct(
        F.lit(q).alias("quantile"),
        # the value holds the ranks from _below to _to
        ((F.col(f"{q}_below") <= (p + _ERROR) * F.col("n")) & (F.col(f"{q}_to") >= (p - _ERROR) * F.col("n"))).alias("within_error")) for q, p in _PROBS.items()]))
    return ranks.select("job_type", "n", each.alias("e")).select("job_type", "e.quantile", "n", "e.within_error")


@query(f"""WITH {CLEAN_SQL}, v AS (SELECT round({Y}, 6) AS v FROM clean WHERE {Y} IS NOT NULL)
SELECT floor(v / 5.0::DOUBLE) * 5.0::DOUBLE AS bin_from, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM v), 6) AS share FROM v GROUP BY 1""")
def histogram(spark, sf_dir):
    return rounded(D.histogram(rounded(clean(spark, sf_dir), Y), Y, 5.0), "share")


@query(f"""WITH {CLEAN_SQL} SELECT count({Y}) AS n, count(*) FILTER ({Y} > 50) AS above, round(count(*) FILTER ({Y} > 50)::DOUBLE / count({Y}), 6) AS share_above FROM clean""")
def share_above(spark, sf_dir):
    return rounded(D.share_above(clean(spark, sf_dir), Y, 50.0), "share_above")


@query(f"""WITH {CLEAN_SQL}, m AS (SELECT city, count({Y}) AS n, round(quantile_cont({Y}, 0.5), 6) AS median FROM clean GROUP BY 1)
SELECT city, n, median, row_number() OVER (ORDER BY median DESC, city) AS rank FROM m""")
def rank_by_median(spark, sf_dir):
    return as_long(D.rank_by_median(rounded(clean(spark, sf_dir), Y), "city", Y).withColumn("median", F.round("median", 6)), "rank")


@query(f"""WITH {CLEAN_SQL}, m AS (SELECT raw_education, count({Y}) AS n, avg({Y}) AS mean FROM clean GROUP BY 1)
SELECT raw_education, n, round(mean, 6) AS mean, round(mean / (SELECT mean FROM m WHERE raw_education = '本科'), 6) AS premium FROM m""")
def premium(spark, sf_dir):
    return rounded(D.premium(clean(spark, sf_dir), "raw_education", "本科", Y), "mean", "premium")


@query(f"WITH {CLEAN_SQL} SELECT company_size, {_SUMMARY} FROM clean GROUP BY 1")
def salary_by_size(spark, sf_dir):
    return rounded(D.numeric_summary(clean(spark, sf_dir), Y, ["company_size"]), "mean", "std", "median")


_STAGE = "CASE WHEN exp_level < 2 THEN 'junior' WHEN exp_level < 7.5 THEN 'middle' WHEN exp_level < 12 THEN 'senior' WHEN exp_level >= 12 THEN 'expert' END"


@query(f"WITH {CLEAN_SQL} SELECT {_STAGE} AS stage, count({Y}) AS n, round(avg({Y}), 6) AS mean FROM clean GROUP BY 1")
def salary_by_stage(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumn("stage", career_stage(F.col("exp_level")))
    return rounded(D.mean_by(rows, ["stage"], Y), "mean")


@query(f"WITH {CLEAN_SQL} SELECT city_tier, r_name AS region, count({Y}) AS n, round(avg({Y}), 6) AS mean FROM clean JOIN region ON city_tier = r_regionkey GROUP BY 1, 2")
def city_tier_salary(spark, sf_dir):
    tiers = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("city"), F.col("r_name").alias("region"))
    rows = D.with_city_tier(clean(spark, sf_dir), tiers)
    return rounded(D.mean_by(rows, ["city_tier", "region"], Y), "mean")


@query(f"WITH {CLEAN_SQL} SELECT city, count({Y}) AS n, round(avg({Y}), 6) AS mean, n_nationkey AS x, n_regionkey AS y FROM clean JOIN nation ON city = n_name GROUP BY 1, 4, 5")
def city_map(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y"))
    return rounded(D.city_map(clean(spark, sf_dir), places, Y), "mean")


_RANKS = f"""{CLEAN_SQL}, v AS (SELECT job_type, round({Y}, 6) AS v FROM clean WHERE {Y} IS NOT NULL)"""


@query(f"""WITH {_RANKS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY v) AS i FROM v)
SELECT job_type, count(*) AS n, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1)::DOUBLE / count(*), 6) AS gini FROM r GROUP BY 1""")
def gini_by_type(spark, sf_dir):
    return rounded(G.gini(rounded(clean(spark, sf_dir), Y), Y, ["job_type"]), "gini")


@query(f"""WITH {_RANKS}, r AS (SELECT *, row_number() OVER (ORDER BY v) AS i FROM v)
SELECT count(*) AS n, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1)::DOUBLE / count(*), 6) AS gini FROM r""")
def gini_all(spark, sf_dir):
    return rounded(G.gini(rounded(clean(spark, sf_dir), Y), Y), "gini")


@query(f"""WITH {_RANKS}, g AS (SELECT job_type, v AS value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT job_type, value, n, round(sum(n) OVER w::DOUBLE / sum(n) OVER (PARTITION BY job_type), 6) AS people_share,
  round(sum(n * value) OVER w / sum(n * value) OVER (PARTITION BY job_type), 6) AS income_share
FROM g WINDOW w AS (PARTITION BY job_type ORDER BY value)""")
def lorenz_points(spark, sf_dir):
    return rounded(G.lorenz(rounded(clean(spark, sf_dir), Y), Y, ["job_type"]), "people_share", "income_share")


@query(f"""WITH {CLEAN_SQL}, c AS (SELECT city, job_type, round(round(avg({Y}), 6), 1) AS mean FROM clean WHERE {Y} IS NOT NULL GROUP BY 1, 2)
SELECT city, job_type, dense_rank() OVER (ORDER BY job_type) - 1 AS x, dense_rank() OVER (ORDER BY city) - 1 AS y, mean FROM c""")
def matrix_mean(spark, sf_dir):
    return as_long(G.matrix_mean(clean(spark, sf_dir), "city", "job_type", Y), "x", "y")


_TREE = f"""{CLEAN_SQL}, c AS (SELECT city, job_type, count(*) AS n, round(round(avg({Y}), 6), 1) AS mean_salary FROM clean GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, job_type) AS rank FROM c)"""


@query(f"""WITH {_TREE} SELECT city, job_type, n, mean_salary, rank, CAST(sum(n) OVER (PARTITION BY city) AS BIGINT) AS parent_value,
concat(job_type, chr(10), '(', printf('%.1f', mean_salary), 'K)') AS label FROM r WHERE rank <= 3""")
def treemap(spark, sf_dir):
    return as_long(G.treemap(clean(spark, sf_dir), "city", "job_type", Y, 3), "rank")


@query(f"""WITH {_TREE} SELECT city, concat('{{"name":"', city, '","value":', CAST(sum(n) AS BIGINT), ',"children":[', string_agg(
concat('{{"name":"', job_type, '\\n(', printf('%.1f', mean_salary), 'K)","value":', n, ',"avgSalary":', mean_salary, '}}'), ',' ORDER BY rank), ']}}') AS node
FROM r WHERE rank <= 3 GROUP BY city""")
def treemap_nodes(spark, sf_dir):
    """Nested JSON for the chart."""
    return G.treemap_json(G.treemap(clean(spark, sf_dir), "city", "job_type", Y, 3), "city")


_FLOW = f"CASE WHEN {Y} < 10 THEN '{FLOW_BANDS[0]}' WHEN {Y} < 20 THEN '{FLOW_BANDS[1]}' WHEN {Y} <= 35 THEN '{FLOW_BANDS[2]}' ELSE '{FLOW_BANDS[3]}' END"
_PATHS = f"""{CLEAN_SQL}, p AS (SELECT raw_education AS a, raw_experience AS b, {_FLOW.replace(Y, f'round({Y}, 6)')} AS c FROM clean
WHERE raw_education IS NOT NULL AND raw_experience IS NOT NULL AND {Y} IS NOT NULL)"""


def _paths(spark, sf_dir):
    rows = rounded(clean(spark, sf_dir), Y)
    return G.sankey(rows, ["raw_education", "raw_experience", flow_band(F.col(Y))])


@query(f"""WITH {_PATHS} SELECT 1 AS stage, a AS source, b AS target, count(*) AS value FROM p GROUP BY 2, 3
UNION ALL SELECT 2, b, c, count(*) FROM p GROUP BY 2, 3""")
def sankey3(spark, sf_dir):
    return _paths(spark, sf_dir)


@query(f"WITH {_PATHS} SELECT a AS name FROM p UNION SELECT b FROM p UNION SELECT c FROM p")
def sankey3_nodes(spark, sf_dir):
    return G.flow_nodes(_paths(spark, sf_dir))


_MEANS = f"{CLEAN_SQL}, m AS (SELECT job_type AS source, round(avg({Y}), 6) AS value FROM clean WHERE {Y} IS NOT NULL GROUP BY 1)"
_BANDS = "CASE " + " ".join(f"WHEN value <= {edge} THEN '{label}'" for edge, label in MEAN_BANDS[:-1]) + f" ELSE '{MEAN_BANDS[-1][1]}' END"


@query(f"WITH {_MEANS} SELECT source, {_BANDS} AS target, value FROM m")
def mean_band_flow(spark, sf_dir):
    return G.mean_band_flow(clean(spark, sf_dir), "job_type", Y)


@query(f"WITH {_MEANS} SELECT source AS name FROM m UNION " + " UNION ".join(f"SELECT '{label}'" for _, label in MEAN_BANDS))
def mean_band_nodes(spark, sf_dir):
    return G.mean_band_nodes(G.mean_band_flow(clean(spark, sf_dir), "job_type", Y))


_CUTS = "(SELECT quantile_cont(y, {0}) FROM (SELECT round(salary_month_k, 6) AS y FROM {1}) z)"


@query(f"""WITH {MODELLED_SQL}, g AS (SELECT *, CASE WHEN round({Y}, 6) <= {_CUTS.format(0.25, 'modelled')} THEN 'low'
WHEN round({Y}, 6) >= {_CUTS.format(0.75, 'modelled')} THEN 'high' END AS salary_group FROM modelled)
SELECT salary_group, count(*) AS n, round(avg(edu_level), 6) AS edu_level, round(avg(exp_level), 6) AS exp_level, round(avg(similarity), 6) AS similarity
FROM g WHERE salary_group IS NOT NULL GROUP BY 1""")
def quartile_profile(spark, sf_dir):
    measures = ["edu_level", "exp_level", "similarity"]
    rows, salaries = rounded(modelled(spark, sf_dir), Y), rounded(clean(spark, sf_dir).select(Y), Y)
    return rounded(D.quartile_profile(rows, Y, measures, salaries), *measures)


@query(f"""WITH {CLEAN_SQL}, g AS (SELECT city, CASE WHEN round({Y}, 6) <= {_CUTS.format(0.1, 'clean')} THEN 'low'
WHEN round({Y}, 6) >= {_CUTS.format(0.9, 'clean')} THEN 'high' WHEN {Y} IS NOT NULL THEN 'middle' END AS salary_group FROM clean)
SELECT city, salary_group, count(*) AS n FROM g GROUP BY 1, 2""")
def salary_group(spark, sf_dir):
    grouped = D.salary_group(rounded(clean(spark, sf_dir), Y), Y, 0.1)
    return grouped.groupBy("city", "salary_group").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POSTINGS_SQL} SELECT source, count(*) AS n, (SELECT count(DISTINCT source) FROM postings) AS sources FROM postings GROUP BY 1")
def overview(spark, sf_dir):
    return D.overview(postings(spark, sf_dir))


@query(f"""WITH {CLEAN_SQL} SELECT source, job_id, title, raw_salary, round({Y}, 6) AS {Y}, city, rank FROM (
SELECT *, row_number() OVER (PARTITION BY source ORDER BY job_id) AS rank FROM clean) x WHERE rank <= 5""")
def sample_rows(spark, sf_dir):
    shown = D.sample_rows(clean(spark, sf_dir).select("source", "job_id", "title", "raw_salary", Y, "city"), "job_id", 5)
    return rounded(as_long(shown, "rank"), Y)


_CORR = [Y, "edu_level", "exp_level", "similarity"]


@query(f"WITH {MODELLED_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + " AS corr FROM "
    + ("(SELECT 1) o" if a == b else "modelled") for a in _CORR for b in _CORR))
def corr_matrix(spark, sf_dir):
    return rounded(D.corr_matrix(modelled(spark, sf_dir), _CORR), "corr")
