"""Queries on cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.functions.dates import parse_dates as parse_dates_
from hirelens.functions.levels import map_ordinal as map_ordinal_
from hirelens.functions.levels import ordinal_table
from hirelens.functions.salary import salary_band3
from hirelens.operators import clean as K
from hirelens.operators import describe as D
from hirelens.plans.registry import as_double, as_long, query, rounded
from hirelens.plans.views import CLEAN_SQL, POSTINGS_SQL, clean, postings, texts

_BAND = "CASE WHEN {0} < 8 THEN 'low' WHEN {0} <= 20 THEN 'medium' WHEN {0} > 20 THEN 'high' END"


@query(f"""WITH {CLEAN_SQL}, m AS (SELECT city, count(salary_month_k) AS n, round(avg(salary_month_k), 6) AS mean FROM clean GROUP BY 1)
SELECT city, n, mean, row_number() OVER (ORDER BY mean DESC, city) AS rank FROM m""")
def city_mean_salary(spark, sf_dir):
    means = rounded(D.mean_by(clean(spark, sf_dir), ["city"], "salary_month_k"), "mean")
    return as_long(D.rank_groups(means, "mean", "city"), "rank")


@query(f"""WITH {CLEAN_SQL} SELECT job_id, raw_salary, round(salary_min_k, 6) AS salary_min_k, round(salary_max_k, 6) AS salary_max_k,
round(salary_month_k, 6) AS salary_month_k, salary_status, {_BAND.format('salary_month_k')} AS salary_band3 FROM clean""")
def salary_parse(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumn("salary_band3", salary_band3(F.col("salary_month_k")))
    return rounded(
        rows.select("job_id", "raw_salary", "salary_min_k", "salary_max_k", "salary_month_k", "salary_status", "salary_band3"),
        "salary_min_k", "salary_max_k", "salary_month_k")


@query(f"""WITH {CLEAN_SQL} SELECT job_id, raw_education, edu_level, raw_experience, exp_level,
CAST(exp_min AS DOUBLE) AS exp_min, CAST(exp_max AS DOUBLE) AS exp_max FROM clean""")
def edu_exp_levels(spark, sf_dir):
    rows = clean(spark, sf_dir).select("job_id", "raw_education", "edu_level", "raw_experience", "exp_level", "exp_min", "exp_max")
    return as_double(rows, "exp_min", "exp_max")


@query(f"WITH {CLEAN_SQL} SELECT edu_level, exp_level, count(*) AS n FROM clean GROUP BY 1, 2")
def map_ordinal(spark, sf_dir):
    """Levels through a join with the label tables."""
    rows = postings(spark, sf_dir).select("raw_education", "raw_experience")
    rows = map_ordinal_(rows, "raw_education", ordinal_table(spark, "education"), "edu_level")
    rows = map_ordinal_(rows, "raw_experience", ordinal_table(spark, "experience"), "exp_level")
    return rows.groupBy("edu_level", "exp_level").agg(F.count(F.lit(1)).alias("n"))


_PROFILED = ["job_id", "raw_salary", "raw_education", "raw_experience", "recruits", "released_raw", "company"]


@query("WITH " + POSTINGS_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing, "
    f"round((count(*) - count({c}))::DOUBLE / count(*), 6) AS missing_share, '{'bigint' if c in ('job_id', 'recruits') else 'string'}' AS data_type FROM postings" for c in _PROFILED))
def missing_profile(spark, sf_dir):
    profile = K.missing_profile(postings(spark, sf_dir).select(*_PROFILED))
    return rounded(profile, "missing_share")


@query(f"WITH {POSTINGS_SQL} SELECT job_id, city, raw_experience FROM postings")
def drop_sparse(spark, sf_dir):
    """The column that is empty in nine rows of ten goes; one that lacks a third stays."""
    rows = postings(spark, sf_dir).select(
        "job_id", "city", "raw_experience", F.when(F.col("job_id") % 10 == 0, F.col("city")).alias("rare"))
    return K.drop_sparse(rows, 0.5)


@query(f"""WITH {POSTINGS_SQL} SELECT job_id, coalesce(recruits, (SELECT recruits FROM postings WHERE recruits IS NOT NULL
  GROUP BY recruits ORDER BY count(*) DESC, recruits LIMIT 1)) AS recruits, raw_experience FROM postings""")
def impute_mode(spark, sf_dir):
    """A fifth of recruits is missing and filled under a limit of a quarter; experience lacks more and stays."""
    return K.impute_mode(postings(spark, sf_dir).select("job_id", "recruits", "raw_experience"), ["recruits", "raw_experience"], 0.25)


@query(f"WITH {POSTINGS_SQL} SELECT job_id, coalesce(CAST(recruits AS VARCHAR), 'unknown') AS recruits, coalesce(raw_experience, 'unknown') AS raw_experience FROM postings")
def fill_unknown(spark, sf_dir):
    return K.fill_unknown(postings(spark, sf_dir).select("job_id", "recruits", "raw_experience"), ["recruits", "raw_experience"])


@query(f"""WITH {POSTINGS_SQL} SELECT raw_experience, CAST(recruits AS DOUBLE) AS recruits, count(*) AS n FROM postings
WHERE raw_experience IS NOT NULL OR recruits IS NOT NULL GROUP BY 1, 2""")
def drop_empty_rows(spark, sf_dir):
    rows = K.drop_empty_rows(postings(spark, sf_dir).select("raw_experience", "recruits"))
    return as_double(rows, "recruits").groupBy("raw_experience", "recruits").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {POSTINGS_SQL} SELECT job_id, released_raw, strftime(coalesce(try_strptime(regexp_replace(released_raw, '^released on ', ''), '%Y-%m-%d'),
try_strptime(regexp_replace(released_raw, '^released on ', ''), '%B %d %Y')), '%Y-%m-%d') AS released FROM postings""")
def parse_dates(spark, sf_dir):
    rows = parse_dates_(postings(spark, sf_dir).select("job_id", "released_raw"), "released_raw")
    return rows.withColumn("released", F.date_format("released", "yyyy-MM-dd"))


_CANON = {"the": "The", "les": "LES", "und": "Und"}


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[^0-9A-Za-zÀ-ÖØ-öø-ɏ\x{4e00}-\x{9fff}+#.,;:!?，。；：！？、%/-]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(s, '[0-9A-Za-zÀ-ÖØ-öø-ɏ+#]+|[^0-9A-Za-zÀ-ÖØ-öø-ɏ+#]+'), lambda w: CASE lower(w) """
       + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CANON.items()) + """ ELSE w END), '') AS text FROM t""")
def clean_text(spark, sf_dir):
    return K.clean_text(texts(spark, sf_dir, "documents", "doc_id", "text"), "text", _CANON)


def _fenced(reach: float) -> str:
    return f"""{CLEAN_SQL},
q AS (SELECT job_type, quantile_cont(salary_month_k, 0.25) AS q1, quantile_cont(salary_month_k, 0.75) AS q3 FROM clean GROUP BY 1),
fenced AS (SELECT c.*, round(q1 - {reach}::DOUBLE * (q3 - q1), 6) AS low_fence, round(q3 + {reach}::DOUBLE * (q3 - q1), 6) AS high_fence FROM clean c JOIN q USING (job_type))"""


@query(f"""WITH {_fenced(0.5)} SELECT job_id, low_fence, high_fence,
CASE WHEN round(salary_month_k, 6) < low_fence OR round(salary_month_k, 6) > high_fence THEN 1 ELSE 0 END AS salary_outlier FROM fenced""")
def salary_outliers(spark, sf_dir):
    flagged = K.flag_salary_outliers(clean(spark, sf_dir), ["job_type"], reach=0.5)
    return rounded(flagged.select("job_id", "low_fence", "high_fence", F.col("salary_outlier").cast("int").alias("salary_outlier")), "low_fence", "high_fence")


@query(f"""WITH {_fenced(0.25)} SELECT job_id, raw_experience, raw_education FROM fenced
WHERE exp_min >= 5 AND edu_level <= 2 AND round(salary_month_k, 6) > high_fence""")
def contradictions(spark, sf_dir):
    flagged = K.flag_contradictions(K.flag_salary_outliers(clean(spark, sf_dir), ["job_type"], reach=0.25))
    return flagged.where("contradiction").select("job_id", "raw_experience", "raw_education")
