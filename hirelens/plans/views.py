"""The given tables seen as job postings, in Spark and as SQL text with the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.constants import EDUCATION_LEVELS, EXPERIENCE_LEVELS, SALARY_PATTERN
from hirelens.functions.levels import edu_level, exp_level, parse_experience
from hirelens.functions.salary import parse_salary
from hirelens.operators.textmine import similarity, term_lists, tokenise
from hirelens.session import stored

# Labels that the view hands out by key.
SOURCES = ["BOSS直聘", "前程无忧 (51job)", "智联招聘"]
VIEW_EDUCATION = ["高中", "本科", "硕士", "初中及以下", "学历不限", "中专/中技", "大专"]
VIEW_EXPERIENCE = ["3-5年", "5-10年", "10年以上", "经验不限", "1年以内", "在校/应届", "1-3年"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(labels: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(labels)) + " END"


def _salary_text(string: str) -> str:
    """The seven salary spellings; `string` is the engine's text type."""
    t = lambda e: f"cast({e} as {string})"
    return f"""CASE o_orderkey % 7
      WHEN 0 THEN concat({t('lo')}, '-', {t('hi')}, 'K')
      WHEN 1 THEN concat({t('lo')}, '-', {t('hi')}, 'K·13薪')
      WHEN 2 THEN concat({t('cast(lo as double) / 10')}, '-', {t('cast(hi as double) / 10')}, '万/月')
      WHEN 3 THEN concat({t('lo * 46')}, '-', {t('hi * 46')}, '元/天')
      WHEN 4 THEN concat({t('cast(lo * 6 as double) / 5')}, '-', {t('cast(hi * 6 as double) / 5')}, '万/年')
      WHEN 5 THEN concat({t('lo')}, 'k-', {t('hi')}, 'k/month')
      ELSE '面议' END"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw posting per order."""
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    ends = joined.selectExpr("*", "cast(floor(o_totalprice / 10000) as int) + 3 AS lo").selectExpr(
        "*", "lo + 5 + cast(o_orderkey % 16 as int) AS hi")
    return ends.selectExpr(
        "o_orderkey AS job_id",
        f"{_pick(SOURCES, 'o_orderkey % 3')} AS source",
        "c_mktsegment AS title",
        "c_mktsegment AS job_type",
        "c_mktsegment AS industry",
        "c_name AS company",
        "n_name AS city",
        "n_regionkey AS city_tier",
        f"{_salary_text('string')} AS raw_salary",
        f"{_pick(VIEW_EDUCATION, 'o_custkey % 7')} AS raw_education",
        f"{_pick(VIEW_EXPERIENCE, 'o_orderkey % 11')} AS raw_experience",
        "CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "ELSE concat('released on ', date_format(o_orderdate, 'MMMM d yyyy')) END AS released_raw",
        "concat('size', cast(cast(floor((c_acctbal + 1000) / 2200) as int) as string)) AS company_size",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 END AS recruits",
        "c_mktsegment AS keyword",
        "cast(o_orderkey div 30 as int) AS page_no",
        "cast(o_orderkey % 30 as int) AS pos_in_page",
        "o_orderdate",
    )


POSTINGS_SQL = f"""ends AS (
  SELECT *, lo + 5 + CAST(o_orderkey % 16 AS INT) AS hi FROM (
    SELECT *, CAST(floor(o_totalprice / 10000) AS INT) + 3 AS lo
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) x),
postings AS (
  SELECT o_orderkey AS job_id,
    {_pick(SOURCES, 'o_orderkey % 3')} AS source,
    c_mktsegment AS title, c_mktsegment AS job_type, c_mktsegment AS industry, c_name AS company,
    n_name AS city, n_regionkey AS city_tier,
    {_salary_text('varchar')} AS raw_salary,
    {_pick(VIEW_EDUCATION, 'o_custkey % 7')} AS raw_education,
    {_pick(VIEW_EXPERIENCE, 'o_orderkey % 11')} AS raw_experience,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      ELSE concat('released on ', strftime(o_orderdate, '%B %-d %Y')) END AS released_raw,
    concat('size', CAST(CAST(floor((c_acctbal + 1000) / 2200) AS INT) AS VARCHAR)) AS company_size,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 END AS recruits,
    c_mktsegment AS keyword, CAST(o_orderkey // 30 AS INT) AS page_no, CAST(o_orderkey % 30 AS INT) AS pos_in_page,
    o_orderdate
  FROM ends)"""


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with numeric salary, education and experience."""
    parsed = parse_salary(postings(spark, sf_dir))
    return parse_experience(parsed).withColumns({
        "edu_level": edu_level(F.col("raw_education")), "exp_level": exp_level(F.col("raw_experience"))})


def _levels(table_: dict[str, float], col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in table_.items()) + " END"


def _unit(expr: str) -> str:
    return f"CASE WHEN {expr} IN ('K','k','千') THEN 1.0::DOUBLE WHEN {expr} = '万' THEN 10.0::DOUBLE ELSE 0.001::DOUBLE END"


CLEAN_SQL = f"""{POSTINGS_SQL},
grouped AS (
  SELECT *,
    CAST(nullif(regexp_extract(raw_salary, '{SALARY_PATTERN}', 1), '') AS DOUBLE) AS g_lo,
    nullif(regexp_extract(raw_salary, '{SALARY_PATTERN}', 2), '') AS g_lo_unit,
    CAST(nullif(regexp_extract(raw_salary, '{SALARY_PATTERN}', 3), '') AS DOUBLE) AS g_hi,
    nullif(regexp_extract(raw_salary, '{SALARY_PATTERN}', 4), '') AS g_hi_unit,
    regexp_extract(raw_salary, '{SALARY_PATTERN}', 5) AS g_period,
    coalesce(CAST(nullif(regexp_extract(raw_salary, '{SALARY_PATTERN}', 6), '') AS DOUBLE), 12.0::DOUBLE) AS g_months
  FROM postings),
scaled AS (
  SELECT *,
    g_lo * {_unit('coalesce(g_lo_unit, g_hi_unit)')} * g_factor AS salary_min_k,
    g_hi * {_unit('g_hi_unit')} * g_factor AS salary_max_k
  FROM (SELECT *, CASE WHEN g_period IN ('天','day') THEN 21.75::DOUBLE WHEN g_period IN ('年','year')
    THEN 1.0::DOUBLE / 12.0::DOUBLE ELSE 1.0::DOUBLE END AS g_factor FROM grouped) y),
clean AS (
  SELECT * EXCLUDE (g_lo, g_lo_unit, g_hi, g_hi_unit, g_period, g_months, g_factor),
    (salary_min_k + salary_max_k) / 2.0::DOUBLE * g_months / 12.0::DOUBLE AS salary_month_k,
    CASE WHEN salary_min_k IS NULL THEN 'unparsed' ELSE 'parsed' END AS salary_status,
    CASE WHEN raw_experience LIKE '%以内%' THEN 0 ELSE TRY_CAST(nullif(regexp_extract(raw_experience, '([0-9]+)', 1), '') AS INT) END AS exp_min,
    CASE WHEN raw_experience LIKE '%以内%' THEN TRY_CAST(nullif(regexp_extract(raw_experience, '([0-9]+)', 1), '') AS INT)
      ELSE TRY_CAST(nullif(regexp_extract(raw_experience, '[0-9]+\\s*-\\s*([0-9]+)', 1), '') AS INT) END AS exp_max,
    {_levels(EDUCATION_LEVELS, 'raw_education')} AS edu_level,
    {_levels(EXPERIENCE_LEVELS, 'raw_experience')} AS exp_level
  FROM scaled)"""


# --- tags, texts ----------------------------------------------------------------------------

def texts(spark: SparkSession, sf_dir: str, name: str, key: str, *cols: str) -> DataFrame:
    """A table of long texts: the scan's own partitions, nothing is shuffled."""
    return table(spark, sf_dir, name).select(key, *cols)


def order_tags(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(job_id, tags): the distinct words of a part column over the lineitems of an order.

    Sets are built before the shuffle and merged after it, so neither an array nor a shuffled row
    grows past the vocabulary, however many lineitems an order has.
    """
    words = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, sf_dir, "part").select("p_partkey", column), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("job_id"), F.explode(F.split(column, " ")).alias("w"))
    )
    return words.groupBy("job_id").agg(F.collect_set("w").alias("tags"))


def with_tags(df: DataFrame, spark: SparkSession, sf_dir: str, column: str, out: str) -> DataFrame:
    """Add a tag array; an order without lineitems gets an empty one."""
    tags = order_tags(spark, sf_dir, column).withColumnRenamed("tags", out)
    return df.join(tags, "job_id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def tag_rows_sql(column: str) -> str:
    return f"""tag_rows AS (
  SELECT DISTINCT l_orderkey AS job_id, unnest(string_split({column}, ' ')) AS tag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def document_count(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()


def with_doc_id(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the id of the document that serves as the posting's description."""
    return df.withColumn("doc_id", F.col("job_id") % document_count(spark, sf_dir))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_lists(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def high_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id").distinct()


def doc_similarity(spark: SparkSession, sf_dir: str, folds: int | None = None) -> DataFrame:
    """Similarity of every document to the template of the high-quality ones."""
    return similarity(doc_terms(spark, sf_dir), high_documents(spark, sf_dir), "doc_id", document_count(spark, sf_dir), folds)


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean postings with the similarity of their description, which is a stored feature: texts are mined once for all models."""
    rows = with_doc_id(clean(spark, sf_dir), spark, sf_dir)
    sources = [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")]
    return rows.join(stored(spark, "similarity", sources, lambda: doc_similarity(spark, sf_dir)), "doc_id", "left")


LATIN_SQL = "[A-Za-zÀ-ÖØ-öø-ɏ][A-Za-z0-9À-ÖØ-öø-ɏ+#]*"
TOKENS_SQL = f"""tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{LATIN_SQL}')) AS term FROM documents)"""

TFIDF_SQL = f"""{TOKENS_SQL},
counts AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
freq AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
  FROM counts GROUP BY 1),
weights AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN freq USING (term)),
vectors AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weights),
high AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"""

SIMILARITY_SQL = f"""{TFIDF_SQL},
template AS (SELECT term, sum(w) / (SELECT count(*) FROM high) AS weight FROM vectors WHERE doc_id IN (SELECT doc_id FROM high) GROUP BY 1),
sims AS (SELECT doc_id, coalesce(sum(w * weight), 0.0::DOUBLE) / (SELECT sqrt(sum(weight * weight)) FROM template) AS similarity
  FROM vectors LEFT JOIN template USING (term) GROUP BY 1)"""

MODELLED_SQL = f"""{CLEAN_SQL},
{SIMILARITY_SQL},
n_docs AS (SELECT count(*) AS n FROM documents),
placed AS (SELECT c.*, c.job_id % n AS doc_id FROM clean c, n_docs),
modelled AS (SELECT p.*, s.similarity FROM placed p LEFT JOIN sims s USING (doc_id))"""
