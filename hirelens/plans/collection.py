"""Queries on collected pages and postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.operators import collect as C
from hirelens.plans.registry import as_double, as_long, query
from hirelens.plans.views import POSTINGS_SQL, postings, table, texts, with_doc_id
from hirelens.session import shared_folder
from hirelens.sources import files, listings, pages

TERMS = ["building", "auto"]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings in capture order with later copies: every tenth comes again on a later page, some of
    these without an id, some now naming another industry."""
    first = postings(spark, sf_dir)
    again = first.where("job_id % 10 = 0").withColumns({
        "page_no": F.col("page_no") + 1_000_000,
        "raw_salary": F.lit("again"),
        "industry": F.when(F.col("job_id") % 20 == 0, "AUTOMOBILE").otherwise(F.col("industry")),
        "job_id": F.when(F.col("job_id") % 30 == 0, None).otherwise(F.col("job_id")),
    })
    return first.unionByName(again)


CAPTURES_SQL = f"""{POSTINGS_SQL},
captures AS (
  SELECT job_id, company, city, industry, title, raw_salary, keyword, page_no, pos_in_page FROM postings
  UNION ALL
  SELECT CASE WHEN job_id % 30 = 0 THEN NULL ELSE job_id END, company, city,
    CASE WHEN job_id % 20 = 0 THEN 'AUTOMOBILE' ELSE industry END, title, 'again', keyword, page_no + 1000000, pos_in_page
  FROM postings WHERE job_id % 10 = 0)"""


@query(f"""WITH {CAPTURES_SQL},
kept AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_no, keyword, pos_in_page) AS rn FROM captures
  WHERE job_id IS NOT NULL AND regexp_matches(concat_ws(' ', industry, company, city), '(?i)(building|auto)'))
SELECT job_id, company, industry, raw_salary, page_no FROM kept WHERE rn = 1""")
def domain_filter_first_seen(spark, sf_dir):
    kept = C.domain_filter(C.require_id(captures(spark, sf_dir)), TERMS, ["industry", "company", "city"])
    return C.first_seen(kept, "job_id", ["page_no", "keyword", "pos_in_page"]).select("job_id", "company", "industry", "raw_salary", "page_no")


@query(f"WITH {POSTINGS_SQL} SELECT DISTINCT keyword, company_size FROM postings")
def distinct_keys(spark, sf_dir):
    return C.distinct_keys(postings(spark, sf_dir), "keyword", "company_size")


@query(f"""WITH {POSTINGS_SQL}
SELECT job_id, city, title FROM postings WHERE job_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def new_only(spark, sf_dir):
    snapshot = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    return C.new_only(postings(spark, sf_dir), snapshot).select("job_id", "city", "title")


def told(text: Column) -> Column:
    """What a result shows of a text, NULL for no text."""
    return F.when(text.isNotNull(), F.struct(F.md5(text).alias("text_md5"), F.length(text).alias("n_chars")))


def described(spark: SparkSession, sf_dir: str, form: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Order ids with a description for every fourth one; some hold only the text 'nan'.

    `form` is applied to the texts before they meet the orders, of which there are many to a document.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", form(F.col("text")).alias("text"))
    rows = with_doc_id(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")), spark, sf_dir)
    return rows.join(docs, "doc_id", "left").select(
        "job_id",
        F.when(F.col("job_id") % 4 == 0, F.col("text")).when(F.col("job_id") % 4 == 1, form(F.lit(" nan "))).otherwise(form(F.lit(""))).alias("description"))


def fetched(spark: SparkSession, sf_dir: str, form: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Two fetches per order: the first fails for every third one, the second brings text for every fifth. `form`: see `described`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", form(F.col("text")).alias("text"), form(F.concat("lang", "text")).alias("tagged"))
    rows = with_doc_id(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id")), spark, sf_dir).join(docs, "doc_id")
    tries = F.array(
        F.struct(F.lit(1).alias("fetched_seq"), F.when(F.col("job_id") % 3 != 0, F.col("text")).alias("description")),
        F.struct(F.lit(2).alias("fetched_seq"), F.when(F.col("job_id") % 5 == 0, F.col("tagged")).alias("description")))
    return rows.select("job_id", F.inline(tries))


# Documents come down to what the results show of them before they meet the orders: digest, length and whether there is a description.
_HAS = "length(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) > 10 AND lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) <> 'nan'"
DETAILS_SQL = f"""docs AS (SELECT doc_id, md5(text) AS d1, length(text) AS l1, {_HAS.format('text')} AS h1,
  md5(concat(lang, text)) AS d2, length(concat(lang, text)) AS l2, {_HAS.format('concat(lang, text)')} AS h2 FROM documents),
n_docs AS (SELECT count(*) AS n FROM documents),
asked AS (SELECT o_orderkey AS job_id, o_orderkey % n AS doc_id FROM orders, n_docs),
linked AS (SELECT * FROM asked JOIN docs USING (doc_id)),
described AS (SELECT job_id, CASE job_id % 4 WHEN 0 THEN d1 WHEN 1 THEN md5(' nan ') ELSE md5('') END AS digest,
  CASE job_id % 4 WHEN 0 THEN l1 WHEN 1 THEN 5 ELSE 0 END AS n_chars, job_id % 4 = 0 AND h1 AS has FROM linked),
fetched AS (SELECT job_id, CASE WHEN job_id % 5 = 0 THEN d2 WHEN job_id % 3 <> 0 THEN d1 END AS digest,
  CASE WHEN job_id % 5 = 0 THEN l2 WHEN job_id % 3 <> 0 THEN l1 END AS n_chars, CASE WHEN job_id % 5 = 0 THEN h2 WHEN job_id % 3 <> 0 THEN h1 ELSE FALSE END AS has FROM linked)"""


@query(f"""WITH {DETAILS_SQL}
SELECT d.job_id, coalesce(f.digest, d.digest) AS text_md5, CAST(coalesce(f.n_chars, d.n_chars) AS BIGINT) AS n_chars FROM described d JOIN fetched f USING (job_id)""")
def merge_details(spark, sf_dir):
    """Texts are merged by what the result shows of them: an order moves a digest and a length, not a text."""
    merged = C.merge_details(described(spark, sf_dir, told), C.latest_details(fetched(spark, sf_dir, told)))
    return as_long(merged.select("job_id", "description.text_md5", "description.n_chars"), "n_chars")


@query(f"""WITH {DETAILS_SQL} SELECT d.job_id FROM described d JOIN fetched f USING (job_id) WHERE NOT d.has AND NOT f.has""")
def pending_details(spark, sf_dir):
    return C.pending_details(described(spark, sf_dir), fetched(spark, sf_dir)).select("job_id")


@query(f"""WITH {DETAILS_SQL}
SELECT count(*) AS postings, count(*) FILTER (has) AS with_description, count(*) FILTER (NOT has) AS without_description FROM described""")
def completion(spark, sf_dir):
    return C.completion(described(spark, sf_dir))


@query(f"""WITH {POSTINGS_SQL}, seen AS (SELECT DISTINCT keyword, page_no FROM postings WHERE page_no % 7 <> 3),
last AS (SELECT keyword, max(page_no) AS last_page FROM postings GROUP BY 1),
expected AS (SELECT keyword, CAST(unnest(range(1, last_page + 1)) AS BIGINT) AS page_no FROM last)
SELECT e.keyword, e.page_no FROM expected e ANTI JOIN seen s ON e.keyword = s.keyword AND e.page_no = s.page_no""")
def missing_pages(spark, sf_dir):
    rows = postings(spark, sf_dir).select("keyword", "page_no")
    last = rows.groupBy("keyword").agg(F.max("page_no").alias("last_page"))
    return C.missing_pages(rows.where(F.col("page_no") % 7 != 3), last)


@query(f"""WITH {POSTINGS_SQL}, p AS (SELECT keyword, page_no, count(*) AS found, count(*) FILTER (raw_education = '本科') AS kept FROM postings GROUP BY 1, 2)
SELECT *, CAST(sum(kept) OVER (PARTITION BY keyword ORDER BY page_no) AS BIGINT) AS kept_so_far FROM p""")
def capture_summary(spark, sf_dir):
    return C.capture_summary(postings(spark, sf_dir), F.col("raw_education") == "本科")


@query(f"WITH {POSTINGS_SQL} SELECT keyword, count(*) AS n FROM postings WHERE page_no <= 20 GROUP BY 1")
def cap_pages(spark, sf_dir):
    return C.cap_pages(postings(spark, sf_dir), 20).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS job_id, seq FROM (
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders) x WHERE seq >= 1000""")
def resume_from(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    return C.resume_from(rows, 1000, "job_id")


@query("""WITH f AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fail FROM events),
i AS (SELECT *, sum(1 - fail) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
s AS (SELECT *, sum(fail) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
SELECT event_id, user_id, CAST(streak AS BIGINT) AS streak, CASE WHEN fail = 1 AND streak = 3 THEN 1 ELSE 0 END AS hit_limit FROM s""")
def failure_streaks(spark, sf_dir):
    out = C.failure_streaks(
        table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"),
        F.col("event_type") == "error", ["user_id"], ["ts", "event_id"], F.to_date("ts"), 3)
    return out.select("event_id", "user_id", F.col("streak").cast("long").alias("streak"), F.col("hit_limit").cast("int").alias("hit_limit"))


# --- pages ----------------------------------------------------------------------------------

@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS body FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(nullif(regexp_replace(body, '^\s+|\s+$', '', 'g'), ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS description FROM a""")
def page_description(spark, sf_dir):
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", pages.extract_article(F.col("html")).alias("description"))


@query(r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 0) AS cards FROM pages),
r AS (SELECT page_id, unnest(cards) AS card, unnest(range(len(cards))) AS pos_in_page FROM c)
SELECT page_id, pos_in_page, trim(regexp_extract(card, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS name,
  regexp_extract(card, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS link FROM r""")
def page_cards(spark, sf_dir):
    cards = pages.extract_anchor_cards(texts(spark, sf_dir, "pages", "page_id", "html"))
    return as_long(cards.select("page_id", "pos_in_page", "name", "link"), "pos_in_page")


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[?&]jl=([^&#]*)', 1), '') AS region, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS keyword,
  CAST(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT) AS DOUBLE) AS page_no FROM pages""")
def page_query(spark, sf_dir):
    parts = pages.parse_query(
        table(spark, sf_dir, "pages").select("page_id", "url"), names={"region": "jl", "keyword": "ref", "page_no": "page"})
    return as_double(parts.select("page_id", "region", "keyword", "page_no"), "page_no")


@query(r"""SELECT page_id, CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS DOUBLE) AS page_no FROM pages
WHERE TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INT) BETWEEN 2 AND 4""")
def page_range(spark, sf_dir):
    parts = pages.parse_query(
        table(spark, sf_dir, "pages").select("page_id", "url"), names={"region": "jl", "keyword": "ref", "page_no": "page"})
    return as_double(pages.page_range(parts, 2, 4).select("page_id", "page_no"), "page_no")


_CARD_HTML = """concat('<div class="joblist-box__item clearfix"><div class="top"><a class="jobinfo__name" href="#">', title, '</a>',
  CASE WHEN job_id % 9 = 0 THEN '' ELSE concat('<p class="jobinfo__salary"> ', raw_salary, ' </p>') END,
  CASE WHEN job_id % 4 > 0 THEN concat('<div class="jobinfo__other-info-item"><span>', city, '</span></div>') ELSE '' END,
  CASE WHEN job_id % 4 > 1 THEN concat('<div class="jobinfo__other-info-item">', coalesce(raw_experience, ''), '</div>') ELSE '' END,
  CASE WHEN job_id % 4 > 2 THEN concat('<div class="jobinfo__other-info-item">', raw_education, '</div>') ELSE '' END,
  '<div class="jobinfo__tag">', CASE job_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<div class="joblist-box__item-tag">', title,
    '</div><div><div class="joblist-box__item-tag"><b>', city, '</b></div></div>') ELSE concat('<ul><li class=', chr(39), 'joblist-box__item-tag', chr(39), '>', company, '</li></ul>') END,
  '</div></div><div class="bottom"><span class="companyinfo__name">', company, '</span><div class="companyinfo__tag">',
  CASE WHEN job_id % 5 = 0 THEN '' ELSE concat('<div class="joblist-box__item-tag">', company_size, '</div>') END, '</div></div></div>')"""


@query(f"""WITH {POSTINGS_SQL} SELECT keyword, page_no, title AS "岗位名称", company AS "公司名称", raw_salary AS "岗位薪资",
concat(CASE WHEN job_id % 4 > 1 THEN coalesce(raw_experience, '') ELSE '' END, ',', CASE WHEN job_id % 4 > 2 THEN raw_education ELSE '' END) AS "岗位要求",
CASE WHEN job_id % 4 > 0 THEN city ELSE '' END AS "公司位置",
CASE job_id % 3 WHEN 0 THEN '暂无' WHEN 1 THEN concat(title, ',', city) ELSE company END AS "技术要求",
CASE WHEN job_id % 5 = 0 THEN '暂无' ELSE company_size END AS "企业信息" FROM postings WHERE job_id % 9 <> 0""")
def card_pages(spark, sf_dir):
    """Postings packed into result pages of nested elements, read back as cards."""
    cards = postings(spark, sf_dir).select("keyword", "page_no", "pos_in_page", F.expr(_CARD_HTML).alias("card"))
    packed = cards.groupBy("keyword", "page_no").agg(F.array_sort(F.collect_list(F.struct("pos_in_page", "card"))).alias("cards")).select(  # 30 to a page
        "keyword", "page_no", F.concat(F.lit("<html><body><div class='positionlist'>"), F.concat_ws("<hr>", "cards.card"), F.lit("</div></body></html>")).alias("html"))
    return pages.extract_cards(packed)


# The n-th selector finds the text; before it, an element of the first selector that holds only white space.
_DETAIL_HTML = """concat('<html><body><h1>x</h1>', CASE WHEN doc_id % 2 = 0 THEN '<div class="job-sec-text"> <br> </div>' ELSE '' END, CASE doc_id % 7
  WHEN 0 THEN concat('<p class="job-sec-text big">', body, '</p>') WHEN 1 THEN concat('<div class="job-detail-section"><div><div class="text">', body, '</div></div></div>')
  WHEN 2 THEN concat('<div class="job-sec"><span class="text">', body, '</span></div>') WHEN 3 THEN concat('<section class="job-description">', body, '</section>')
  WHEN 4 THEN concat('<div class="job-detail"><ul><li class="text">', body, '</li></ul></div>') WHEN 5 THEN concat('<div class="my-job-sec-2"><i class="text">', body, '</i></div>')
  ELSE concat('<div class="text">', body, '</div>') END, '<p>after</p></body></html>')"""


@query(r"""SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM (
SELECT doc_id, CASE WHEN doc_id % 7 = 6 OR (doc_id % 2 = 0 AND doc_id % 7 = 0) THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS t FROM documents) x""")
def detail_pages(spark, sf_dir):
    """Documents packed into detail pages that need the first to the sixth selector, some with a blank first match."""
    body = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    packed = table(spark, sf_dir, "documents").select("doc_id", body.alias("body")).select("doc_id", F.expr(_DETAIL_HTML).alias("html"))
    out = pages.extract_description(packed)
    return as_long(out.select("doc_id", F.md5("description").alias("text_md5"), F.length("description").alias("n_chars")), "n_chars")


def _job(field: str, name: str):
    return F.col(field).alias(name)


@query(f"""WITH {POSTINGS_SQL} SELECT CAST(job_id AS VARCHAR) AS job_id, title, company, raw_salary, city, raw_experience, raw_education, company_size, industry,
concat(title, ',', city) AS welfare_text, '' AS skill_text, keyword, page_no FROM postings WHERE page_no % 5 NOT IN (3, 4)""")
def listing_round_trip(spark, sf_dir):
    """Postings packed into listing responses (30 to a page), written as JSON lines, read back as postings."""
    job = F.struct(
        F.col("job_id").cast("string").alias("encryptJobId"), _job("title", "jobName"), _job("company", "brandName"),
        _job("raw_salary", "salaryDesc"), _job("city", "cityName"), _job("raw_experience", "jobExperience"),
        _job("raw_education", "jobDegree"), _job("company_size", "brandScaleName"), _job("industry", "brandIndustry"),
        F.array("title", "city").alias("welfareList"))
    code = F.expr("CASE page_no % 5 WHEN 0 THEN '0' WHEN 3 THEN '37' WHEN 4 THEN '121' END").alias("code")
    responses = postings(spark, sf_dir).groupBy("keyword", "page_no").agg(F.collect_list(job).alias("jobList")).select(
        code, F.struct("jobList").alias("zpData"), "keyword", "page_no")
    path = shared_folder(spark)
    responses.write.json(path)
    read = listings.read_listings(spark, path)
    return read.select(
        "job_id", "title", "company", "raw_salary", "city", "raw_experience", "raw_education", "company_size", "industry",
        F.concat_ws(",", "welfare_tags").alias("welfare_text"), listings.join_tags(F.col("skill_tags")).alias("skill_text"), "keyword", "page_no")


@query("""SELECT event_type, CASE WHEN k = '37' THEN 'blocked' WHEN k IS NULL OR k = '0' THEN 'ok' ELSE 'error' END AS status,
count(*) AS n, CAST(sum(CAST(k AS INT)) AS BIGINT) AS k_sum FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) x GROUP BY 1, 2""")
def event_props_json(spark, sf_dir):
    code = F.from_json("props", "k string").getField("k")
    rows = table(spark, sf_dir, "events").select("event_type", code.alias("k")).withColumn("status", listings.response_status(F.col("k")))
    return rows.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k").cast("int")).alias("k_sum"))


_STATUS_SQL = "CASE o_orderkey % 11 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN NULL ELSE 200 END"
_URL_SQL = "CASE o_orderkey % 13 WHEN 1 THEN 'https://x/security-check?a' WHEN 2 THEN 'https://x/verify' WHEN 3 THEN NULL ELSE 'https://x/job' END"
_TEXT_SQL = "CASE o_orderkey % 17 WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE o_orderpriority END"


@query(f"""SELECT o_orderkey AS job_id, CASE WHEN s = 404 THEN 'closed' WHEN coalesce(s, 0) <> 200 THEN 'failed'
WHEN u LIKE '%security-check%' OR u LIKE '%verify%' THEN 'failed' WHEN trim(coalesce(t, '')) = '' THEN 'empty' ELSE 'ok' END AS status
FROM (SELECT o_orderkey, {_STATUS_SQL} AS s, {_URL_SQL} AS u, {_TEXT_SQL} AS t FROM orders) x""")
def detail_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").alias("job_id"), pages.detail_status(F.expr(_STATUS_SQL), F.expr(_URL_SQL), F.expr(_TEXT_SQL)).alias("status"))


_ITEM = "CASE WHEN job_id % 4 >= {0} THEN coalesce({1}, '') ELSE '' END"


@query(f"""WITH {POSTINGS_SQL} SELECT job_id, {_ITEM.format(1, 'city')} AS location, {_ITEM.format(2, 'raw_experience')} AS experience,
{_ITEM.format(3, 'raw_education')} AS education, concat({_ITEM.format(2, 'raw_experience')}, ',', {_ITEM.format(3, 'raw_education')}) AS requirement FROM postings""")
def split_card_info(spark, sf_dir):
    info = F.slice(F.array("city", "raw_experience", "raw_education"), 1, (F.col("job_id") % 4).cast("int"))
    rows = postings(spark, sf_dir).select("job_id", info.alias("card_info"))
    return pages.split_card_info(rows).drop("card_info")


@query(f"""WITH {POSTINGS_SQL} SELECT job_id, coalesce(raw_experience, '暂无') AS shown, raw_experience AS cleaned FROM postings""")
def default_text(spark, sf_dir):
    rows = postings(spark, sf_dir).select("job_id", F.col("raw_experience").alias("shown"))
    shown = pages.default_text(rows, ["shown"]).withColumn("cleaned", F.col("shown"))
    return files.null_sentinels(shown, ["cleaned"])


# --- files ----------------------------------------------------------------------------------

@query(f"""WITH {POSTINGS_SQL} SELECT job_id, page_no, title FROM postings UNION ALL SELECT job_id, page_no, title FROM postings WHERE page_no % 10 = 0""")
def append_pages(spark, sf_dir):
    """Two appends to one running table, the second repeating some pages: duplicates stay."""
    rows, path = postings(spark, sf_dir).select("job_id", "page_no", "title"), shared_folder(spark)
    files.append_page(rows, path)
    files.append_page(rows.where("page_no % 10 = 0"), path)
    return spark.read.schema(rows.schema).parquet(path)


@query(f"""WITH {POSTINGS_SQL} SELECT job_id, city, CASE WHEN job_id % 3 = 0 THEN 'changed' ELSE raw_salary END AS raw_salary,
coalesce(raw_experience, '') AS description FROM postings""")
def snapshot_round_trip(spark, sf_dir):
    """Written, read, changed and written back to the same place; then a writer without rows, which changes nothing."""
    rows = postings(spark, sf_dir).select("job_id", "city", "raw_salary", F.col("raw_experience").alias("description"))
    path = shared_folder(spark)
    files.write_snapshot(rows, path)
    changed = files.read_snapshot(spark, path).withColumn("raw_salary", F.when(F.col("job_id") % 3 == 0, "changed").otherwise(F.col("raw_salary")))
    files.write_snapshot(changed, path)
    files.write_snapshot(changed.where("job_id < 0"), path)
    return files.read_snapshot(spark, path)


@query(f"""WITH {POSTINGS_SQL} SELECT job_id, title, concat(title, ',', city) AS tags, raw_experience FROM postings""")
def export_cleaned(spark, sf_dir):
    rows = postings(spark, sf_dir).select("job_id", "title", F.array("title", "city").alias("tags"), "raw_experience")
    path = shared_folder(spark)
    files.export_cleaned(rows, path)
    return spark.read.option("header", True).option("escape", '"').schema("job_id long, title string, tags string, raw_experience string").csv(path)


@query(f"WITH {POSTINGS_SQL} SELECT title, company, raw_salary, city, concat(title, ',', city) AS tags FROM postings")
def export_final(spark, sf_dir):
    rows = postings(spark, sf_dir).select("job_id", "title", "company", "raw_salary", "city", F.array("title", "city").alias("tags"))
    path = files.export_final(rows, shared_folder(spark))
    return spark.read.option("header", True).option("escape", '"').schema("title string, company string, raw_salary string, city string, tags string").csv(path)


@query(f"""WITH {POSTINGS_SQL} SELECT s AS source, count(*) AS n, count(recruits) AS with_recruits FROM (
SELECT CASE WHEN source LIKE '%BOSS%' THEN 'boss' WHEN source LIKE '%51job%' THEN '51job' ELSE 'zhaopin' END AS s,
  CASE WHEN source LIKE '%51job%' THEN NULL ELSE recruits END AS recruits FROM postings) x GROUP BY 1""")
def union_sources(spark, sf_dir):
    """Three platforms with different columns under one schema."""
    rows = postings(spark, sf_dir)
    part = lambda mark: rows.where(F.contains("source", F.lit(mark))).drop("source")
    both = files.union_sources({
        "BOSS直聘": part("BOSS"), "前程无忧 (51job)": part("51job").drop("recruits"), "智联招聘": part("智联")})
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("recruits").alias("with_recruits"))
