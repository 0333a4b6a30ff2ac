"""Queries that run a stream to its end and return what it kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelens.operators.collect import domain_filter
from hirelens.plans.collection import CAPTURES_SQL, captures
from hirelens.plans.registry import query
from hirelens.plans.views import table
from hirelens.session import shared_folder
from hirelens.streaming import ingest as S

@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    """Users of the event stream, each once: files in no order of time, one to a batch, over two checkpoints and three runs."""
    base = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    store = S.postings_store(spark, f"{base}/snapshot", "user_id", buckets=8)
    for part in range(3):
        # an even share of all times in each file; the second checkpoint meets the first one's files again
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).repartition(2).write.mode("append").parquet(f"{base}/in")
        checkpoint = f"{base}/checkpoint-{part // 2}"
        stream = S.stream_table(spark, f"{base}/in", "user_id long, ts timestamp_ntz, event_id long", max_files=1)
        name = S.stream_id(spark, checkpoint)
        run = lambda batch, i, name=name: S.upsert_batch(batch, i, store, order=["ts", "event_id"], stream=name)
        S.run_available(stream, checkpoint, run).awaitTermination()
    return S.read_upserted(spark, f"{base}/snapshot").select("user_id")


_ARRIVED = "(event_id * 5 + 2) % 6"


@query(f"""WITH a AS (SELECT user_id, event_id, ts, {_ARRIVED} AS arrived, row_number() OVER (PARTITION BY user_id ORDER BY {_ARRIVED}, ts, event_id) AS rn FROM events)
SELECT user_id, event_id, ts, arrived FROM a WHERE rn = 1""")
def stream_first_arrival(spark, sf_dir):
    """The event that brought each user in, by keyed state alone: six files, each with an even share of all times, in two runs."""
    base = shared_folder(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("arrived", F.expr(_ARRIVED))
    for run in range(2):
        for part in range(3):
            events.where(F.col("arrived") == 3 * run + part).repartition(1).write.mode("append").option("parquet.block.size", 8 << 20).parquet(f"{base}/in")  # read and filtered by all tasks
        stream = S.stream_table(spark, f"{base}/in", "user_id long, event_id long, ts timestamp_ntz, arrived long", max_files=1)
        first = S.stream_dedup(stream, "user_id", ["ts", "event_id"], buckets=64)
        S.run_available(first, f"{base}/checkpoint", lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_id", "ts", "arrived")


_INDUSTRY = "CASE job_id % 7 WHEN 0 THEN '股份制银行' WHEN 1 THEN 'fintech lab' WHEN 2 THEN '互联网' WHEN 3 THEN '汽车金融' WHEN 4 THEN NULL WHEN 5 THEN '消费信托' ELSE lower(industry) END"


@query(f"""WITH {CAPTURES_SQL},
kept AS (SELECT *, {_INDUSTRY} AS trade, row_number() OVER (PARTITION BY job_id ORDER BY page_no, keyword, pos_in_page) AS rn FROM captures
  WHERE job_id IS NOT NULL AND page_no % 5 NOT IN (3, 4) AND job_id % 7 IN (0, 1, 3, 5))
SELECT CAST(job_id AS VARCHAR) AS job_id, company, trade AS industry, raw_salary, page_no FROM kept WHERE rn = 1""")
def stream_listings(spark, sf_dir):
    """Listing responses as JSON files in several runs: status, the default terms, ids, first seen, snapshot."""
    base = shared_folder(spark)
    job = F.struct(
        F.col("job_id").cast("string").alias("encryptJobId"), F.col("title").alias("jobName"), F.col("company").alias("brandName"),
        F.col("raw_salary").alias("salaryDesc"), F.col("city").alias("cityName"), F.expr(_INDUSTRY).alias("brandIndustry"))
    code = F.expr("CASE page_no % 5 WHEN 0 THEN '0' WHEN 3 THEN '37' WHEN 4 THEN '121' END").alias("code")
    rows = captures(spark, sf_dir).select("keyword", "page_no", "pos_in_page", job.alias("job"))
    listed = rows.groupBy("keyword", "page_no").agg(F.array_sort(F.collect_list(F.struct("pos_in_page", "job"))).alias("jobs"))  # 30 to a page, and the repeats
    responses = listed.select(code, F.struct(F.col("jobs.job").alias("jobList")).alias("zpData"), "keyword", "page_no")
    late = F.col("page_no") >= 1_000_000
    checkpoint = f"{base}/checkpoint"
    name = S.stream_id(spark, checkpoint)
    store = S.postings_store(spark, f"{base}/snapshot", buckets=8)
    for part in (responses.where(~late & (F.col("page_no") % 2 == 0)), responses.where(~late & (F.col("page_no") % 2 == 1)), responses.where(late)):
        part.write.mode("append").json(f"{base}/in")
        run = lambda batch, i: S.upsert_batch(domain_filter(batch), i, store, order=["page_no", "keyword", "pos_in_page"], stream=name)
        S.run_available(S.stream_listings(spark, f"{base}/in", max_files=4), checkpoint, run).awaitTermination()
    return S.read_upserted(spark, f"{base}/snapshot").select("job_id", "company", "industry", "raw_salary", "page_no")


# page_no % 7: 3 was cut off, 4 is a page of HTML over two lines, 5 is a list, 6 was blocked; the others are sound
_CUT, _HTML = "concat('{\"code\":0,\"keyword\":\"', keyword, '\",\"page_no\":', page_no, ',\"zpData\":{\"jobList\":[{\"encryptJobId')", "concat('<html><body>', keyword, ' ', page_no)"


@query(f"""WITH {CAPTURES_SQL}, p AS (SELECT DISTINCT keyword, page_no FROM captures),
kept AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_no, keyword, pos_in_page) AS rn FROM captures
  WHERE job_id IS NOT NULL AND page_no % 7 < 3)
SELECT 'posting' AS kind, CAST(job_id AS VARCHAR) AS ref, page_no, raw_salary AS raw FROM kept WHERE rn = 1
UNION ALL SELECT 'error', NULL, NULL, {_CUT} FROM p WHERE page_no % 7 = 3
UNION ALL SELECT 'error', NULL, NULL, unnest([{_HTML}, '</body></html>']) FROM p WHERE page_no % 7 = 4
UNION ALL SELECT 'error', NULL, NULL, concat('[{{"code":0,"page_no":', page_no, '}}]') FROM p WHERE page_no % 7 = 5
UNION ALL SELECT 'blocked', '37', page_no, NULL FROM p WHERE page_no % 7 = 6""")
def stream_quarantine(spark, sf_dir):
    """Captured pages of which most are broken in some way, in three runs: postings of the sound ones, and every other response kept."""
    base = shared_folder(spark)
    job = F.struct(F.col("job_id").cast("string").alias("encryptJobId"), F.col("raw_salary").alias("salaryDesc"))
    rows = captures(spark, sf_dir).select("keyword", "page_no", "pos_in_page", job.alias("job"))
    pages = rows.groupBy("keyword", "page_no").agg(F.array_sort(F.collect_list(F.struct("pos_in_page", "job"))).alias("jobs")).withColumn("kind", F.expr("page_no % 7"))
    sound = F.to_json(F.struct(F.when(F.col("kind") == 6, "37").otherwise("0").alias("code"), F.struct(F.col("jobs.job").alias("jobList")).alias("zpData"), "keyword", "page_no"))
    text = (F.when(F.col("kind") == 3, F.expr(_CUT)).when(F.col("kind") == 4, F.concat(F.expr(_HTML), F.lit("\n</body></html>\n")))
            .when(F.col("kind") == 5, F.concat(F.lit('[{"code":0,"page_no":'), "page_no", F.lit("}]"))).otherwise(sound))
    store, checkpoint = S.postings_store(spark, f"{base}/snapshot", buckets=8), f"{base}/checkpoint"
    name = S.stream_id(spark, checkpoint)
    late = F.col("page_no") >= 1_000_000
    for part in (~late & (F.col("page_no") % 2 == 0), ~late & (F.col("page_no") % 2 == 1), late):
        pages.where(part).select(text.alias("value")).write.mode("append").text(f"{base}/in")
        run = lambda batch, i: S.ingest_responses(batch, i, store, f"{base}/quarantine", order=["page_no", "keyword", "pos_in_page"], stream=name)
        S.run_available(S.stream_responses(spark, f"{base}/in", max_files=8), checkpoint, run).awaitTermination()
    good = S.read_upserted(spark, f"{base}/snapshot").select(F.lit("posting").alias("kind"), F.col("job_id").alias("ref"), "page_no", F.col("raw_salary").alias("raw"))
    bad = spark.read.parquet(f"{base}/quarantine").where("file IS NOT NULL")
    return good.unionAll(bad.select("status", "code", "page_no", "broken_text"))


@query(f"""WITH {CAPTURES_SQL},
kept AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_no, keyword, pos_in_page) AS rn FROM captures WHERE job_id IS NOT NULL)
SELECT job_id, company, raw_salary, page_no, CASE WHEN job_id % 6 = 0 THEN concat('second ', city) WHEN job_id % 2 = 0 THEN concat('first ', city) ELSE '' END AS description
FROM kept WHERE rn = 1""")
def stream_upsert(spark, sf_dir):
    """Captured pages arrive in two files sets, then two rounds of descriptions; a replay changes nothing."""
    base = shared_folder(spark)
    rows = captures(spark, sf_dir).select("job_id", "company", "city", "raw_salary", "keyword", "page_no", "pos_in_page").withColumn("description", F.lit(""))
    folder, snapshot = f"{base}/pages", f"{base}/snapshot"
    postings, details = S.postings_store(spark, snapshot, buckets=8), S.details_store(spark, snapshot, buckets=8)

    def ingest() -> None:
        stream = S.stream_table(spark, folder, rows.schema.simpleString()[len("struct<"):-1].replace(":", " "))
        run = lambda batch, i: S.upsert_batch(batch, i, postings, order=["page_no", "keyword", "pos_in_page"])
        S.run_available(stream, f"{base}/checkpoint", run).awaitTermination()

    rows.where("page_no < 1000000").write.mode("append").parquet(folder)
    ingest()
    rows.where("page_no >= 1000000").write.mode("append").parquet(folder)
    ingest()
    ingest()  # nothing new
    detail = lambda seq, text, cond: rows.where(f"page_no < 1000000 AND {cond}").select(
        "job_id", F.concat(F.lit(text), "city").alias("description"), F.lit(seq).alias("fetched_seq"))
    S.add_details(detail(1, "first ", "job_id % 2 = 0"), 0, details)
    S.add_details(detail(1, "second ", "job_id % 6 = 0"), 1, details)
    return S.read_upserted(spark, snapshot).select("job_id", "company", "raw_salary", "page_no", "description")
