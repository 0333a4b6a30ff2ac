"""Captured listing responses (JSON) to posting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.constants import POSTING_NAMES
from hirelens.functions.text import join_tags

JOB_SCHEMA = (
    "encryptJobId string, jobName string, brandName string, salaryDesc string, cityName string, "
    "jobExperience string, jobDegree string, brandScaleName string, brandIndustry string, "
    "welfareList array<string>, skills array<string>"
)
LISTING_SCHEMA = f"code string, message string, zpData struct<jobList: array<struct<{JOB_SCHEMA}>>>, keyword string, page_no int"


_BROKEN = "broken_text"


def response_status(code: Column) -> Column:
    """37 means blocked; 0 or no code means ok; anything else is an error. See `parse_responses` for text that is no response at all."""
    text = code.cast("string")
    return F.when(text == "37", "blocked").when(text.isNull() | (text == "0"), "ok").otherwise("error")


def project_posting(jobs: DataFrame, job: str = "job") -> DataFrame:
    """The twelve posting columns out of a job struct; an absent field is NULL, the description starts empty."""
    f = lambda name: F.col(job).getField(name)
    return jobs.select(
        *[c for c in jobs.columns if c != job],
        f("jobName").alias("title"),
        f("brandName").alias("company"),
        f("salaryDesc").alias("raw_salary"),
        f("cityName").alias("city"),
        f("jobExperience").alias("raw_experience"),
        f("jobDegree").alias("raw_education"),
        f("brandScaleName").alias("company_size"),
        f("brandIndustry").alias("industry"),
        f("welfareList").alias("welfare_tags"),
        f("skills").alias("skill_tags"),
        F.lit("").alias("description"),
        f("encryptJobId").alias("job_id"),
    )


def parse_responses(lines: DataFrame) -> DataFrame:
    """Captured texts (value, file) to responses: code, message, zpData, keyword, page_no, status, file, broken_text.

    What is not one JSON object with these fields (a line cut off, a page of HTML, a list, a field of another kind) has status `error` and
    keeps its text in `broken_text`, so that a lost page is seen and can be fetched again. Blank lines are no responses.
    """
    text = lines.where(F.col("value").rlike("\\S"))
    wanted = f"{LISTING_SCHEMA}, {_BROKEN} string"
    parsed = text.select("file", "value", F.from_json("value", wanted, {"columnNameOfCorruptRecord": _BROKEN, "mode": "PERMISSIVE"}).alias("r"))
    # a list of objects would pass as its first one
    whole = F.col("r").isNotNull() & F.col(f"r.{_BROKEN}").isNull() & F.col("value").rlike("^\\s*[{]")
    part = lambda name: F.when(F.col("_whole"), F.col(f"r.{name}")).alias(name)
    return parsed.withColumn("_whole", whole).select(
        *[part(c) for c in ("code", "message", "zpData", "keyword", "page_no")],
        F.when(F.col("_whole"), response_status(F.col("r.code"))).otherwise("error").alias("status"),
        "file", F.when(~F.col("_whole"), F.col("value")).alias(_BROKEN))


def read_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All captured responses, broken ones too: one JSON object per line, or one per file with `multi_line`."""
    lines = spark.read.text(path, wholetext=multi_line).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_responses(lines)


def quarantine(responses: DataFrame) -> DataFrame:
    """What has to be looked at or fetched again: responses that are blocked, failed or broken, with the file that they came in."""
    return responses.where(F.col("status") != "ok").select("status", "code", "message", "keyword", "page_no", _BROKEN, "file")


def explode_listings(responses: DataFrame) -> DataFrame:
    """Responses with status ok to one row per job; a response without a job list gives none."""
    status = F.col("status") if "status" in responses.columns else response_status(F.col("code"))
    jobs = responses.where(status == "ok").select("keyword", "page_no", F.posexplode("zpData.jobList").alias("pos_in_page", "job"))
    return project_posting(jobs)


def read_listings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Postings of the captured responses with status ok; `read_responses` and `quarantine` show the others."""
    return explode_listings(read_responses(spark, path, multi_line))


def published_names(postings: DataFrame) -> DataFrame:
    """The posting columns under their published names, tags as comma text."""
    cols = [
        (join_tags(F.col(c)) if c in ("welfare_tags", "skill_tags") else F.col(c)).alias(name)
        for c, name in POSTING_NAMES.items()
    ]
    return postings.select(*cols)
