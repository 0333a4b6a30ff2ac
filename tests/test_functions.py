import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelens.functions import text as X
from hirelens.functions.dates import parse_dates
from hirelens.functions.levels import edu_level, exp_level, parse_experience
from hirelens.functions.salary import flow_band, mean_band, parse_salary, salary_band3

SALARIES = [
    ("15-25K·13薪", 21.7), ("1-1.5万/月", 12.5), ("200-300元/天", 5.4), ("20-30万/年", 20.8), ("30-50K", 40.0),
    ("1-1.6万·13薪", 14.1), ("8-12K", 10.0), ("25-35K·14薪", 35.0), ("35-60K", 47.5), ("12-20K", 16.0), ("40-70K", 55.0),
    ("18-30K", 24.0), ("8-15K", 11.5), ("10k-15k/month", 12.5), ("8千-1.2万", 10.0), ("6000-8000元/月", 7.0),
    ("面议", None), ("", None), (None, None), ("20K以上", None), ("50元/时", None),
]


def test_salary_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SALARIES)], "i int, raw_salary string")
    rows = parse_salary(df).select("i", F.round("salary_month_k", 1).alias("k"), "salary_status", "salary_min_k").orderBy("i").collect()
    assert [r["k"] for r in rows] == [k for _, k in SALARIES]
    assert all((r["salary_status"] == "unparsed") == (r["k"] is None) for r in rows)
    assert rows[13]["salary_min_k"] == 10.0


def test_salary_survives_a_filter_without_a_second_parse(spark):
    df = parse_salary(spark.createDataFrame([("8-12K",)], "raw_salary string")).where("salary_month_k > 5").groupBy().avg("salary_month_k")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "RLIKE" not in plan
    assert df.first()[0] == 10.0


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in [7.99, 8.0, 20.0, 20.01, 35.0, 35.01, 12.0, 18.0, 25.0, None]], "v double")
    rows = df.select(salary_band3(F.col("v")), flow_band(F.col("v")), mean_band(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["low", "medium", "medium", "high", "high", "high", "medium", "medium", "high", None]
    assert [r[1][:3] if r[1] else None for r in rows][:6] == ["低薪区", "低薪区", "高薪区", "高薪区", "高薪区", "超高薪"]
    assert [r[2] for r in rows] == ["≤8K", "≤8K", "18-25K", "18-25K", ">25K", ">25K", "8-12K", "12-18K", "18-25K", None]


def test_levels(spark):
    df = spark.createDataFrame([("本科", "5-10年"), ("中专/中技", "1年以内"), ("??", None), ("博士", "10年以上"), ("大专", "在校/应届")], "e string, x string")
    rows = df.select(edu_level(F.col("e")), exp_level(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(3.0, 7.5), (1.0, 0.5), (None, None), (5.0, 12.0), (2.0, 0.0)]


def test_experience_bounds(spark):
    df = spark.createDataFrame([("1-3年",), ("10年以上",), ("10+",), ("1年以内",), ("经验不限",), ("3-5 years",)], "raw_experience string")
    assert [tuple(r)[1:] for r in parse_experience(df).collect()] == [(1, 3), (10, None), (10, None), (0, 1), (None, None), (3, 5)]


def test_dates(spark):
    df = spark.createDataFrame([("2025-10-01",), ("released on October 1st",), ("released on October 3 1998",), ("soon",), (None,)], "d string")
    day = dt.date(2025, 10, 1)
    assert [r["released"] for r in parse_dates(df, "d").collect()] == [day, None, dt.date(1998, 10, 3), None, None]
    assert [r["released"] for r in parse_dates(df, "d", default_year=2025).collect()][1] == day


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [(["a", "b"], "  0123456789 ", "BOSS直聘"), (None, "0123456789a", "前程无忧 (51job)"), ([], " NaN ", "Zhaopin"), (["x"], None, None)],
        "tags array<string>, text string, src string")
    rows = df.select(
        X.join_tags(F.col("tags")), X.tags_or_default(F.col("tags")), X.has_description(F.col("text")),
        X.has_description(F.col("text"), 1), X.normalise_source(F.col("src"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a,b", "a,b", False, True, "boss"), ("", "暂无", True, True, "51job"), ("", "暂无", False, False, "zhaopin"), ("x", "x", False, False, "")]


def test_first_match_takes_the_first_non_blank(spark):
    df = spark.createDataFrame([("<a> </a><b>two</b>",), ("<a>one</a><b>two</b>",), ("none",)], "h string")
    got = df.select(X.first_match(F.col("h"), ["<a>(.*?)</a>", "<b>(.*?)</b>"])).collect()
    assert [r[0] for r in got] == ["two", "one", None]


def test_terms_are_literal(spark):
    df = spark.createDataFrame([("c++ dev",), ("C dev",)], "t string")
    assert df.where(F.col("t").rlike(X.any_term(["C++"]))).count() == 1


def test_tokens(spark):
    df = spark.createDataFrame([("熟悉Python 3和C++，数据分析",), ("",), ("好 Été",)], "t string")
    assert [r[0] for r in df.select(X.word_tokens(F.col("t"))).collect()] == [
        ["python", "c++", "熟悉", "和", "数据", "据分", "分析"], [], ["été", "好"]]


def test_sentinels(spark):
    df = spark.createDataFrame([("暂无",), (" nan ",), ("[未获取到描述]",), ("",), ("ok",)], "t string")
    assert [r[0] for r in df.select(X.sentinel_to_null(F.col("t"))).collect()] == [None, None, None, None, "ok"]
