"""Word search by automaton against a pattern, in one shard and in many."""

import random
import re
import time

import pytest

from hirelens.operators.collect import domain_filter
from hirelens.operators.terms import TermSet, find_terms, has_any

rng = random.Random(5)
WORDS = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(3000)} | {"银行", "银行业", "FinTech", "a.b", ""})
TEXTS = [(i, "".join(rng.choices("abcd .", k=rng.randint(0, 400)))) for i in range(200)] + [
    (200, None), (201, ""), (202, "大银行业务 FINTECH a.b axb"), (202, "a.b"), (203, "ab" * 100_000), (None, "银行")]


def brute(words, text):
    ordered = sorted({w.lower() for w in words if w}, key=lambda w: (-len(w), w))
    return re.findall("|".join(map(re.escape, ordered)), text.lower())


@pytest.mark.parametrize("shard_bytes", [32 << 20, 20_000])
def test_find_terms(spark, shard_bytes):
    df = spark.createDataFrame(TEXTS, "id long, text string").repartition(3)
    terms = TermSet(spark, WORDS, shard_bytes)
    assert (len(terms.shards) == 1) == (shard_bytes == 32 << 20)
    got = sorted((str(r.id), r.term) for r in find_terms(df, "id", "text", terms).collect())
    assert got == sorted((str(i), w) for i, t in TEXTS if t is not None for w in brute(WORDS, t))


def test_filter_with_many_terms(spark):
    rows = [("大银行", None, "x"), (None, None, None), ("no", "Go", "FinTECH"), ("zzz", "", "")]
    df = spark.createDataFrame(rows, "industry string, company string, title string")
    for shard_bytes in (32 << 20, 100):
        terms = TermSet(spark, spark.createDataFrame([("银行",), ("fintech",), (None,), ("",)] + [(f"q{i}",) for i in range(50)], "w string"), shard_bytes)
        assert [tuple(r) for r in domain_filter(df, terms).collect()] == [rows[0], rows[2]]
    assert df.where(has_any(df.industry, TermSet(spark, []))).count() == 0 and find_terms(df, "title", "industry", TermSet(spark, [])).count() == 0


def test_time_does_not_follow_the_list(spark):
    """The same finds among 30 words and among 60,000, most of which never occur."""
    df = spark.createDataFrame([(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=300))) for i in range(400)], "id long, text string").repartition(4).cache()
    few = ["alpha", "gamma"] + [f"w{i}x" for i in range(28)]
    many = few + [f"{i:x}w{i}" for i in range(60_000)]
    took = []
    for words in (few, many):
        terms = TermSet(spark, words)
        find_terms(df, "id", "text", terms).count()  # builds the automaton
        start = time.perf_counter()
        n = find_terms(df, "id", "text", terms).count()
        took.append(time.perf_counter() - start)
    assert n == sum(t.split().count(w) for t in (r.text for r in df.collect()) for w in ("alpha", "gamma"))
    assert took[1] < 5 * took[0] + 1  # a pattern of 60,000 words would take thousands of times as long
