"""Sketch quantiles within their stated error, merged or not; ranks over many ranges; features stored once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hirelens.operators import sketches as K
from hirelens.operators.describe import box_stats, numeric_summary, rank_groups
from hirelens.operators.prefix import ranked_rows
from hirelens.operators.textmine import hash_slot, hashed_tfidf, tfidf
from hirelens.session import shared_folder, stored


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [("even", float(i)) for i in range(30_000)] + [("skewed", math.exp(rng.gauss(0, 3))) for _ in range(20_000)]
    rows += [("same", 7.0)] * 10_000 + [("few", 1.0), ("few", 2.0), ("few", None), ("few", float("nan")), ("none", None), (None, 5.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("error", [0.1, 0.01])
def test_rank_error(spark, values, error):
    rows, df = values
    probs = {f"p{i}": i / 20 for i in range(1, 20)}
    whole = K.sketched(df, "v", ["g"], error)
    parts = K.merged(K.sketched(df.withColumn("part", F.spark_partition_id()), "v", ["g", "part"], error), ["g"])
    for sketches in (whole, parts):
        for r in K.sketch_quantiles(sketches, ["g"], probs).collect():
            held = sorted(v for g, v in rows if g == r.g and v is not None and v == v)
            assert r.n == len(held)
            for name, p in probs.items():
                if not held:
                    assert r[name] is None
                    continue
                below, upto = sum(v < r[name] for v in held), sum(v <= r[name] for v in held)
                assert below <= (p + error) * len(held) and upto >= (p - error) * len(held)


def test_size_of_a_sketch():
    assert K.size_for(0.0266) in range(196, 204)  # half of it is the published 1.33 % of size 200
    assert K.size_for(1.0) == K.LEAST
    with pytest.raises(ValueError, match="least error"):
        K.size_for(1e-6)


def test_summary_and_box_against_the_exact_ones(values):
    _, df = values
    exact = {r.g: r for r in numeric_summary(df, "v", ["g"]).collect()}
    for r in K.approx_summary(df, "v", ["g"], 0.005).collect():
        e = exact[r.g]
        assert r.n == e.n and (r.mean is None) == (e["mean"] is None) and (e["mean"] is None or r.mean == pytest.approx(e["mean"]))
        assert (r.std is None) == (e["std"] is None) and (e["std"] is None or r.std == pytest.approx(e["std"]))
        if r.g == "even":
            assert abs(r.median - e.median) <= 0.005 * 30_000
    exact = {r.g: r for r in box_stats(df, "v", ["g"]).collect()}
    for r in K.approx_box_stats(df, "v", ["g"], error=0.005).collect():
        e = exact[r.g]
        assert (r.n, r.min, r.max) == (e.n, e.min, e.max) and r.min <= r.low_whisker <= r.high_whisker <= r.max
        if r.g in ("same", "few"):
            assert r.outliers == 0
        if r.g == "skewed":
            assert abs(r.outliers - e.outliers) < 0.03 * r.n


def test_ranks_in_ranges(spark):
    """Heavy ties on the measure: the ranges are cut within them, by the tie column; no range holds most of the rows."""
    rows = [(5.0 if i % 3 else float(i % 97), f"g{i:05d}") for i in range(5000)] + [(None, "null"), (float("nan"), "nan")]
    df = spark.createDataFrame(rows, "m double, g string").repartition(5)
    got = [(r.rank, r.g) for r in rank_groups(df, "m", "g").collect()]
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] is not None and r[0] == r[0], -(r[0] if r[0] is not None and r[0] == r[0] else 0), r[1]))
    assert sorted(got) == [(i, g) for i, (_, g) in enumerate(want, 1)]
    ranged = ranked_rows(df, [F.desc("m"), F.asc("g")])
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in plan  # the sizes of the ranges, and nothing else
    assert rank_groups(df.where("false"), "m", "g").count() == 0


def test_hashed_vectors_equal_plain_ones_without_collisions(spark):
    words = ["spark", "sql", "java", "日本", "c++"]
    tokens = spark.createDataFrame([(d, w) for d in range(6) for w in words[: d + 1] * (d + 1)], "doc long, term string")
    n = F.lit(6)
    slot = {r.term: r.s for r in tokens.select("term", hash_slot(F.col("term"), 1 << 18).alias("s")).distinct().collect()}
    assert len(set(slot.values())) == len(words)
    plain = {(r.doc, slot[r.term]): r.w for r in tfidf(tokens, "doc", n).collect()}
    hashed = {(r.doc, r.slot): r.w for r in hashed_tfidf(tokens, "doc", n).collect()}
    assert hashed.keys() == plain.keys() and all(hashed[k] == pytest.approx(plain[k]) for k in plain)
    one = hashed_tfidf(tokens, "doc", n, width=1).collect()
    assert {(r.doc, r.slot, round(r.w, 9)) for r in one} == {(d, 0, 1.0) for d in range(6)}


def test_stored_features_are_built_once(spark):
    folder, built = shared_folder(spark), []

    def table():
        built.append(1)
        return spark.read.parquet(folder).groupBy().agg(F.sum("id").alias("s"))

    spark.range(10).write.parquet(folder)
    assert [stored(spark, "sum", [folder], table).first().s for _ in range(3)] == [45] * 3 and len(built) == 1
    spark.range(5).write.mode("append").parquet(folder)  # other inputs, another table
    assert stored(spark, "sum", [folder], table).first().s == 55 and len(built) == 2
