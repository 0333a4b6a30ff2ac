import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelens.functions import text as X
from hirelens.functions.salary import flow_band
from hirelens.operators import charts as G
from hirelens.operators import clean as K
from hirelens.operators import describe as D
from hirelens.operators.prefix import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group; small and large, negative and repeated values."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        rows.append((g, rng.choice([rng.uniform(0, 1), rng.uniform(-50, 50), float(rng.randint(1, 9)), 1e9 * rng.random()])))
    rows += [("a", None), ("a", float("nan")), ("one", 4.0), ("none", None)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(6).cache()


def groups(rows):
    out = defaultdict(list)
    for g, v in rows:
        if v is not None and not math.isnan(v):
            out[g].append(v)
    return out


def test_exact_quantiles(skewed):
    rows, df = skewed
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: [r[p] for p in probs] for r in exact_quantiles(df, "v", ["g"], probs).collect()}
    want = {g: np.quantile(v, list(probs.values())) for g, v in groups(rows).items()}
    assert got.keys() == want.keys()
    for g in want:
        assert np.allclose(got[g], want[g], rtol=1e-12)
    every = exact_quantiles(df, "v", [], probs).first()
    assert np.allclose(list(every), np.quantile(sum(groups(rows).values(), []), list(probs.values())))


def test_numeric_summary(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in D.numeric_summary(df, "v", ["g"]).collect()}
    for g, v in groups(rows).items():
        assert got[g]["n"] == len(v) and math.isclose(got[g]["mean"], np.mean(v)) and math.isclose(got[g]["median"], np.median(v))
        assert got[g]["std"] is None if len(v) == 1 else math.isclose(got[g]["std"], np.std(v, ddof=1))
    assert tuple(got["none"]) == ("none", 0, None, None, None)


def test_box_stats(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in D.box_stats(df, "v", ["g"]).collect()}
    for g, v in groups(rows).items():
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = [x for x in v if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
        r = got[g]
        assert (r["n"], r["min"], r["max"], r["outliers"]) == (len(v), min(v), max(v), len(v) - len(inside))
        assert (r["low_whisker"], r["high_whisker"]) == (min(inside), max(inside))


def test_outliers_are_flagged_not_removed(skewed):
    _, df = skewed
    flagged = K.flag_salary_outliers(df, ["g"], "v")
    assert flagged.count() == df.count()
    assert flagged.where("salary_outlier").count() == D.box_stats(df, "v", ["g"]).agg(F.sum("outliers")).first()[0]


def test_gini_and_lorenz(spark):
    rng = random.Random(6)
    rows = [("equal", 5.0)] * 40 + [("single", 0.0)] * 99 + [("single", 10.0)] + [("mixed", float(rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["gini"] for r in G.gini(df, "v", ["g"]).collect()}
    assert abs(got["equal"]) < 1e-12 and math.isclose(got["single"], 0.99)
    v = np.sort([x for g, x in rows if g == "mixed"])
    brute = np.abs(v[:, None] - v[None, :]).sum() / (2 * len(v) ** 2 * v.mean())
    assert math.isclose(got["mixed"], brute)
    ends = G.lorenz(df, "v", ["g"]).groupBy("g").agg(F.max("people_share"), F.max("income_share")).collect()
    assert all(math.isclose(r[1], 1.0) and math.isclose(r[2], 1.0) for r in ends)
    points = G.lorenz(df, "v", ["g"]).collect()
    assert all(r["income_share"] <= r["people_share"] + 1e-12 for r in points)


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(7)
    rows = [
        (rng.choice(["bj", "sh", "sz"]), rng.choice("abcdefgh"), rng.choice(["本科", "硕士", None]), rng.choice(["1-3年", "3-5年"]), rng.choice([None, rng.uniform(3, 60)]))
        for _ in range(900)]
    return spark.createDataFrame(rows, "city string, job string, edu string, exp string, pay double").cache()


def test_flow_is_conserved(market):
    edges = G.sankey(market, ["edu", "exp", flow_band(F.col("pay"))]).collect()
    into, out = Counter(), Counter()
    for e in edges:
        (into if e["stage"] == 1 else out)[e["target"] if e["stage"] == 1 else e["source"]] += e["value"]
    whole = market.dropna("any", subset=["edu", "exp", "pay"]).count()
    assert into == out and sum(into.values()) == whole
    assert None not in {e["source"] for e in edges} | {e["target"] for e in edges}


def test_treemap_agrees_with_matrix(market):
    tree = G.treemap(market, "city", "job", "pay", 6)
    cells = {(r["city"], r["job"]): r["mean"] for r in G.matrix_mean(market, "city", "job", "pay").collect()}
    rows = tree.collect()
    assert all(cells[r["city"], r["job"]] == r["mean_salary"] and r["label"] == f"{r['job']}\n({r['mean_salary']:.1f}K)" for r in rows)
    for city in ("bj", "sh", "sz"):
        kids = sorted((r for r in rows if r["city"] == city), key=lambda r: r["rank"])
        assert len(kids) == 6 and {r["parent_value"] for r in kids} == {sum(r["n"] for r in kids)}
        assert [r["n"] for r in kids] == sorted((r["n"] for r in kids), reverse=True)
    assert G.treemap_json(tree, "city").where("city = 'bj'").select(F.json_array_length(F.get_json_object("node", "$.children"))).first()[0] == 6


def test_mean_bands_include_empty_ones(market):
    assert {r[0] for r in G.mean_band_nodes(G.mean_band_flow(market, "job", "pay")).collect()} >= {"≤8K", ">25K", "8-12K"}


def test_shares_and_groups(market):
    assert math.isclose(D.category_share(market, "edu").agg(F.sum("share")).first()[0], 1.0)
    assert all(math.isclose(r[1], 1.0) for r in D.crosstab_share(market, "city", "edu").groupBy("city").agg(F.sum("row_share")).collect())
    cut = np.quantile([r[0] for r in market.where("pay is not null").select("pay").collect()], [0.25, 0.75])
    got = {r[0]: r[1] for r in D.salary_group(market, "pay").groupBy("salary_group").count().collect()}
    assert got["low"] == market.where(F.col("pay") <= float(cut[0])).count() and got["high"] == market.where(F.col("pay") >= float(cut[1])).count()
    assert got[None] == market.where("pay is null").count()


def test_missing_values(spark):
    df = spark.createDataFrame([(2, "a", None), (2, None, None), (1, "b", "x"), (1, None, None), (None, "b", None)], "n int, s string, rare string")
    shares = {r["column_name"]: r["missing"] for r in K.missing_profile(df).collect()}
    assert shares == {"n": 1, "s": 2, "rare": 4}
    assert K.drop_sparse(df).columns == ["n", "s"]
    assert sorted(r["n"] for r in K.impute_mode(df, ["n"], 0.3).collect()) == [1, 1, 1, 2, 2]  # tie: the smaller value
    assert K.impute_mode(df, ["n"], 0.1).where("n is null").count() == 1
    assert K.drop_empty_rows(df.select("rare")).count() == 1


def test_clean_text(spark):
    df = spark.createDataFrame([("熟悉\npython ★ 和\tsql，PYTHON3 ",)], "t string")
    assert K.clean_text(df, "t", {"python": "Python", "sql": "SQL"}).first()[0] == "熟悉 Python 和 SQL，PYTHON3"


def test_character_classes_ask_the_table_first(spark):
    """The same characters as the plain ranges; a range costs a nested call for each character of a text, so few are left (F18)."""
    plain = {X.WORD_OR_GAP: "[0-9A-Za-zÀ-ÖØ-öø-ɏ+#]+|[^0-9A-Za-zÀ-ÖØ-öø-ɏ+#]+", X.LATIN_WORD: "[A-Za-zÀ-ÖØ-öø-ɏ][A-Za-z0-9À-ÖØ-öø-ɏ+#]*"}
    assert not any("A-Z" in p or "0-9" in p for p in plain)
    chars = spark.createDataFrame(
        [(chr(c),) for c in [*range(1, 0x2100), *range(0x2FF0, 0x3010), *range(0x4DF0, 0x4E10), *range(0x9FF0, 0xA010), *range(0xFEF0, 0x10010)]], "c string")
    for new, old in plain.items():
        assert chars.where(F.regexp_extract_all(F.concat(F.lit("a"), "c"), F.lit(new), 0) != F.regexp_extract_all(F.concat(F.lit("a"), "c"), F.lit(old), 0)).count() == 0
    symbols = r"^[^0-9A-Za-zÀ-ÖØ-öø-ɏ\x{4e00}-\x{9fff}+#.,;:!?，。；：！？、%/-]$"
    cleaned = X.clean_symbols(F.concat(F.lit("a"), "c", F.lit("a")))
    assert chars.where(F.col("c").rlike(symbols) != (cleaned == "a a")).count() == 0


def test_skill_corr_matches_direct(spark):
    rng = random.Random(8)
    rows = [(rng.sample(["sql", "py", "go"], rng.randint(0, 3)) * 2, rng.uniform(1, 50)) for _ in range(400)]
    got = {r["skill"]: r["corr"] for r in D.skill_corr(spark.createDataFrame(rows, "skills array<string>, pay double"), "pay").collect()}
    for s in ("sql", "py", "go"):
        assert math.isclose(got[s], np.corrcoef([s in sk for sk, _ in rows], [p for _, p in rows])[0, 1], rel_tol=1e-9)
