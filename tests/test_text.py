import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hirelens.operators import textmine as X


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    texts = [(i, " ".join(["the"] * rng.randint(1, 4) + rng.choices(vocab, k=rng.randint(3, 30)))) for i in range(60)]
    return texts, spark.createDataFrame(texts, "doc long, text string"), [i for i, _ in texts if rng.random() < 0.4]


def brute(texts, members, folds=None):
    n = len(texts)
    tf = {d: Counter(t.split()) for d, t in texts}
    df = Counter(w for c in tf.values() for w in c)
    vec = {}
    for d, c in tf.items():
        w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        vec[d] = {t: v / norm for t, v in w.items()}

    def sim(d):
        used = [m for m in members if folds is None or m % folds != d % folds]
        tpl = Counter()
        for m in used:
            for t, v in vec[m].items():
                tpl[t] += v / len(used)
        norm = math.sqrt(sum(v * v for v in tpl.values()))
        return sum(v * tpl[t] for t, v in vec[d].items()) / norm

    return vec, {d: sim(d) for d, _ in texts}


@pytest.mark.parametrize("folds", [None, 3])
def test_similarity_matches_brute_force(spark, docs, folds):
    texts, df, members = docs
    tokens = X.tokenise(df, "doc", "text", place=True)
    high = spark.createDataFrame([(m,) for m in members], "doc long")
    got = {r["doc"]: r["similarity"] for r in X.similarity(tokens, high, "doc", F.lit(len(texts)), folds).collect()}
    _, want = brute(texts, members, folds)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_tfidf_vectors(spark, docs):
    texts, df, members = docs
    got = {(r["doc"], r["term"]): r["w"] for r in X.tfidf(X.tokenise(df, "doc", "text"), "doc", F.lit(len(texts))).collect()}
    want, _ = brute(texts, members)
    assert got.keys() == {(d, t) for d, v in want.items() for t in v}
    assert all(math.isclose(got[d, t], w, rel_tol=1e-9) for d, v in want.items() for t, w in v.items())


def test_dictionary_takes_the_longest(spark):
    df = spark.createDataFrame([(1, "机器学习与深度学习"), (2, None)], "d int, t string")
    assert [r["term"] for r in X.tokenise(df, "d", "t", ["机器", "机器学习", "学习"]).collect()] == ["机器学习", "学习"]


def test_contrast_and_stopwords(spark):
    tok = spark.createDataFrame([("h", "a"), ("h", "a"), ("h", "b"), ("l", "b")], "g string, term string")
    rows = {r["term"]: r for r in X.contrast_terms(tok, F.col("g") == "h").collect()}
    assert math.isclose(rows["a"]["share_high"], 2 / 3) and rows["a"]["n_low"] == 0
    assert math.isclose(rows["a"]["log_ratio"], math.log(3 * 1 / (1 * 3)))
    assert {r["term"] for r in X.drop_stopwords(tok, spark.createDataFrame([("a",)], "term string")).collect()} == {"b"}
    assert [r["term"] for r in X.top_terms(X.term_freq(tok), 1).collect()] == ["a"]


def test_grades(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.19, 0.2, 0.99, 1.0)], "s double")
    assert [r[0] for r in df.select(X.similarity_grade(F.col("s"))).collect()] == [1, 1, 2, 5, 5]


def test_terms_are_counted_inside_rows_and_over_repeated_ids(spark):
    rows = [(i, "a b a " * 700 + f"c{i}") for i in range(600)] + [(7, "b b x"), (None, "a n"), (None, "n"), (900, None), (901, ""), (902, "Ärger ärger 中文字")]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    want = X.tokenise(df, "doc", "text")
    lists = X.term_lists(df, "doc", "text")
    table = lambda d: sorted(map(tuple, d.collect()), key=repr)
    counts = X.term_counts(lists, "doc")
    assert counts.dtypes == X.term_counts(want, "doc").dtypes
    assert table(counts) == table(want.groupBy("doc", "term").count())
    slots = want.select("doc", X.hash_slot(F.col("term"), 5).alias("term")).groupBy("doc", "term").count()
    assert table(X.slot_counts(lists, "doc", 5)) == table(slots)
    assert table(X.term_freq(counts)) == table(want.groupBy("term").count())
    # the rows that are alone with their id are counted without a table of (doc, term) and without a shuffle
    plan = X.term_counts(lists.where("whole"), "doc")._jdf.queryExecution().executedPlan().toString()
    assert "term" not in "".join(line for line in plan.splitlines() if "HashAggregate" in line)
