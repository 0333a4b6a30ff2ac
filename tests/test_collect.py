import random

from pyspark.sql import functions as F

from hirelens.operators import collect as C
from hirelens.operators.prefix import hot_key_join
from hirelens.plans.collection import told


def test_first_seen_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", f"k{i % 50}"]), rng.randint(1, 9), i) for i in range(3000)]
    want = {}
    for k, page, pos in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(k, (page, pos))
    got = C.first_seen(spark.createDataFrame(rows, "job_id string, page_no int, pos int"), "job_id", ["page_no", "pos"])
    assert {r["job_id"]: (r["page_no"], r["pos"]) for r in got.collect()} == want
    assert C.first_seen(got, "job_id", ["page_no", "pos"]).count() == len(want)


def test_joins_with_snapshot(spark):
    postings = spark.createDataFrame([("a", ""), ("b", "a long enough text"), ("c", ""), (None, ""), ("", "")], "job_id string, description string")
    details = spark.createDataFrame(
        [("a", 1, "first text, long"), ("a", 2, None), ("a", 3, "third text, long"), ("c", 1, None)], "job_id string, fetched_seq int, description string")
    merged = C.merge_details(postings, C.latest_details(details))
    assert {r["job_id"]: r["description"] for r in merged.collect()}["a"] == "third text, long"
    assert merged.count() == 5
    assert [r["job_id"] for r in C.pending_details(postings, details).collect()] == ["c"]
    assert [r["job_id"] for r in C.new_only(postings.where("job_id = 'a' or job_id = 'c'"), postings.where("job_id = 'a'")).collect()] == ["c"]
    assert C.completion(postings).first().asDict() == {"postings": 5, "with_description": 1, "without_description": 4}


def test_missing_pages_over_block_edges(spark):
    captured = spark.createDataFrame([("k", p) for p in range(1, 2501) if p not in (1, 1000, 1001, 2500)] + [("full", 1)], "keyword string, page_no int")
    last = spark.createDataFrame([("k", 2500), ("full", 1), ("none", 2)], "keyword string, last_page int")
    got = {(r["keyword"], r["page_no"]) for r in C.missing_pages(captured, last).collect()}
    assert got == {("k", 1), ("k", 1000), ("k", 1001), ("k", 2500), ("none", 1), ("none", 2)}


def test_capture_summary_over_block_edges(spark):
    rows = spark.createDataFrame([("k", p, p % 3 == 0) for p in range(1, 41) for _ in range(2)], "keyword string, page_no int, ok boolean")
    got = C.capture_summary(rows, F.col("ok"), block=7).orderBy("page_no").collect()
    assert [r["kept_so_far"] for r in got] == [2 * (p // 3) for p in range(1, 41)]


def test_sequence_and_resume(spark):
    rng = random.Random(2)
    ids = rng.sample(range(100_000), 500)
    got = C.resume_from(spark.createDataFrame([(i,) for i in ids], "id long"), 123, "id", block=700).collect()
    assert {(r["id"], r["seq"]) for r in got} == set((v, i) for i, v in enumerate(sorted(ids)) if i >= 123)


def test_failure_streaks_across_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), t, rng.random() < 0.7) for t in range(600)]
    df = spark.createDataFrame(rows, "u int, t int, bad boolean")
    got = {r["t"]: (r["streak"], r["hit_limit"]) for r in C.failure_streaks(df, F.col("bad"), ["u"], ["t"], F.floor(F.col("t") / 10), 5).collect()}
    run, want = {}, {}
    for u, t, bad in rows:
        run[u] = run.get(u, 0) + 1 if bad else 0
        want[t] = (run[u], bad and run[u] == 5)
    assert got == want
    assert max(s for s, _ in want.values()) > 10  # some streaks span blocks


def test_hot_key_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}") for i in range(600)], "id long, k string")
    small = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(15)], "k string, v double")
    hot = spark.createDataFrame([("hot",)], "k string")
    plain = sorted(tuple(r) for r in big.join(small, "k").select("id", "k", "v").collect())
    for how in ("inner", "left"):
        got = hot_key_join(big, small, "k", hot, "id", 8, how).select("id", "k", "v").where("v is not null")
        assert sorted(tuple(r) for r in got.collect()) == plain
    assert hot_key_join(big, small, "k", hot, "id", 8, "left").count() == 600


def test_texts_of_details_move_once_by_their_key(spark):
    postings = spark.createDataFrame([("a", "old"), ("b", "kept"), (None, "no id")], "job_id string, description string")
    details = spark.createDataFrame(
        [("a", 1, "first"), ("a", 4, "last"), ("a", 5, None), ("b", None, "unordered"), (None, 1, "no id either")], "job_id string, fetched_seq int, description string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = C.merge_details(postings, C.latest_details(details))
        plan = merged._jdf.queryExecution().executedPlan().toString()
        rows = {(r["job_id"], r["description"]) for r in merged.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {("a", "last"), ("b", "kept"), (None, "no id")}
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 3 and not any("fetched_seq" in line for line in moved)  # postings, fetches, last fetch of each


def test_details_merge_by_what_is_shown_of_them(spark):
    shown = lambda c: told(F.col(c)).alias(c)
    postings = spark.createDataFrame([(1, "old"), (2, None), (3, "")], "job_id long, description string")
    details = spark.createDataFrame([(1, 1, "new"), (1, 2, None), (2, 1, None)], "job_id long, fetched_seq int, description string")
    merged = C.merge_details(postings.select("job_id", shown("description")), C.latest_details(details.select("job_id", "fetched_seq", shown("description"))))
    assert {r["job_id"]: r["n_chars"] for r in merged.select("job_id", "description.n_chars").collect()} == {1: 3, 2: None, 3: 0}
