import json

import pytest
from pyspark.sql import functions as F

from hirelens.session import shared_folder
from hirelens.streaming import ingest as S


def write_page(folder, name, page, ids):
    folder.mkdir(exist_ok=True)
    jobs = [{"encryptJobId": i, "jobName": f"{i}@{page}", "brandIndustry": "银行"} for i in ids]
    (folder / name).write_text(json.dumps({"code": 0, "keyword": "k", "page_no": page, "zpData": {"jobList": jobs}}, ensure_ascii=False), encoding="utf-8")


def test_pages_resume_and_upsert(spark, tmp_path):
    base, folder = shared_folder(spark), tmp_path / "pages"
    run = lambda: S.run_available(
        S.stream_listings(spark, str(folder)), f"{base}/cp", lambda b, i: S.upsert_batch(b, i, f"{base}/snap")).awaitTermination()
    titles = lambda: sorted(r["title"] for r in S.read_upserted(spark, f"{base}/snap").collect())
    write_page(folder, "1.json", 1, ["a", "b", "a"])
    run()
    assert titles() == ["a@1", "b@1"]
    write_page(folder, "2.json", 2, ["b", "c", None, ""])
    run()
    run()
    assert titles() == ["a@1", "b@1", "c@2"]
    # the same pages again under new names: nothing enters twice
    write_page(folder, "3.json", 1, ["a", "b", "a"])
    run()
    assert titles() == ["a@1", "b@1", "c@2"]
    # a batch that is run again after a failure replaces itself
    again = spark.createDataFrame([("c", "k", 2, 1)], "job_id string, keyword string, page_no int, pos_in_page int")
    S.upsert_batch(again, 99, f"{base}/snap")
    S.upsert_batch(again, 99, f"{base}/snap")
    assert titles() == ["a@1", "b@1", "c@2"]


def test_late_keys_and_other_checkpoints(spark):
    """A key older than all others is kept whenever it comes, and a new checkpoint overwrites nothing."""
    base = shared_folder(spark)
    day = {"a": "2024-03-01", "b": "2024-01-01", "c": "2024-03-02", "d": "2023-01-01"}
    schema = "ts timestamp, k string"

    def run(checkpoint, keys):
        spark.createDataFrame([(k, day[k]) for k in keys], "k string, d string").select(F.to_timestamp("d").alias("ts"), "k").coalesce(1).write.mode("append").parquet(f"{base}/in")
        name = S.stream_id(spark, f"{base}/{checkpoint}")
        assert name == S.stream_id(spark, f"{base}/{checkpoint}")
        stream = S.stream_table(spark, f"{base}/in", schema, max_files=1)
        S.run_available(stream, f"{base}/{checkpoint}", lambda b, i: S.upsert_batch(b, i, f"{base}/snap", "k", ["ts"], stream=name)).awaitTermination()
        return sorted(r["k"] for r in S.read_upserted(spark, f"{base}/snap").collect())

    assert run("one", "a") == ["a"]
    assert run("one", "b") == ["a", "b"]
    assert run("one", "c") == ["a", "b", "c"]
    assert run("two", "d") == ["a", "b", "c", "d"]


def test_details_keep_the_last_success(spark):
    base = shared_folder(spark)
    posts = spark.createDataFrame([("a", "k", 1, 0, ""), ("b", "k", 1, 1, "")], "job_id string, keyword string, page_no int, pos_in_page int, description string")
    S.upsert_batch(posts, 0, base)
    detail = lambda rows: spark.createDataFrame(rows, "job_id string, description string, fetched_seq int")
    S.add_details(detail([("a", "old", 1), ("a", "new", 2)]), 0, base)
    S.add_details(detail([("a", None, 1), ("z", "unknown", 1)]), 1, base)
    assert {r["job_id"]: r["description"] for r in S.read_upserted(spark, base).collect()} == {"a": "new", "b": ""}


def test_first_rows_over_arrow_batches():
    """A task that brings its keys down to one row each holds little more than the keys, and finds the first over all batches (F19)."""
    import pyarrow as pa

    rows = [(i * 7919 % 50, (i * 104729 % 1009 or None, i)) for i in range(5000)]
    kind = pa.struct([("ts", pa.int64()), ("n", pa.int64())])
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([{"ts": t, "n": n} for _, (t, n) in part], kind)], names=["key", "row"])
    out = S._first_of_all(["ts", "n"], most=64)(batch(rows[a : a + 97]) for a in range(0, 5000, 97))
    got = sorted((k, r["ts"], r["n"]) for b in out for k, r in zip(b.column("key").to_pylist(), b.column("row").to_pylist()))
    first = {}
    for k, (t, n) in rows:
        place = (t is not None, t or 0, n)
        if k not in first or place < first[k][0]:
            first[k] = place, t, n
    assert got == sorted((k, t, n) for k, (_, t, n) in first.items())
    assert list(S._first_of_all(["ts"])(iter([]))) == []


@pytest.mark.parametrize("order", [None, ["ts", "n"]])
def test_stream_dedup(spark, order):
    """Keys come back late, early, many times and in a second run: the first batch that has a key wins, and no key is lost."""
    base, schema = shared_folder(spark), "ts timestamp, k string, n int, tags array<string>"
    files = [[("a", 50, 0), ("b", 40, 1), ("a", 30, 2), (None, 1, 3), ("", 1, 4)], [("c", 1, 0), ("a", 0, 1)] + [("hot", 99 - i, i) for i in range(99)],
             [("b", 0, 0), ("d", 10**6, 1), ("d", 10**6, 0)], [("e", None, 1), ("e", 5, 0), ("c", 0, 5), ("hot", 0, 0)]]
    seen = []

    def run():
        out = S.stream_dedup(S.stream_table(spark, f"{base}/in", schema, max_files=1), "k", order, buckets=2)
        S.run_available(out, f"{base}/cp", lambda b, i: seen.extend((r.k, r.ts and r.ts.timestamp(), r.n, r.tags) for r in b.collect())).awaitTermination()

    for i, rows in enumerate(files):
        df = spark.createDataFrame([(k, t, n) for k, t, n in rows], "k string, t long, n int")
        df.select(F.timestamp_seconds("t").alias("ts"), "k", "n", F.array("k").alias("tags")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if i % 2:
            run()
    run()
    assert sorted(r[0] for r in seen) == ["a", "b", "c", "d", "e", "hot"]
    if order:
        assert sorted(seen, key=lambda r: r[0]) == [
            ("a", 30, 2, ["a"]), ("b", 40, 1, ["b"]), ("c", 1, 0, ["c"]), ("d", 10**6, 0, ["d"]), ("e", None, 1, ["e"]), ("hot", 1, 98, ["hot"])]
