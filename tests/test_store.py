"""The bucketed store: pruned reads, bounded runs and files, batches that run again."""

import pytest
from pyspark.sql import functions as F

from hirelens.session import shared_folder
from hirelens.streaming import ingest as S
from hirelens.streaming.store import BucketStore

SCHEMA = "k string, v long"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(store):
    found = store.read()
    return sorted((r.k, r.v) for r in found.collect())


def test_only_touched_buckets_are_read(spark):
    store = BucketStore(spark, shared_folder(spark), "k", buckets=32)
    store.add_new(rows(spark, [(f"k{i}", i) for i in range(2000)]), "s", 0)
    few = rows(spark, [("k5", 0), ("new", 0)])
    touched = sorted({r[0] for r in few.select(store.bucket_of(few)).collect()})
    known = store.known(few, touched)
    assert [r.k for r in known.collect()] == ["k5"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    held = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert f"IN ({','.join(map(str, touched))})" in held  # files of no other bucket are opened
    read = [s for s in plan.split("ReadSchema: ")[1:] if "struct<k:string>" in s[:30]]
    assert read and "struct<k:string,v" not in plan  # the key column alone


def test_runs_and_files_stay_few(spark):
    """Forty small batches, each with new and with known keys: first value of every key, few runs, few live files."""
    store = BucketStore(spark, shared_folder(spark), "k", buckets=3, fanout=3)
    want = {}
    for i in range(40):
        batch = [(f"k{j}", 100 * i + j) for j in range(2 * i, 2 * i + 5)]
        store.add_new(rows(spark, batch), "s", i)
        for k, v in batch:
            want.setdefault(k, v)
        assert len(store.runs) <= 2 * 4 and len(store.read().inputFiles()) <= 3 * len(store.runs)  # two of each level at most
    assert content(store) == sorted(want.items())
    again = BucketStore(spark, store.path, "k", buckets=99, fanout=3)
    assert again.buckets == 3 and again.runs == store.runs and content(again) == content(store)
    left = store.unlisted().count()
    assert left > 0
    live = {f.replace("file://", "file:") for f in store.read().inputFiles()}
    assert not live & {r.path for r in store.unlisted().collect()}


def test_a_batch_that_runs_again_replaces_itself(spark):
    store = BucketStore(spark, shared_folder(spark), "k", buckets=2, fanout=4)
    store.add_new(rows(spark, [("a", 1)]), "s", 0)
    store.add_new(rows(spark, [("a", 2), ("b", 2)]), "s", 1)
    store.add_new(rows(spark, [("a", 2), ("c", 2)]), "s", 1)  # the first try is forgotten
    assert content(store) == [("a", 1), ("c", 2)]
    for i in range(2, 6):
        store.add_new(rows(spark, [(f"x{i}", i)]), "s", i)  # merged meanwhile
    before = content(store)
    store.add_new(rows(spark, [("a", 2), ("c", 2)]), "s", 1)
    assert content(store) == before
    store.add_new(rows(spark, [("a", 9), ("z", 9)]), "other", 1)  # another stream with the same number
    assert content(store) == sorted(before + [("z", 9)])


def test_a_failed_batch_changes_nothing(spark):
    path = shared_folder(spark)
    store = BucketStore(spark, path, "k", buckets=2)
    store.add_new(rows(spark, [("a", 1)]), "s", 0)
    bad = rows(spark, [("b", 1)]).withColumn("v", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        store.add_new(bad, "s", 1)
    assert content(BucketStore(spark, path, "k")) == [("a", 1)]


def test_empty_batches_and_new_columns(spark):
    store = BucketStore(spark, shared_folder(spark), "k", buckets=2, fanout=2)
    assert store.read() is None
    store.add_new(rows(spark, []), "s", 0)
    assert content(store) == []
    store.add_new(rows(spark, [("a", 1)]).withColumn("w", F.lit("more")), "s", 1)
    store.add_new(rows(spark, [("a", 5), ("b", 2)]), "s", 2)
    assert sorted((r.k, r.v, r.w) for r in store.read().collect()) == [("a", 1, "more"), ("b", 2, None)]


def test_details_are_merged_to_the_last(spark):
    base = shared_folder(spark)
    S.upsert_batch(spark.createDataFrame([(f"j{i}", "k", 1, i, "") for i in range(4)], "job_id string, keyword string, page_no int, pos_in_page int, description string"), 0, base)
    store = S.details_store(spark, base, buckets=2, fanout=2)
    for i in range(7):
        S.add_details(spark.createDataFrame([("j0", f"t{i}", 9 - i), ("j1", None, i), (f"j{i % 4}", f"u{i}", 20)], "job_id string, description string, fetched_seq int"), i, store)
    assert {r.job_id: r.description for r in S.read_upserted(spark, base).collect()} == {"j0": "t6", "j1": "u5", "j2": "u6", "j3": "u3"}
    assert store.read().count() <= 4 * len(store.runs) and len(store.runs) <= 4
