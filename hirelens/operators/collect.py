"""Filtering, dedup, merging and auditing of collected postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelens.constants import DOMAIN_TERMS
from hirelens.functions.text import any_term, has_description
from hirelens.operators.prefix import running_totals, same_keys
from hirelens.operators.terms import TermSet, has_any


def require_id(df: DataFrame, key: str = "job_id") -> DataFrame:
    """Drop rows without an id (NULL or empty)."""
    return df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def domain_filter(df: DataFrame, terms: list[str] | TermSet | None = None, cols: list[str] | None = None) -> DataFrame:
    """Keep rows where a term occurs, in any letter case, in the joined columns (NULL counts as empty).

    A list is a pattern, for some dozens of terms; a `TermSet` is searched by an automaton, for any number.
    """
    cols = cols or ["industry", "company", "title"]
    if isinstance(terms, TermSet):
        return df.where(has_any(F.concat_ws(" ", *cols), terms))
    return df.where(F.concat_ws(" ", *cols).rlike(any_term(terms or DOMAIN_TERMS)))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in the given order, as an aggregate.

    Each task keeps one row per key before the shuffle, so a key with very many copies costs one
    row per task. Ties in `order` must be broken by the caller.
    """
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def new_only(batch: DataFrame, snapshot: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of the batch whose id is not in the snapshot yet."""
    return batch.join(snapshot.select(key), key, "left_anti")


def latest_details(details: DataFrame, key: str = "job_id", text: str = "description", order: str = "fetched_seq") -> DataFrame:
    """One text per posting: the last fetch that brought one (a NULL text means a failed fetch).

    The last fetch is found on narrow rows; its text joins afterwards by the key alone, so that it is moved once and lies where
    `merge_details` needs it. `order` has no ties in a key. `text` may be a column of any type that stands for the text.
    """
    brought = details.where(F.col(text).isNotNull())
    last = brought.groupBy(key).agg(F.max(order).alias("_last"))
    return brought.select(key, order, text).join(last, key).where(F.col(order) >= F.col("_last")).select(key, text)


def merge_details(postings: DataFrame, details: DataFrame, key: str = "job_id", text: str = "description") -> DataFrame:
    """Write new texts back to their postings; where there is none the posting stays as it was.

    `details` has one row per id, see `latest_details`.
    """
    new = details.select(F.col(key), F.col(text).alias("_new"))
    return postings.join(new, key, "left").withColumn(text, F.coalesce("_new", text)).drop("_new").select(*postings.columns)


def pending_details(
    postings: DataFrame, details: DataFrame, key: str = "job_id", text: str = "description", order: str = "fetched_seq",
) -> DataFrame:
    """Postings with an id whose description is neither in the posting nor in the last successful fetch.

    Only a flag per fetch is aggregated; the texts are not shuffled.
    """
    last = details.where(F.col(text).isNotNull()).select(key, order, has_description(F.col(text)).alias("_ok"))
    done = last.groupBy(key).agg(F.max_by("_ok", order).alias("_ok")).where("_ok").select(key)
    return require_id(postings, key).where(~has_description(F.col(text))).join(done, key, "left_anti")


def missing_pages(captures: DataFrame, max_pages: DataFrame) -> DataFrame:
    """(keyword, page_no) pairs up to `last_page` of each keyword that were never captured.

    The number of missing pages per keyword is known from counts, so only keywords with a gap are expanded.
    """
    seen = captures.select("keyword", "page_no").distinct()
    inside = seen.join(max_pages, "keyword").where(F.col("page_no").between(1, F.col("last_page")))
    have = inside.groupBy("keyword").agg(F.count(F.lit(1)).alias("_have"))
    gaps = max_pages.join(have, "keyword", "left").where(F.coalesce("_have", F.lit(0)) < F.col("last_page"))
    # expand in blocks, so that no row unfolds into more than a thousand pages at once
    blocks = gaps.select(
        "keyword", "last_page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last_page").cast("long"), F.lit(1000).cast("long"))).alias("_from"))
    pages = blocks.select(
        "keyword",
        F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 999, F.col("last_page").cast("long")))).alias("page_no"))
    return pages.join(seen.withColumn("page_no", F.col("page_no").cast("long")), ["keyword", "page_no"], "left_anti")


def capture_summary(df: DataFrame, kept: Column, block: int = 1000) -> DataFrame:
    """Per keyword and page: postings found, postings kept, kept so far in the keyword."""
    pages = df.groupBy("keyword", "page_no").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(kept).alias("kept"))
    run = running_totals(pages, ["kept"], ["keyword"], ["page_no"], F.floor(F.col("page_no") / block))
    return run.select("keyword", "page_no", "found", "kept", (F.col("kept_before") + F.col("kept")).alias("kept_so_far"))


def completion(df: DataFrame, text: str = "description") -> DataFrame:
    """Number of postings, with and without a description."""
    done = F.count_if(has_description(F.col(text)))
    return df.agg(
        F.count(F.lit(1)).alias("postings"), done.alias("with_description"),
        (F.count(F.lit(1)) - done).alias("without_description"))


def cap_pages(df: DataFrame, max_pages: int) -> DataFrame:
    return df.where(F.col("page_no") <= max_pages)


def with_sequence(df: DataFrame, order: str, block: int = 100_000, out: str = "seq") -> DataFrame:
    """Number the rows 0, 1, 2, ... by a unique integer column without sorting the table in one task.

    Rows are numbered inside blocks of the ordering column and shifted by the counts of the blocks ahead. Those counts are
    themselves summed in blocks of a thousand, so what one task sees is a row for every `block` * 1000 ids.
    """
    at = F.floor(F.col(order) / block).alias("_block")
    sizes = df.groupBy(at).agg(F.count(F.lit(1)).alias("_size"))
    ahead = running_totals(sizes, ["_size"], [], ["_block"], F.floor(F.col("_block") / 1000)).select("_block", "_size_before")
    place = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    rows = df.select("*", at).withColumn("_place", place).join(ahead, "_block")
    return rows.select(*df.columns, (F.col("_size_before") + F.col("_place")).alias(out))


def resume_from(df: DataFrame, n: int, order: str, block: int = 100_000) -> DataFrame:
    """Skip the first `n` rows in the given order."""
    return with_sequence(df, order, block).where(F.col("seq") >= n)


def failure_streaks(
    df: DataFrame, failed: Column, by: list[str], order: list[str], block: Column, limit: int = 3,
) -> DataFrame:
    """Add `streak`, the number of failures in a row up to this row, and `hit_limit` where it reaches `limit`.

    A success sets the streak to zero. A long history of one group is cut in blocks (for example
    days): streaks are counted inside each block, and only one row per block carries the open
    streak over to the next. `order` must have no ties and `block` must keep its order.
    """
    rows = df.withColumns({"_fail": failed.cast("int"), "_block": block})
    w = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.sum(1 - F.col("_fail")).over(w))
    in_island = Window.partitionBy(*by, "_block", "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_fail").over(in_island))

    # per block: did it hold a success, and how many failures follow the last one
    # (max_by over (island, run) gives the run at the end of the block)
    ends = rows.groupBy(*by, "_block").agg(
        F.max("_island").alias("_islands"), F.max(F.struct("_island", "_run")).getField("_run").alias("_open"))
    # blocks since the last one with a success add up
    along = Window.partitionBy(*by).orderBy("_block")
    ends = ends.withColumn("_chain", F.sum((F.col("_islands") > 0).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(*by, "_chain").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_after", F.sum("_open").over(chain))
    carried = ends.select(*by, "_block", F.coalesce(F.lag("_after").over(along), F.lit(0)).alias("_carry"))

    joined = same_keys(rows, carried, [*by, "_block"])
    streak = F.col("_run") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(F.lit(0))
    return (
        joined.withColumn("streak", streak)
        .withColumn("hit_limit", (F.col("_fail") == 1) & (F.col("streak") == limit))
        .drop("_fail", "_block", "_island", "_run", "_carry")
    )
