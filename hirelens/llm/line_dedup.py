"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, last_doc), one row per line key, in buckets of the hash and sorted there. Each batch of documents
is reduced to its keys, which merge-anti-join the runs so far: keys that no run holds become a new run of level 0, the others an update
of a known key's count. So a key lies in one run only; `fanout` runs of a level are compacted into one of the next, which rewrites a key
once per level. Runs meet a batch bucket by bucket, without another shuffle. At the end all lines anti-join the keys held often enough.
Everything is DataFrame functions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm.common import EDGE_SPACE, ascii_lower, documents, let, partitions, settle, shared_folder

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line stripped at both ends of the contract's white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(EDGE_SPACE)))


def with_row_key(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """`row`: names a row by doc_id and text, so rows that repeat a doc_id with another text stay apart; equal rows share it.

    `carried`: a struct of the columns to take along, so that their names clash with nothing."""
    taken = docs.select("doc_id", "text", F.struct(*carry).alias("carried")) if carry else docs
    own = documents(taken) if not carry else taken.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "carried")
    return own.withColumn("row", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("text_hash")))


def long_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, row, pos, h1, h2): the lines whose key has at least `min_chars` code points, with 128 bits of hash."""
    keys = F.transform(F.split("text", "\n", -1), line_key)
    held = F.filter(F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(
        i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))), lambda x: x.isNotNull())
    return with_row_key(docs).select("doc_id", "row", F.explode(held).alias("line")).select("doc_id", "row", "line.pos", "line.h1", "line.h2")


class LineRuns:
    """Levelled sorted runs in the shared store: `runs` lists (level, table), `updates` the tables of counts for keys already held."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark, self.fanout, self.runs, self.updates, self.paths = spark, fanout, [], [], {}

    def _write(self, keys: DataFrame) -> str:
        """A table in buckets of the hash; its files lie in the shared folder and outlive its name."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_folder(self.spark)
        keys.write.bucketBy(partitions(self.spark), *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _push(self, run: str, level: int) -> None:
        self.runs.append((level, run))
        same = [r for at, r in self.runs if at == level]
        if len(same) >= self.fanout:  # no key is in two runs, so merging them is laying them together
            merged = self._write(self._union(same).repartition(partitions(self.spark), *HASH))
            self.runs = [(at, r) for at, r in self.runs if at != level]
            self._push(merged, level + 1)

    def _union(self, names: list[str]) -> DataFrame:
        # read as plain files, with the schema as a run may be empty: a union of bucketed tables reports their partitioning, which Spark 4.1 then groups by wrongly
        return reduce(DataFrame.unionAll, [self.spark.read.schema(self.spark.table(n).schema).parquet(self.paths[n]) for n in names])

    def table(self) -> DataFrame:
        """All runs with their updates as one, a row for each key."""
        rows = self._union([r for _, r in self.runs] + self.updates)
        return rows.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (doc_id, h1, h2); its keys that no run held before, as (h1, h2, n_docs, last_doc). A document must not come twice."""
        each = lines.select("doc_id", *HASH).distinct()  # dealt by all three, so a line in every document spreads
        keys = each.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not self.runs:
            fresh = self._write(keys)
        else:
            batch = self._write(keys)
            unseen = self.spark.table(batch)
            for _, run in self.runs:
                unseen = unseen.join(self.spark.table(run).select(*HASH), HASH, "left_anti")
            fresh = self._write(unseen)
            self.updates.append(self._write(self.spark.table(batch).join(self.spark.table(fresh).select(*HASH), HASH, "left_anti")))
        self._push(fresh, 0)
        return self.spark.table(fresh)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): one row per row of `docs`; the columns in `carry` come along as struct `carried`.

    Keys of at least `min_chars` code points found in at least `min_docs` documents lose all their lines except in the largest
    doc_id that holds them. The documents come in `batches` batches by a hash of doc_id, each of which merge-anti-joins the runs before
    it; then all lines anti-join the keys to be dropped. NULL or empty text is one empty line. A document is a doc_id: rows that repeat one count once, and keep
    the line together. NULL doc_ids count as one document, smaller than any other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = shared_folder(spark)
    lines = long_lines(docs, min_chars)
    lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.parquet(path)
    lines = spark.read.schema("doc_id long, row struct<id: long, text_hash: long>, pos int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    doomed = settle(runs.table().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"))
    stays = lines.alias("l").join(
        doomed.alias("r"),
        (F.col("l.h1") == F.col("r.h1")) & (F.col("l.h2") == F.col("r.h2")) & ~F.col("l.doc_id").eqNullSafe(F.col("r.last_doc")), "left_anti")
    # one set a row: of repeated rows each position comes several times
    kept = stays.groupBy("row").agg(F.collect_set("pos").alias("kept_long"))
    met = with_row_key(docs, carry).join(kept, "row", "left")
    short = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(F.char_length(F.btrim(x, F.lit(EDGE_SPACE))) < min_chars, i)), lambda i: i.isNotNull())
    places = lambda ls: F.array_sort(F.concat(short(ls), F.coalesce("kept_long", F.array().cast("array<int>"))))
    rebuilt = let(F.split("text", "\n", -1), lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"), F.transform(places(ls), lambda i: F.get(ls, i)).alias("kept")))
    extra = ["carried"] if carry else []
    done = met.select("doc_id", *extra, rebuilt.alias("r"))
    return done.select("doc_id", *extra, "r.n_lines", (F.col("r.n_lines") - F.size("r.kept")).alias("n_dropped"), F.concat_ws("\n", "r.kept").alias("kept_text"))
