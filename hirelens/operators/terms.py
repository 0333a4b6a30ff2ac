"""Search for the words of a long list: one automaton over all of them, one pass over each text, whatever the list's length.

A pattern `a|b|c...` tries word after word at every place of a text. Here the list becomes a trie with failure links (Aho-Corasick), so the
time depends on the text and on what is found in it. Both sides are compared in lower case.

The list is cut by a hash into shards of a bounded size, counted before anything is sent, and each shard goes to the executors once. A list
of one shard is searched and resolved in a single pass; of a longer one each shard's finds are put together per text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.session import settle

SHARD_BYTES = 32 << 20  # of words in one automaton, which takes some ten times that on an executor

_built: dict[str, object] = {}  # this worker's automaton; one at a time


def _automaton(name: str, words: Iterable[str]):
    import ahocorasick

    if name not in _built:
        _built.clear()
        trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words:
            trie.add_word(w)
        trie.make_automaton()
        _built[name] = trie
    return _built[name]


def longest_at(trie, text: str) -> dict[int, int]:
    """Start of every find -> end of the longest word there."""
    found: dict[int, int] = {}
    if len(trie):
        for last, n in trie.iter(text):  # finds come by their end, so a longer one from the same start comes later
            found[last + 1 - n] = last + 1
    return found


def leftmost(found: dict[int, int]) -> Iterator[tuple[int, int]]:
    """From left to right the longest word at each place, without overlaps."""
    at = 0
    for start in sorted(found):
        if start >= at:
            at = found[start]
            yield start, at


class TermSet:
    """A list of words, ready on the executors: `words` is a list, or a frame whose first column holds them."""

    def __init__(self, spark: SparkSession, words: list[str] | DataFrame, shard_bytes: int = SHARD_BYTES) -> None:
        if isinstance(words, list):
            words = spark.createDataFrame([(w,) for w in words], "term string")
        word = F.lower(F.col(words.columns[0]))
        distinct = words.select(word.alias("term")).where(F.col("term") != "").distinct()
        total = distinct.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]  # 64: an object on the executor
        n = max(1, -(-int(total) // shard_bytes))
        placed = distinct.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(n)))
        self.shards = []
        for i in range(n):  # one shard at a time on the driver: about `shard_bytes`
            held = [r.term for r in placed.where(F.col("shard") == i).select("term").toLocalIterator()]
            self.shards.append((uuid.uuid4().hex, spark.sparkContext.broadcast(held)))


def find_terms(df: DataFrame, doc: str, col: str, terms: TermSet) -> DataFrame:
    """(doc, term): the words found in each text from left to right, the longest first where several begin; finds do not overlap.

    One row per find. A NULL text has none.
    """
    texts = df.select(F.col(doc).alias("doc"), F.lower(F.col(col)).alias("text")).where("text IS NOT NULL")
    kind = texts.schema["doc"].dataType.simpleString()
    if len(terms.shards) == 1:
        name, words = terms.shards[0]

        def search(batches):
            for b in batches:
                trie = _automaton(name, words.value)
                docs, found = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    here = [text[s:e] for s, e in leftmost(longest_at(trie, text))]
                    docs += [i] * len(here)
                    found += here
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(docs, pa.int32())), pa.array(found, pa.string())], names=["doc", "term"])

        return texts.mapInArrow(search, f"doc {kind}, term string").withColumnRenamed("doc", doc)

    # every shard's longest finds per text, as one array each; then the longest of all at each start, from left to right
    rows = texts.withColumn("row", F.monotonically_increasing_id())  # rows that repeat a doc are texts of their own
    rows = settle(rows)
    parts = None
    for name, words in terms.shards:
        def spans(batches, name=name, words=words):
            for b in batches:
                trie = _automaton(name, words.value)
                each = [[(s << 32) | e for s, e in longest_at(trie, t).items()] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(each, pa.list_(pa.int64()))], names=["row", "spans"])

        one = rows.select("row", "text").mapInArrow(spans, "row long, spans array<long>").where("size(spans) > 0")
        parts = one if parts is None else parts.unionAll(one)
    met = rows.join(parts.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "row")

    def resolve(batches):
        for b in batches:
            docs, found = [], []
            for i, (text, packed) in enumerate(zip(b.column("text").to_pylist(), b.column("spans").to_pylist())):
                longest = dict((p >> 32, p & 0xFFFFFFFF) for p in sorted(packed))
                here = [text[s:e] for s, e in leftmost(longest)]
                docs += [i] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(docs, pa.int32())), pa.array(found, pa.string())], names=["doc", "term"])

    return met.select("doc", "text", "spans").mapInArrow(resolve, f"doc {kind}, term string").withColumnRenamed("doc", doc)


def _occurs(name: str, words):
    @F.pandas_udf("boolean")
    def occurs(texts: pd.Series) -> pd.Series:
        trie = _automaton(name, words.value)
        return texts.map(lambda t: bool(len(trie)) and next(trie.iter(t), None) is not None).astype(bool)

    return occurs


def has_any(col: Column, terms: TermSet) -> Column:
    """True where a word of the list occurs anywhere in the text; NULL counts as the empty text."""
    held = F.lit(False)
    for name, words in terms.shards:
        held = held | _occurs(name, words)(F.lower(F.coalesce(col, F.lit(""))))
    return held
