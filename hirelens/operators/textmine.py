"""Terms, vocabularies, TF-IDF and similarity to a template."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hirelens.functions.text import word_tokens
from hirelens.operators.prefix import hot_key_join, same_keys
from hirelens.operators.terms import TermSet, find_terms
from hirelens.session import settle

COUNTED_ROWS = 256  # texts that are counted together in a task


def tokenise(df: DataFrame, doc: str, col: str, words: list[str] | DataFrame | TermSet | None = None, place: bool = False) -> DataFrame:
    """(doc, term) rows, one per occurrence.

    Without `words`: Latin words and bigrams of Han runs, by built-in expressions. With `words`: only these words, the longest match
    first, by one automaton over all of them (see `terms`).

    With `place` the texts are first spread by document id. Counting terms per document then needs
    no further shuffle, and the texts are several times smaller than the (doc, term) rows that
    would move instead. Leave it off where terms are only counted over all documents; `term_lists`
    counts them per document without a shuffle.
    """
    if place:
        df = df.select(doc, col).repartition(doc)
    if words is None:
        return df.select(doc, F.explode(word_tokens(F.col(col))).alias("term"))
    return find_terms(df, doc, col, words if isinstance(words, TermSet) else TermSet(df.sparkSession, words))


def term_lists(df: DataFrame, doc: str, col: str) -> DataFrame:
    """(doc, tokens, whole): the terms of each text as an array, to be counted by `term_counts` or `slot_counts`.

    `whole`: no other row has this id, so the terms of the document can be counted where its row is.
    """
    rows = df.select(doc, col)
    again = settle(rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(doc))
    part = lambda how, whole: same_keys(rows, again, [doc], how).select(doc, word_tokens(F.col(col)).alias("tokens"), F.lit(whole).alias("whole"))
    return part("left_anti", True).unionByName(part("left_semi", False))


def drop_stopwords(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Remove the terms listed in `stop` (term)."""
    # settled: a list of usual size is then broadcast, and the tokens are not shuffled
    return tokens.join(settle(stop.select("term")), "term", "left_anti").select(*tokens.columns)


def term_freq(tokens: DataFrame) -> DataFrame:
    """Occurrences per term; rows that are counted already (tf) add up."""
    n = F.sum("tf") if "tf" in tokens.columns else F.count(F.lit(1))
    return tokens.groupBy("term").agg(n.alias("n"))


def top_terms(terms: DataFrame, k: int = 15, weight: str = "n") -> DataFrame:
    """The k terms of highest weight, ties by term."""
    return terms.orderBy(F.desc(weight), "term").limit(k)


def benefit_freq(df: DataFrame, group: str, benefits: str = "benefits") -> DataFrame:
    """Postings per group that name a benefit."""
    return df.select(group, F.explode(F.array_distinct(benefits)).alias("benefit")).groupBy(group, "benefit").agg(
        F.count(F.lit(1)).alias("n"))


def contrast_terms(tokens: DataFrame, high: Column) -> DataFrame:
    """Per term: share of all words in the high and in the low group, difference, log ratio (+1 smoothed)."""
    terms = tokens.groupBy("term").agg(
        F.count_if(high).alias("n_high"), F.count_if(~high).alias("n_low")).where(F.col("n_high") + F.col("n_low") > 0)
    all_ = terms.agg(F.struct(F.sum("n_high").alias("high"), F.sum("n_low").alias("low")).alias("t")).scalar()
    t = terms.withColumn("_t", all_)
    smooth = (F.col("n_high") + 1) * F.col("_t.low") / ((F.col("n_low") + 1) * F.col("_t.high"))
    return t.select(
        "term", "n_high", "n_low",
        F.try_divide(F.col("n_high"), F.col("_t.high")).alias("share_high"),
        F.try_divide(F.col("n_low"), F.col("_t.low")).alias("share_low"),
        F.ln(smooth).alias("log_ratio"),
    ).withColumn("share_diff", F.col("share_high") - F.col("share_low"))


# --- TF-IDF ---------------------------------------------------------------------------------

def _count_rows(width: int | None):
    """(doc, tokens) -> (doc, term, tf), or with the slots of the terms in their place, a few texts at a time."""

    def slots(terms: pa.Array) -> pa.Array:
        coded = terms.dictionary_encode()
        numbers = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % width for t in coded.dictionary.to_pylist()]
        return pa.array(numbers, pa.int64()).take(coded.indices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                doc, tokens = batch.slice(start, COUNTED_ROWS).columns
                terms = pc.list_flatten(tokens)
                rows = pa.table({"row": pc.list_parent_indices(tokens), "term": terms if width is None else slots(terms)})
                n = rows.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                for part in n.to_batches():
                    yield pa.RecordBatch.from_arrays([doc.take(part["row"]), part["term"], part["count_all"]], names=[batch.schema.names[0], "term", "tf"])

    return run


def _counted(tokens: DataFrame, doc: str, width: int | None) -> DataFrame:
    term = F.col("term") if width is None else hash_slot(F.col("term"), width)
    if "tokens" not in tokens.columns:
        return tokens.groupBy(doc, term.alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    schema = T.StructType([tokens.schema[doc], T.StructField("term", T.StringType() if width is None else T.LongType()), T.StructField("tf", T.LongType())])
    whole = tokens.where("whole").select(doc, "tokens").mapInArrow(_count_rows(width), schema)
    parts = tokens.where("NOT whole").select(doc, F.explode("tokens").alias("term"))
    return whole.unionByName(_counted(parts, doc, width))


def term_counts(tokens: DataFrame, doc: str) -> DataFrame:
    """(doc, term, tf) of (doc, term) rows or of `term_lists`.

    Lists are counted inside their rows: no task holds a table of (doc, term) pairs and no text is shuffled. The rows of an id that comes
    more than once are one document and are counted by a shuffle.
    """
    return _counted(tokens, doc, None)


def slot_counts(tokens: DataFrame, doc: str, width: int) -> DataFrame:
    """`term_counts` with the slots of the terms (`hash_slot`) in their place."""
    return _counted(tokens, doc, width)


def document_frequency(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf) with idf = ln((1+n)/(1+df)) + 1."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn(
        "idf", F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def hot_terms(freq: DataFrame, n_docs: Column, share: float = 0.05) -> DataFrame:
    """Terms that occur in at least `share` of the documents.

    Their number is at most (mean number of distinct terms per document) / share, whatever the
    number of documents, so the list is safe to broadcast.
    """
    return freq.where(F.col("df") >= F.lit(share) * n_docs).select("term")


def weigh(counts: DataFrame, freq: DataFrame, hot: DataFrame, doc: str) -> DataFrame:
    """(doc, term, w) with w = tf * idf; hot terms are split over many tasks."""
    joined = hot_key_join(counts, freq.select("term", "idf"), "term", hot, doc)
    return joined.select(doc, "term", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf(tokens: DataFrame, doc: str, n_docs: Column) -> DataFrame:
    """(doc, term, w): TF-IDF weights, each document scaled to length 1."""
    counts = settle(term_counts(tokens, doc))  # texts are cut once
    freq = settle(document_frequency(counts, n_docs))
    return unit_length(weigh(counts, freq, settle(hot_terms(freq, n_docs)), doc), doc)


def hash_slot(term: Column, width: int) -> Column:
    """The slot of a term among `width`: the first 32 bits of its MD5, the same in any engine."""
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(width))


def hashed_tfidf(tokens: DataFrame, doc: str, n_docs: Column, width: int = 1 << 18) -> DataFrame:
    """(doc, slot, w): TF-IDF weights over `width` hashed slots, each document scaled to length 1.

    For vocabularies without end (typing errors, numbers, ids): terms of one slot count as one term, so the table of weights has `width`
    rows at most however many terms there are, and the engine can send it to all tasks instead of shuffling the counts by term.
    """
    counts = settle(slot_counts(tokens, doc, width))
    freq = settle(document_frequency(counts, n_docs)).select("term", "idf")
    weights = counts.join(freq, "term").select(doc, "term", (F.col("tf") * F.col("idf")).alias("w"))
    return unit_length(weights, doc).withColumnRenamed("term", "slot")


def unit_length(weights: DataFrame, doc: str) -> DataFrame:
    """Scale every document to length 1."""
    # a window: one document's terms are never more than its words
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return weights.select(doc, "term", (F.col("w") / norm).alias("w"))


def template(vectors: DataFrame, members: DataFrame, doc: str) -> DataFrame:
    """(term, weight): centroid of the unit vectors of the member documents."""
    n = members.agg(F.count(F.lit(1))).scalar()
    return vectors.join(members.select(doc), doc, "left_semi").groupBy("term").agg((F.sum("w") / n).alias("weight"))


def fold_templates(vectors: DataFrame, members: DataFrame, doc: str, folds: int) -> DataFrame:
    """(fold, term, weight): the template for a fold is built from the members of all other folds.

    `fold` of a document is its id modulo `folds`. Sums are additive: total minus own fold.
    """
    fold = lambda: F.pmod(F.col(doc), F.lit(folds)).cast("int")
    own = vectors.join(members.select(doc), doc, "left_semi").groupBy(fold().alias("fold"), "term").agg(F.sum("w").alias("_own"))
    sizes = members.groupBy(fold().alias("fold")).agg(F.count(F.lit(1)).alias("_size"))
    n = members.agg(F.count(F.lit(1))).scalar()
    every = own.groupBy("term").agg(F.sum("_own").alias("_all")).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    both = every.join(own, ["fold", "term"], "left").join(sizes, "fold", "left")
    others = F.col("_all") - F.coalesce("_own", F.lit(0.0))
    return both.select("fold", "term", F.try_divide(others, n - F.coalesce("_size", F.lit(0))).alias("weight"))


def similarity(
    tokens: DataFrame, members: DataFrame, doc: str, n_docs: Column, folds: int | None = None,
) -> DataFrame:
    """(doc, similarity): cosine of every document to the template of the member documents.

    The members' vectors are needed to build the template; for the rest only two sums per document
    are, so the large (doc, term) table meets the term table once and no vector table is shuffled
    by term a second time. With `folds` every document meets the template of the other folds.
    """
    # the small-to-large tables are written once: tokens are not cut again for every use
    counts = settle(term_counts(tokens, doc))
    freq = settle(document_frequency(counts, n_docs))
    hot = settle(hot_terms(freq, n_docs))
    member_vectors = unit_length(weigh(counts.join(members.select(doc), doc, "left_semi"), freq, hot, doc), doc)
    w = F.col("tf") * F.col("idf")
    if folds is None:
        weights = template(member_vectors, members, doc)
        terms = settle(freq.select("term", "idf").join(weights, "term", "left"))
        joined = hot_key_join(counts, terms, "term", hot, doc)
        dot = F.sum(w * F.coalesce("weight", F.lit(0.0)))
        length = terms.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).scalar()
        sums = joined.groupBy(doc).agg(dot.alias("_dot"), F.sqrt(F.sum(w * w)).alias("_norm"))
        return sums.select(doc, F.try_divide(F.col("_dot"), F.col("_norm") * length).alias("similarity"))
    weights = settle(fold_templates(member_vectors, members, doc, folds))
    # one array of fold weights per term keeps the join at one row per (doc, term)
    arrays = weights.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("fold", "weight"))).alias("by_fold"))
    lengths = weights.groupBy("fold").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"))
    terms = settle(freq.select("term", "idf").join(arrays, "term", "left"))
    joined = hot_key_join(counts, terms, "term", hot, doc)
    mine = F.coalesce(F.try_element_at(F.col("by_fold"), F.pmod(F.col(doc), F.lit(folds)).cast("int")), F.lit(0.0))
    sums = joined.groupBy(doc).agg(F.sum(w * mine).alias("_dot"), F.sqrt(F.sum(w * w)).alias("_norm"))
    return (
        sums.withColumn("fold", F.pmod(F.col(doc), F.lit(folds)).cast("int")).join(lengths, "fold", "left")
        .select(doc, F.try_divide(F.col("_dot"), F.col("_norm") * F.col("_length")).alias("similarity"))
    )


def similarity_grade(sim: Column, grades: int = 5) -> Column:
    """Grade 1..grades of a similarity in 0..1, bands of equal width, 1.0 in the highest."""
    return F.least(F.floor(sim * F.lit(float(grades))) + 1, F.lit(grades)).cast("int")


def similarity_grades(df: DataFrame, sim: str, col: str, grades: int = 5) -> DataFrame:
    """Rows and mean of `col` per similarity grade."""
    return df.where(F.col(sim).isNotNull()).groupBy(similarity_grade(F.col(sim), grades).alias("grade")).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"))


def fit_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Slope, intercept and r2 of y on x, over all rows or per group."""
    return df.groupBy(*(by or [])).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


HASH_FACTOR, HASH_SIZE = 2_654_435_761, 1 << 32  # golden-ratio multiplier


def scatter_points(df: DataFrame, x: str, y: str, fraction: float, key: str) -> DataFrame:
    """A part of the points, for a scatter chart: those whose integer key hashes below `fraction`, the same in every run."""
    mixed = F.pmod(F.pmod(F.col(key), F.lit(1 << 31)) * F.lit(HASH_FACTOR), F.lit(HASH_SIZE))
    return df.where(mixed < F.lit(int(fraction * HASH_SIZE))).select(x, y).dropna("any")
