"""A corpus pipeline out of the operators of `hirelens.llm`: each stage works on all that the one before it kept.

run() gives the packed pieces of the corpus: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import line_dedup, packing, quality_classifier, simhash, substring_dedup
from hirelens.llm.common import settle, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECTED_BELOW = 0.5  # score of label 1


def counted(docs: DataFrame) -> DataFrame:
    """The columns of `documents`, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as more likely bad than good go; NULL text is scored as empty and stays NULL."""
    measured = settle(quality_classifier.features(docs))  # else measuring and summing would run in one stage, with two Python workers a task
    known = quality_classifier.training(measured, table(spark, sf_dir, "labels"))
    return quality_classifier.accept(docs.select(*COLUMNS), quality_classifier.fit(known), REJECTED_BELOW)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in the largest doc_id that has them; no row goes."""
    done = line_dedup.line_dedup(docs, carry=["lang", "source"])
    return counted(done.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked fingerprints stays."""
    return simhash.keep_one(docs.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first document; documents that were nothing else go."""
    return counted(substring_dedup.cut_passages(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, neighbours by BM25."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("substring dedup", passages),
    ("packing", packed),
]
ORACLE_SQL = None  # fingerprints, verified passages and retrieval have no SQL form; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
