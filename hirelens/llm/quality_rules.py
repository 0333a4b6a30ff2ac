"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one bit per failed rule. A policy is a mask of
the rules it enforces, so applying one, comparing versions and ablating rules are bitwise operations on a stored column. All of
it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import EDGE_SPACE, let, settle

SYMBOLS = "#*$%&|<>"  # fixed value of the contract
WINDOW = 8

# Bits in the ledger, in this order; a new rule is appended, so that old masks keep their meaning.
RULES = {
    "too_few_words": lambda: F.col("n_words") < 20,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "duplicate_lines": lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
POLICIES = {"v1": BASE, "v2": BASE | BIT["word_length"] | BIT["symbols"], "v3": sum(BIT.values())}


def _repeat_words(words: Column) -> Column:
    """Words inside a window of eight words that the text holds twice or more, first occurrence included.

    Windows become hashes with their places; sorted, equal hashes are neighbours. Only texts whose hashes repeat are sorted.
    """
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda wh: F.when(
        F.size(wh) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(wh) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(wh, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>")))
    neighbours = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    starts = lambda hs: let(
        F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        lambda s: F.array_sort(F.transform(neighbours(s), lambda x: x["i"])))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(starts(hs), covered))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words): the measurements, all longs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(EDGE_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(EDGE_SPACE)) != "")
    in_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    in_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    # characters that are not white space, or not symbols: counted by what a replacement leaves
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), in_words.alias("w"), in_lines.alias("l"),
        left("[\\x20\\x09-\\x0D]+").alias("word_chars"), (F.char_length(text) - left(f"[{SYMBOLS}]+")).alias("n_symbols"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `failed_mask`, one bit per rule failed. One row per row of `docs`; NULL text has no words.

    An empty table gives an empty ledger; repeated rows are ledgered each.
    """
    mask = sum((F.when(rule(), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measure(docs).withColumn("failed_mask", mask.cast("int"))


def verdict(book: DataFrame, policy: str = "v2") -> DataFrame:
    """`base_failed` and `kept` (the policy's verdict; never true where the base fails)."""
    base = F.col("failed_mask").bitwiseAND(F.lit(BASE)) != 0
    kept = F.col("failed_mask").bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0
    return book.withColumns({"base_failed": base, "kept": kept})


def stored(docs: DataFrame) -> DataFrame:
    """The ledger of `docs`, written to the shared folder and read back: rules run once, all policies and counts read what they left."""
    return settle(ledger(docs))


def with_policies(book: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with the verdict of `policy`, one column `kept_<version>` per policy, and what the policy's ablation says of the row.

    `sole_rule` names the only rule of the policy that the document fails ('' where it fails none or several): without that rule it
    would be kept. `sole_rule_docs` is how many documents of the ledger the policy would win back so (0 where there is no such rule).
    The counts come from distinct masks, at most 2 ** rules rows, and meet the ledger by its mask.
    """
    hit = F.col("failed_mask").bitwiseAND(F.lit(POLICIES[policy]))
    rules = [r for r in RULES if POLICIES[policy] & BIT[r]]
    sole = F.coalesce(*[F.when(hit == BIT[r], F.lit(r)) for r in rules], F.lit(""))
    won = settle(ablations(book).where(F.col("policy") == policy).select(F.col("rule").alias("sole_rule"), F.col("n_only").alias("sole_rule_docs")))
    versions = {f"kept_{v}": F.col("failed_mask").bitwiseAND(F.lit(m | BASE)) == 0 for v, m in POLICIES.items()}
    met = verdict(book, policy).withColumns({**versions, "sole_rule": sole}).join(won, "sole_rule", "left")
    return met.withColumn("sole_rule_docs", F.coalesce("sole_rule_docs", F.lit(0).cast("long")))


def ablations(book: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only): documents a rule of the policy fails, and those only it fails (kept without it).

    One aggregation to distinct masks (at most 2 ** rules rows), then bit arithmetic on those.
    """
    masks = book.groupBy("failed_mask").agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(m).alias("policy_mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"))
        for p, m in POLICIES.items() for r in RULES if m & BIT[r]]))
    hit = F.col("failed_mask").bitwiseAND(F.col("policy_mask"))
    return masks.select("failed_mask", "n", pairs.alias("x")).select("failed_mask", "n", "x.*").groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
