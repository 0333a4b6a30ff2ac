"""How far the sources of a language differ in their terms: Gustavson's row-by-row accumulation over a term-major index.

For two groups g and s of a language the distance is the sum over all kept terms of |p_g - p_s|. A term that a group does not have
counts with the group's baseline b (its p at count 0), so no group has empty places and a plain sparse product would miss most of the sum.
With D[g][s] = sum over the terms of g of (|p_g - b_s| - |b_g - b_s|) and, over the terms that both have,
X[g][s] = sum of (|p_g - p_s| - |p_g - b_s| - |b_g - p_s| + |b_g - b_s|), the distance is

    V |b_g - b_s| + D[g][s] + D[s][g] + X[g][s]

exactly, in whole numbers. The index is dealt out by term; each task holds its terms' posting lists (term-major) and, group after group,
scatters the group's terms through them into one dense accumulator with a place for each peer. What leaves a task is one number per
pair of groups, never a pair of postings. D needs no postings at all: a group's sorted p against all peers' baselines.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import settle

SCALE, PRIOR = 1_000_000_000, 5  # fixed values of the contract: p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V))
MIN_DOCS, TOP_TERMS = 30, 50
HELD = 400_000  # (group, term) counts a task holds before it sends them on
POSTINGS = 50_000  # postings of a block of the index, about
SCATTER = 1_000_000  # postings that are scattered at a time

# Letters as bytes: A-Z to a-z, a-z and all bytes of characters beyond ASCII as they are, the rest to space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters and of characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and rows of `docs` that hold the term. A group without terms has one NULL term.

    A task counts what it reads before anything is shuffled, so that a group with a third of all rows sends its terms, not its words.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])

    def sent(n, n_docs):
        rows = [(*g, t.decode("utf-8"), c, n_docs[g][t]) for g, held in n.items() for t, c in held.items()]
        rows += [(*g, None, 0, 0) for g in n]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    def count(batches):
        n, n_docs, held = {}, {}, 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary())):
                g = (lang, source)
                if g not in n:
                    n[g], n_docs[g] = Counter(), Counter()
                    held += 1
                here = Counter(terms_of(text.as_py()))
                held -= len(n[g])
                n[g].update(here)
                n_docs[g].update(here.keys())
                held += len(n[g])
                if held > HELD:
                    yield sent(n, n_docs)
                    n, n_docs, held = {}, {}, 0
        if n:
            yield sent(n, n_docs)

    rows = own.mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p in whole numbers; decimals of 38 digits hold the product for any count below 10^19."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR), wide(total + PRIOR * terms))


def kept_shares(counts: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """`counts` (see term_counts, settled) to
    groups (lang, source, total, terms, base) - every group, base NULL in a language without kept terms - and
    shares (lang, source, term, p, lang_p), the kept terms with a count in the group."""
    words = counts.where(F.col("term").isNotNull())
    vocabulary = settle(words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    held = settle(words.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = settle(
        counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total")
        .withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1))))))
    met = held.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    shares = met.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_p"))
    return groups, shares


def _accumulate(peers: pa.Table, postings: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block of the index: (a, b, part of the sum without V |b_a - b_b|) for the pairs of places a < b in `peers`."""
    base = peers.column("base").to_numpy()
    who = pc.index_in(postings.column("source"), value_set=peers.column("source").combine_chunks()).to_numpy()
    term = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    p = postings.column("p").to_numpy()
    by_term = np.argsort(term, kind="stable")
    list_who, list_p = who[by_term], p[by_term]
    starts = np.searchsorted(term[by_term], np.arange(term.max() + 2))
    by_group = np.argsort(who, kind="stable")
    group_starts = np.searchsorted(who[by_group], np.arange(len(base) + 1))
    order = np.argsort(base)
    out_a, out_b, out_v = [], [], []
    for g in range(len(base)):
        mine = by_group[group_starts[g]:group_starts[g + 1]]
        if not len(mine):
            continue
        row = np.zeros(len(base), np.int64)  # the dense accumulator: one place for each peer
        own = np.sort(p[mine])
        sums = np.concatenate(([0], np.cumsum(own)))
        below = np.searchsorted(own, base[order])  # how many of the group's p lie under each peer's baseline
        row[order] = (base[order] * below - sums[below]) + (sums[-1] - sums[below] - base[order] * (len(own) - below))
        row -= len(own) * np.abs(base[g] - base)
        # terms that a peer has too: through their posting lists, a bounded number of postings at a time
        lengths = starts[term[mine] + 1] - starts[term[mine]]
        ends = np.cumsum(lengths)
        lo = 0
        while lo < len(mine):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SCATTER, "right")))
            n = lengths[lo:hi]
            at = np.arange(n.sum()) + np.repeat(starts[term[mine[lo:hi]]] - (np.cumsum(n) - n), n)
            peer, theirs, ours = list_who[at], list_p[at], np.repeat(p[mine[lo:hi]], n)
            later = peer > g  # the correction is the same from both sides: count it once
            peer, theirs, ours = peer[later], theirs[later], ours[later]
            fix = np.abs(ours - theirs) - np.abs(ours - base[peer]) - np.abs(base[g] - theirs) + np.abs(base[g] - base[peer])
            np.add.at(row, peer, fix)
            lo = hi
        others = np.arange(len(base)) != g
        out_a.append(np.minimum(g, np.flatnonzero(others)))
        out_b.append(np.maximum(g, np.flatnonzero(others)))
        out_v.append(row[others])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (out_a, out_b, out_v))


def pair_distances(groups: DataFrame, shares: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """(lang, source, item, value): both directions of every pair of sources of a language.

    A language's index is cut by term into blocks of about `postings` postings; a block's task holds the block and one row of accumulators.
    """
    # how many blocks a language's index is cut into, by its true size
    sizes = settle(shares.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(postings)).cast("long").alias("blocks")))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    cut = shares.join(sizes, "lang").select("lang", block, "source", "term", "p")
    copies = groups.join(sizes, "lang").select("lang", "source", "base", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def accumulate(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("part_sum", pa.int64())]
        if not right.num_rows:
            return pa.schema(kinds).empty_table()
        peers = left.sort_by("source")
        a, b, v = _accumulate(peers, right)
        names = peers.column("source").combine_chunks()
        lang = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(a), np.int64)))
        return pa.table([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(v)], schema=pa.schema(kinds))

    parts = copies.groupBy("lang", "block").cogroup(cut.groupBy("lang", "block")).applyInArrow(
        accumulate, "lang string, source string, item string, part_sum long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("part_sum"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "part_sum")
    both = both.select("lang", "x.source", "x.item", "part_sum")
    # every pair there is, also in a language without kept terms and of groups without terms: this is the result's own size
    left, right = groups.alias("g"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base")).alias("s")
    pairs = left.join(right, "lang").where(F.col("source") != F.col("item"))
    flat = F.col("terms") * F.abs(F.col("base") - F.col("item_base"))
    return pairs.join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", "item", F.coalesce(flat + F.coalesce("part_sum", F.lit(0)), F.lit(0)).alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, postings: int = POSTINGS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of `docs`.

    part `pair`: every other source of the language with the distance; part `term`: the `top` terms whose share in the group lies most
    above the language's. Ranks from 1 by value downwards, ties by item in byte order. NULL text, lang and source count as empty; a row
    is a document, also where a doc_id repeats. Groups without terms have pairs at their baseline; the only group of a language has none.
    An empty table gives no rows.
    """
    counts = settle(term_counts(docs))
    groups, shares = kept_shares(counts, min_docs)
    shares = settle(shares)
    pairs = pair_distances(groups, shares, postings).withColumn("part", F.lit("pair"))
    above = shares.where(F.col("p") > F.col("lang_p")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("lang_p")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(by)).select(*columns).unionByName(best.select(*columns))
