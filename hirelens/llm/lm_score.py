"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Each context (the previous word) is a restaurant whose dishes come from one parent restaurant they share, and the parent's from
a uniform base. Every word of the training rows is a context. Those with at least `OPEN` of the training tokens, at most 1 / OPEN of them,
have their totals in a table of fixed size that tasks are sent, whatever the corpus; the totals of all others travel between tasks.

The work is dealt by the following word. Tasks turn blocks of documents into (shard of words) rows: words, contexts, training
counts, and the documents each pair occurs in. A shard merges the counts of its words from all blocks, seats customers by
Gibbs sampling, given the totals of the restaurants, and adds its words' log probabilities up per document. Only those sums
travel back. What a shard adds to its rarer contexts goes, packed, to shards of contexts, and each sum goes back to the shards that asked
for it. Samples are drawn twice with the same seeds: first to learn the totals of each sample, then to score with
them, so the predictive of every sample sums to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import documents, partitions, settle, shared_folder, shuffles_dropped, small_batches
from hirelens.llm.quality_classifier import fold

END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space
OPEN = 2.0**-14
CLOSED = 0xFFFF  # in place of a frequent context: the hash of a rarer one is beside it; where there is none, the parent speaks
RARE = 1 << 16  # contexts of a shard from here on are its rarer ones, in order of their hashes
SHARDS = 4  # in a partition, one after the other, so that a task holds a part of it only
ROUNDS = 4  # in which the shards are shuffled, so that the disk holds a part of them twice only
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 60_000
DISCOUNT, STRENGTH = 0.75, 1.0  # of a context's restaurant
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 2, 3
ROW = "block string, shard int, words binary, width binary, context binary, train binary, times binary, docs binary, rare binary, doc_ids array<long>, n_tokens array<long>, held_out array<boolean>"
EMPTY = b""


CACHE = 200_000  # words a worker remembers
_word_hash: dict = {}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = _word_hash
    if len(known) > CACHE:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def tokens(text: str) -> np.ndarray:
    """64-bit hashes of the words, then of the end."""
    return np.append(word_hashes(words_of(text)), np.uint64(END))


def _gather(batches) -> Iterator[tuple[list, list, list]]:
    """Blocks of (doc_ids, held_out, token arrays)."""
    ids, held, arrays, size = [], [], [], 0
    for batch in batches:
        for doc, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
            x = tokens(text)
            ids.append(doc), held.append(out), arrays.append(x)
            size += len(x)
            if size >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                yield ids, held, arrays
                ids, held, arrays, size = [], [], [], 0
    if ids:
        yield ids, held, arrays


def _count_words(batches):
    for _, _, arrays in _gather(batches):
        w, n = np.unique(np.concatenate(arrays), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["w", "n"])


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _deal(contexts, shards: int):
    """Documents -> rows by block and shard, and one row a block (shard -1) with its documents."""

    def run(batches):
        import uuid

        heads = contexts.value  # sorted hashes of the open contexts
        for ids, held, arrays in _gather(batches):
            block = uuid.uuid4().hex
            size = np.array([len(x) for x in arrays])
            flat = np.concatenate(arrays)
            words, where = np.unique(flat, return_inverse=True)
            before = np.concatenate([where[-1:], where[:-1]])  # each document ends with END, which stands before the next one's first word
            at = np.searchsorted(heads, words)
            at[at == len(heads)] = 0
            context = np.where(heads[at] == words, at, CLOSED) if len(heads) else np.full(len(words), CLOSED)
            pair = where.astype(np.int64) << 32 | before
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            start = _starts(pair)
            docs = np.repeat(np.arange(len(ids), dtype=np.uint16), size)[order]
            train = np.add.reduceat((~np.repeat(np.array(held), size))[order].astype(np.int64), start)
            times = np.diff(np.append(start, len(pair)))
            owner, prior = pair[start] >> 32, pair[start] & 0xFFFFFFFF
            ctx = context[prior].astype("<u2")
            rare = words[prior[ctx == CLOSED]]
            rare_at = np.concatenate([[0], np.cumsum(ctx == CLOSED)])
            width = np.bincount(owner, minlength=len(words)).astype("<u4")
            shard = shard_of(words, shards)
            first = _starts(shard)
            ends = np.append(first[1:], len(words))
            pair_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            token_at = np.append(start, len(pair))
            rows = []
            for a, b in zip(first, ends):
                p, q = pair_at[a], pair_at[b]
                rows.append((block, int(shard[a]), words[a:b].tobytes(), width[a:b].tobytes(), ctx[p:q].tobytes(), train[p:q].astype("<u4").tobytes(),
                             times[p:q].astype("<u4").tobytes(), docs[token_at[p] : token_at[q]].tobytes(), rare[rare_at[p] : rare_at[q]].tobytes(), None, None, None))
            rows.append((block, -1, EMPTY, EMPTY, EMPTY, EMPTY, EMPTY, EMPTY, EMPTY, ids, size.tolist(), held))
            cols = list(zip(*rows))
            kinds = [pa.string(), pa.int32(), *[pa.binary()] * 7, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            names = [c.split()[0] for c in ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


def seat(count: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after `count` customers sat down one after the other.

    `new`: weight of a new table with the dish, (strength + discount * tables of the restaurant) * parent probability. A customer
    after j others opens one with probability new / (new + j - discount * tables). Customers far down the queue sit in groups
    of an eighth of those before them, within which that probability hardly moves.
    """
    tables = (count > 0).astype(np.float64)
    active = np.flatnonzero(count > 1)
    seated = np.ones(len(active))
    while len(active):
        left = count[active] - seated
        group = np.minimum(np.maximum(seated // 8, 1), left)
        t = tables[active]
        p = new[active] / (new[active] + seated - discount * t)
        tables[active] = t + rng.binomial(group.astype(np.int64), np.clip(p, 0, 1))
        seated = seated + group
        going = seated < count[active]
        active, seated = active[going], seated[going]
    return tables


class Shard:
    """The merged counts of a shard's words: `pair` is word number << 32 | context, sorted.

    Rows: words, width, context, train, and the hashes of the contexts that are CLOSED, which are numbered from RARE on.
    """

    def __init__(self, rows: list[tuple[bytes, ...]]) -> None:
        parts = [(np.frombuffer(w, "<u8"), np.frombuffer(k, "<u4"), np.frombuffer(c, "<u2"), np.frombuffer(n, "<u4")) for w, k, c, n, *_ in rows]
        rare = [np.frombuffer(x, "<u8") for r in rows for x in r[4:]]
        self.words = np.unique(np.concatenate([p[0] for p in parts]))
        self.rare = np.unique(np.concatenate(rare)) if rare else np.zeros(0, np.uint64)
        self.at = [self._pairs(w, k, c.astype(np.int64), x) for (w, k, c, _), x in zip(parts, rare or [None] * len(parts))]
        every = np.concatenate(self.at)
        order = np.argsort(every)
        every = every[order]
        start = _starts(every)
        self.pair, self.count = every[start], np.add.reduceat(np.concatenate([p[3] for p in parts])[order].astype(np.float64), start)
        self.word, self.context = self.pair >> 32, self.pair & 0xFFFFFFFF
        self.seen = np.bincount(self.word, self.count, len(self.words))

    def _pairs(self, words, width, context, rare) -> np.ndarray:
        if rare is not None:
            context[context == CLOSED] = RARE + np.searchsorted(self.rare, rare)
        return np.repeat(np.searchsorted(self.words, words), width).astype(np.int64) << 32 | context

    def beside(self, totals: dict, rare: dict) -> dict:
        """`totals` of the frequent contexts with those of the shard's rarer ones behind them, as `context` numbers them."""
        fill = lambda x: np.zeros(RARE - len(x))
        return {**totals, **{k: np.concatenate([totals[k], fill(totals[k]), v]) for k, v in rare.items()}}

    def samples(self, totals: dict, vocabulary: int, seed: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tables of pairs, customers of words in the parent, tables of words in the parent) of each sweep after the burn-in."""
        rng = np.random.default_rng(seed)
        base = 1 / (vocabulary + 1)
        closed = self.context == CLOSED
        direct = np.bincount(self.word[closed], self.count[closed], len(self.words))
        inner = np.flatnonzero(~closed)
        word, count, head = self.word[inner], self.count[inner], totals["tables"][self.context[inner]]
        tables = (count > 0).astype(np.float64)
        served = direct + np.bincount(word, tables, len(self.words))
        own = (served > 0).astype(np.float64)
        for sweep in range(BURN_IN + SAMPLES):
            likely = parent(served, own, totals["customers"], totals["parent_tables"], base)
            tables = seat(count, (STRENGTH + DISCOUNT * head) * likely[word], DISCOUNT, rng)
            served = direct + np.bincount(word, tables, len(self.words))
            own = seat(served, np.full(len(served), (PARENT_STRENGTH + PARENT_DISCOUNT * totals["parent_tables"]) * base), PARENT_DISCOUNT, rng)
            if sweep >= BURN_IN:
                full = np.zeros(len(self.pair))
                full[inner] = tables
                yield full, served, own


def parent(served, own, customers: float, tables: float, base: float) -> np.ndarray:
    return (served - PARENT_DISCOUNT * own + (PARENT_STRENGTH + PARENT_DISCOUNT * tables) * base) / (PARENT_STRENGTH + customers)


def predictive(shard: Shard, samples, sample_totals: list[dict], vocabulary: int) -> np.ndarray:
    """Probability of each pair's word after its context, averaged over the samples."""
    mean = np.zeros(len(shard.pair))
    closed = shard.context == CLOSED
    head = np.where(closed, 0, shard.context)
    for (tables, served, own), totals in zip(samples, sample_totals):
        back = parent(served, own, totals["customers"], totals["parent_tables"], 1 / (vocabulary + 1))[shard.word]
        p = (shard.count - DISCOUNT * tables + (STRENGTH + DISCOUNT * totals["tables"][head]) * back) / (STRENGTH + totals["counts"][head])
        mean += np.where(closed, back, p)
    return mean / len(sample_totals)


def _by_shard(batches, columns: list[str], by: str = "shard") -> Iterator[tuple[int, list[tuple]]]:
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [by, *columns])):
            if row[0] != at:
                if held:
                    yield at, held
                at, held = row[0], []
            held.append(row[1:])
    if held:
        yield at, held


COUNTS = ["words", "width", "context", "train", "rare"]
SUMS = "sample int, kind int, slot int, value double, owner int, shard int, contexts binary, sums binary"
REPLY = "!"  # blocks of sums that come back begin with it: before all others, by round and shard of contexts


def _replies(rows: list[tuple], at: int) -> tuple[list[tuple], list[list[dict]]]:
    """The rows of documents, and the totals of the shard's rarer contexts that came back: a list of samples for each round."""
    rounds: dict = {}
    for r in rows:
        if r[at].startswith(REPLY):
            rounds.setdefault(r[at].split("-")[0], []).append(np.frombuffer(r[0], "<f4").reshape(SAMPLES + 1, -1))
    sums = [np.concatenate(rounds[k], axis=1).astype(np.float64) for k in sorted(rounds)]
    return [r for r in rows if not r[at].startswith(REPLY)], [[{"tables": x[i], "counts": x[SAMPLES]} for i in range(SAMPLES)] for x in sums]


def _totals(shared, vocabulary: int, shards: int, seed: int):
    """What the shards' samples add to the totals: rows (sample, kind, slot, value), at most a row a frequent context, kind, sample and
    task, and for each shard and shard of contexts (owner, shard, contexts, sums) of the rarer ones: tables of each sample, then customers."""
    names = [c.split()[0] for c in SUMS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def sent(*cols):
        n = next(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches):
        sums: list = [None] * SAMPLES
        for number, rows in _by_shard(batches, [*COUNTS, "block"]):
            rows, back = _replies(rows, len(COUNTS))
            shard = Shard([r[: len(COUNTS)] for r in rows])
            inner, m = shard.context < RARE - 1, len(shard.rare)
            far = shard.context >= RARE
            place = shard.context[far] - RARE
            n = len(shared.value["tables"])
            start = shard.beside(shared.value, {"tables": back[0][-1]["tables"] if back else np.ones(m)})
            rare = np.zeros((SAMPLES + 1, m), "<f4")
            rare[SAMPLES] = np.bincount(place, shard.count[far], m)
            for s, (tables, served, own) in enumerate(shard.samples(start, vocabulary, [seed, number])):
                new = [np.bincount(shard.context[inner], tables[inner], n), np.bincount(shard.context[inner], shard.count[inner], n), np.array([served.sum()]), np.array([own.sum()])]
                sums[s] = new if sums[s] is None else [x + y for x, y in zip(sums[s], new)]
                rare[s] = np.bincount(place, tables[far], m)
            if not back:  # of the first sweeps only the last tables are read again
                rare[: SAMPLES - 1] = rare[SAMPLES] = 0
            owner = shard_of(shard.rare, shards)
            first = _starts(owner)
            ends = np.append(first[1:], m)
            if m:
                yield sent(None, None, None, None, owner[first], np.full(len(first), number), [shard.rare[a:b].tobytes() for a, b in zip(first, ends)], [rare[:, a:b].tobytes() for a, b in zip(first, ends)])
        for s, parts in enumerate(sums):
            for kind, values in enumerate(parts or ()):
                slot = np.flatnonzero(values)
                yield sent(np.full(len(slot), s), np.full(len(slot), kind), slot, values[slot], None, None, None, None)

    return run


def _context_sums(number: int):
    """Rows sorted by owner -> for each shard that asked, the sums of its contexts over all shards, in its order."""

    def run(batches):
        for owner, rows in _by_shard(batches, ["shard", "contexts", "sums"], "owner"):
            contexts = [np.frombuffer(c, "<u8") for _, c, _ in rows]
            every, where = np.unique(np.concatenate(contexts), return_inverse=True)
            given = np.concatenate([np.frombuffer(x, "<f4").reshape(SAMPLES + 1, -1) for _, _, x in rows], axis=1)
            total = np.stack([np.bincount(where, x, len(every)) for x in given]).astype("<f4")
            ends = np.cumsum([len(c) for c in contexts])
            for (shard, *_), c, e in zip(rows, contexts, ends):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "block": pa.array([f"{REPLY}{number}-{owner:09d}"]),
                    "words": pa.array([total[:, where[e - len(c) : e]].tobytes()], pa.binary())})

    return run


def _answer(shared, vocabulary: int, n_train: int, seed: int):
    """Per block and shard: what the shard's words add to each of the block's documents that has any."""

    def run(batches):
        start, per_sample = shared.value
        for number, rows in _by_shard(batches, [*COUNTS, "block", "times", "docs"]):
            rows, back = _replies(rows, len(COUNTS))
            shard = Shard([r[: len(COUNTS)] for r in rows])
            before, after = back or ([{"tables": np.zeros(0), "counts": np.zeros(0)}] * SAMPLES,) * 2
            samples = shard.samples(shard.beside(start, before[-1]), vocabulary, [seed, number])
            log_p = np.log10(predictive(shard, samples, [shard.beside(t, r) for t, r in zip(per_sample, after)], vocabulary))
            seen = shard.seen[shard.word]
            base = np.log10((seen + 0.5) / (n_train + 0.5 * (vocabulary + 1)))
            for pairs, (*_, block, times, docs) in zip(shard.at, rows):
                i = np.repeat(np.searchsorted(shard.pair, pairs), np.frombuffer(times, "<u4"))
                doc, where = np.unique(np.frombuffer(docs, "<u2"), return_inverse=True)
                sums = [np.bincount(where, v[i], len(doc)) for v in (log_p, base, (seen > 0).astype(np.float64))]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block]), "shard": pa.array([number], pa.int32()), "docs": pa.array([doc.astype("<u2").tobytes()], pa.binary()),
                    "sums": pa.array([np.stack(sums).tobytes()], pa.binary())})

    return run


def _assemble(batches):
    """Rows sorted by (block, shard), the block's documents first -> a row a document."""
    head, total = None, None

    def out():
        ids, n_tokens, held = head
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(np.rint(total[2]).astype(np.int64)), pa.array(total[1]), pa.array(total[0])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for shard, docs, sums, ids, n_tokens, held in zip(*(batch.column(c).to_pylist() for c in ("shard", "docs", "sums", "doc_ids", "n_tokens", "held_out"))):
            if shard < 0:
                if head is not None:
                    yield out()
                head, total = (ids, n_tokens, held), np.zeros((3, len(ids)))
            else:
                doc = np.frombuffer(docs, "<u2")
                total[:, doc] += np.frombuffer(sums, np.float64).reshape(3, len(doc))
    if head is not None:
        yield out()


def _collect_totals(rows, contexts: int) -> list[dict]:
    out = [{"tables": np.zeros(max(contexts, 1)), "counts": np.zeros(max(contexts, 1)), "customers": 0.0, "parent_tables": 0.0} for _ in range(SAMPLES)]
    for r in rows:
        if r.kind < 2:
            out[r.sample][("tables", "counts")[r.kind]][r.slot] = r.value
        else:
            out[r.sample][("customers", "parent_tables")[r.kind - 2]] = r.value
    return out


def lm_scores(docs: DataFrame, parts: int = 5, left_out: int = 1, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of `docs`.

    Trained on the rows whose crc32 of doc_id modulo `parts` is not `left_out`; every row is scored. NULL or empty text is its
    end token. Repeated rows count and are scored each. A row without doc_id is in fold 0. An empty table gives no rows; with no
    training row at all the model is uniform over the one unknown word.
    """
    spark = docs.sparkSession
    marked = documents(docs).withColumn("held_out", fold(F.col("doc_id"), parts) == left_out)
    counted = settle(marked.where("NOT held_out").mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    vocabulary, n_train = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(math.ceil(OPEN * n_train), 1)
    heads = np.sort(np.array([r.w for r in counted.where(F.col("n") >= least).collect()], np.int64).view(np.uint64))  # at most 1 / OPEN rows
    width = partitions(spark)
    shards = SHARDS * width
    contexts = spark.sparkContext.broadcast(heads)
    path = shared_folder(spark)
    marked.mapInArrow(_deal(contexts, shards), ROW).withColumn("round", F.when(F.col("shard") < 0, -1).otherwise(F.pmod("shard", F.lit(ROUNDS)))).write.option(
        "compression", "zstd").partitionBy("round").parquet(path)
    dealt = spark.read.schema(f"{ROW}, round int").parquet(path)

    def packed(df: DataFrame) -> DataFrame:
        """As `settle`, in less room: counts and sums are repetitive."""
        at = shared_folder(spark)
        df.write.option("compression", "zstd").parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    def by_shard(replies: list[DataFrame], run, kind: str, *cols: str) -> DataFrame:
        """What `run` makes of each shard's rows, which come sorted by block."""
        out = []
        for k in range(ROUNDS):
            rows = dealt.where(F.col("round") == k).select("shard", "block", *cols)
            for r in replies:
                rows = rows.unionByName(r.where(F.pmod("shard", F.lit(ROUNDS)) == k), allowMissingColumns=True)
            out.append(packed(rows.repartition(width, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, kind)))
        return reduce(DataFrame.unionByName, out)

    def totals(start: dict, replies: list[DataFrame], salt: int) -> tuple[list[dict], DataFrame]:
        """The totals of the frequent contexts and, to be read by shard, those of the rarer ones."""
        rows = by_shard(replies, _totals(spark.sparkContext.broadcast(start), vocabulary, shards, seed + salt), SUMS, *COUNTS)
        frequent = rows.where("owner IS NULL").groupBy("sample", "kind", "slot").agg(F.sum("value").alias("value")).collect()  # a few numbers a frequent context
        asked = rows.where("owner IS NOT NULL").select("owner", "shard", "contexts", "sums").repartition(width, "owner").sortWithinPartitions("owner", "shard")
        return _collect_totals(frequent, len(heads)), packed(asked.mapInArrow(_context_sums(salt), "shard int, block string, words binary"))

    with small_batches(spark), shuffles_dropped(spark):
        first, rare = totals({"tables": np.ones(max(len(heads), 1)), "customers": float(n_train), "parent_tables": float(vocabulary)}, [], 0)
        per_sample, rarer = totals(first[-1], [rare], 1)
        shared = spark.sparkContext.broadcast((first[-1], per_sample))
        sums = by_shard([rare, rarer], _answer(shared, vocabulary, n_train, seed + 1), "block string, shard int, docs binary, sums binary", *COUNTS, "times", "docs")
    none = lambda kind: F.lit(None).cast(kind)
    met = dealt.where("shard < 0").select("block", "shard", F.col("docs"), none("binary").alias("sums"), "doc_ids", "n_tokens", "held_out").unionByName(
        sums.select("block", "shard", "docs", "sums", none("array<long>").alias("doc_ids"), none("array<long>").alias("n_tokens"), none("array<boolean>").alias("held_out")))
    done = met.repartition(width, "block").sortWithinPartitions("block", "shard").mapInArrow(
        _assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
