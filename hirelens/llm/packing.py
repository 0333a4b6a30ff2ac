"""Packing by lexical retrieval: windows are filled with the seed document's BM25 neighbours.

Documents are dealt by a hash into shards of about `shard_docs`. A shard has an inverted index of its documents' token ids;
document frequencies are those of the whole table, in an array as long as the vocabulary. A seed opens a window, its nearest
unused neighbours follow in order of BM25, and the last one is cut where the window is full: what remains of it is the next
seed. Only the last window of a shard can be short.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import documents, settle, small_batches

WINDOW = 4096
END = 2  # closes each document
VOCABULARY = 1 << 16  # ids are held in two bytes
CACHE = 200_000  # words in each of the two generations a worker remembers
K1, B = 1.2, 0.75
SHARD_PART = 32  # bits of sequence_id below the shard number

_tokenizers: dict = {}
_place = np.zeros(VOCABULARY, np.int32)  # scratch of `distinct`
_count = np.arange(1 << 20, dtype=np.int32)


# The tokenizer file's own split, over ASCII text and over any text.
# (letters come first: an alternative is told by its first character but for the apostrophe, so the order of the others is free)
_ASCII_SPLIT = re.compile(r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9]+", re.ASCII)
_LATIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿŒœŠšŽž]*")  # composed letters of western Europe, which a plain pattern can tell
_LATIN_SPLIT = re.compile(r"[a-zà-öø-ÿßœšž]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-zà-öø-ÿßœšž0-9]+", re.ASCII)
_SPLIT = regex.compile(r"[\p{L}]+|[\p{N}]|'(?:[stmd]|re|ve|ll)|[^\s\p{L}\p{N}]+")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\u0130]")  # texts with these (U+0130 grows when lower-cased), or with "<|", the tokenizer takes whole


class WordTokenizer:
    """Ids of whole texts from a tokenizer file; each of its words goes through the library once and is remembered.

    The normalising (NFC, lower case) and the split are done here as the file states them; texts with control characters or
    special tokens are left to the library altogether. Words the task has not met are encoded many to a call: each ends with
    an id that carries the end-of-word mark, which is where the ids are cut apart.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner, self.known, self.older = Tokenizer.from_file(path), {}, {}
        # for words that are normalised and split already, one space between two
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.inner.get_vocab(with_added_tokens=False)
        if self.inner.get_vocab_size() > VOCABULARY:
            raise ValueError("ids do not fit two bytes")
        self.ends = np.zeros(VOCABULARY, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u2")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer splits words in another way than expected")
        starts, raw = [0, *(2 * cuts[:-1]).tolist()], ids.tobytes()
        self.known.update(zip(words, (raw[a:b] for a, b in zip(starts, (2 * cuts).tolist()))))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text, the closing id included."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        parts: list = []
        for t in texts:
            if "<|" in t or _CONTROL.search(t):
                parts.append(None)
            elif t.isascii():
                parts.append(_ASCII_SPLIT.findall(t.lower()))
            elif _LATIN.fullmatch(t):
                parts.append(_LATIN_SPLIT.findall(t.lower()))
            else:
                parts.append(_SPLIT.findall(unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3").lower()))
        known, older = self.known, self.older
        fresh = list(set().union(*(p for p in parts if p)) - known.keys())
        if older:  # words still in use move to the younger generation
            known.update((w, older[w]) for w in fresh if w in older)
            fresh = [w for w in fresh if w not in known]
        for at in range(0, len(fresh), 2048):
            self._learn(fresh[at : at + 2048])
        close = np.array([END], "<u2").tobytes()
        return [
            (np.array(self.inner.encode(t, add_special_tokens=False).ids, "<u2").tobytes() if p is None else b"".join(map(known.__getitem__, p))) + close
            for t, p in zip(texts, parts)]


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list whose texts have about `chars` characters together, so that a batch of long texts is not held twice."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _tokenize(path: str):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, 500_000):  # their different words fit the processor's cache
                ids = tokenizer(path).encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): two bytes an id."""
    return documents(docs).mapInArrow(_tokenize(path), "doc_id long, ids binary")


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a document and how often each comes, without a sort: one place stands for all places of an id."""
    at = np.arange(len(ids), dtype=np.int32)
    _place[ids] = at
    stands = _place[ids]
    one = stands == at
    return ids[one], np.bincount(stands, minlength=len(ids))[one]


def _tokenize_counting(path: str):
    """Rows as of `tokenize`, and one row a task of what it has seen: documents, ids, and of each id the documents that have it."""

    def run(batches):
        seen, docs, size = np.zeros(VOCABULARY, "<u4"), 0, 0
        for batch in _tokenize(path)(batches):
            for ids in batch.column("ids"):
                x = np.frombuffer(ids.as_buffer(), "<u2")
                seen[distinct(x)[0]] += 1
                size += len(x)
            docs += len(batch)
            none = [pa.nulls(len(batch), k) for k in (pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *none], names=["doc_id", "ids", "seen", "docs", "size"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary()), pa.array([docs], pa.int64()), pa.array([size], pa.int64())],
            names=["doc_id", "ids", "seen", "docs", "size"])

    return run


def _frequency(batches):
    seen = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for counts in batch.column(0):
            seen += np.frombuffer(counts.as_buffer(), "<u4")
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["id", "n"])


class ShardIndex:
    """BM25 over the documents of one shard: postings sorted by id, weights computed when it is built."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        ids, owner, count = [], [], []
        for d, x in enumerate(docs):
            u, c = distinct(x)
            ids.append(u), count.append(c), owner.append(np.full(len(u), d, np.int32))
        self.terms = ids
        flat, owner, tf = np.concatenate(ids), np.concatenate(owner), np.concatenate(count).astype(np.float32)
        length = np.array([len(x) for x in docs], np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean_length))
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight, self.size = owner[order].astype(np.intp), weight[order].astype(np.float32).astype(np.float64), len(docs)  # as `bincount` takes them
        bounds = np.searchsorted(flat[order], np.arange(VOCABULARY + 1)).astype(np.int32)
        self.bounds, self.width = bounds[:-1], np.diff(bounds)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct ids of `seed`."""
        terms = self.terms[seed].astype(np.int64)
        lo, width = self.bounds[terms], self.width[terms]
        ends = np.cumsum(width, dtype=np.int32)
        at = np.repeat(lo - (ends - width), width)
        at += _count[: len(at)] if len(at) <= len(_count) else np.arange(len(at), dtype=np.int32)
        return np.bincount(self.owner[at], self.weight[at], self.size)


def pack_shard(docs: list[np.ndarray], index: ShardIndex, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. Seeds in order of the list, after the remainder of a cut one."""
    out, used = [], np.zeros(len(docs), bool)
    sequence, next_seed, cut = 0, 0, None  # cut: (document, start) of what remains of the last piece
    while True:
        if cut is None:
            while next_seed < len(docs) and used[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return out
            seed, start = next_seed, 0
            used[seed] = True
        else:
            seed, start = cut
        cut, offset, order, k = None, 0, None, 0
        doc = seed
        while True:
            take = min(len(docs[doc]) - start, window - offset)
            out.append((doc, start, take, sequence, offset))
            offset += take
            if start + take < len(docs[doc]):
                cut = (doc, start + take)
            if offset == window:
                break
            if order is None:
                rank = index.scores(seed)
                rank[used] = -1
                order = np.lexsort((np.arange(len(docs)), -rank))
            while k < len(order) and used[order[k]]:
                k += 1
            if k == len(order):
                break
            doc, start = int(order[k]), 0
            used[doc] = True
        sequence += 1


def _pack(idf_shared, mean_length: float):
    def emit(shard, names, docs):
        pieces = pack_shard(docs, ShardIndex(docs, idf_shared.value, mean_length))
        wide = [x.astype("<u4") for x in docs]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([names[d] for d, *_ in pieces], pa.int64()), "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()), "ids_crc32": pa.array([zlib.crc32(wide[d][s : s + n].tobytes()) for d, s, n, *_ in pieces], pa.int64()),
            "doc_tokens": pa.array([len(docs[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([(shard << SHARD_PART) + p[3] for p in pieces], pa.int64()), "offset": pa.array([p[4] for p in pieces], pa.int64()),
            "ids": pa.array([docs[d][s : s + n].tobytes() for d, s, n, *_ in pieces], pa.binary())})

    def run(batches):
        at, names, docs = None, [], []
        for batch in batches:
            for shard, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    if docs:
                        yield emit(at, names, docs)
                    at, names, docs = shard, [], []
                names.append(doc), docs.append(np.frombuffer(ids, "<u2"))
        if docs:
            yield emit(at, names, docs)

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str, shard_docs: int = 1024) -> DataFrame:
    """Pieces of at most WINDOW tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (two bytes each).

    Each id of each document lies in exactly one piece. The empty (or NULL) text is its closing id. Rows that repeat a doc_id
    are packed each as a document of its own. Shards are dealt by a hash of doc_id, text length and a row's place, so copies
    spread. A shard is read by one task at a time and holds about `shard_docs` documents, whatever the table's size. An empty
    table gives no pieces.
    """
    spark = docs.sparkSession
    with small_batches(spark):  # else a worker holds ten thousand texts at once
        written = settle(documents(docs).mapInArrow(_tokenize_counting(path), "doc_id long, ids binary, seen binary, docs long, size long"))
    tokens, counts = written.where("seen IS NULL"), written.where("seen IS NOT NULL")  # the latter reads no ids
    known = counts.select("seen").mapInArrow(_frequency, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row an id of the vocabulary
    n, total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    df = np.zeros(VOCABULARY, np.float64)
    for r in known:
        df[r.id] = r.n
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))
    shards = max(1, round(n / shard_docs))
    dealt = tokens.select(F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.lit(shards)).alias("shard"), "doc_id", "ids")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(_pack(idf, max(total / max(n, 1), 1.0)), PIECES)
