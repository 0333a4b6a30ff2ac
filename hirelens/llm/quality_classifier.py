"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class is a Gaussian over the statistics, with its own covariance shrunk towards the pooled one and the diagonal. The
score is the logistic of the difference of the two log densities (half the difference of squared Mahalanobis distances, plus
the log determinants), read off Cholesky factors that are computed once and sent to the tasks.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.common import documents, settle

# Counted bytes of UTF-8; the classes are the statistics' own.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:",
    "mark": b"!?", "symbol": b"#*$%&|<>@^~_=+\\/{}[]", "newline": b"\n", "space": b" \t\r\x0b\x0c"}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in CLASSES.items()}
STATISTICS = ["log_words", "word_length", "distinct_words", "repeated_pairs", "repeated_lines", "line_length", *CLASSES, "wide"]
D = len(STATISTICS)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; counts become log rates with half a count added, so none is infinite."""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), len(raw)
    pairs = set(zip(words, words[1:]))
    rate = lambda count, total: math.log((count + 0.5) / (total + 1))
    return [
        math.log1p(n), math.log1p(sum(map(len, words)) / n) if n else 0.0, rate(len(set(words)), n),
        rate(max(n - 1, 0) - len(pairs), n), rate(len(lines) - len(set(lines)), len(lines)), rate(n, len(lines)),
        *(rate(int(seen[m].sum()), size) for m in _MASKS.values()), rate(int(seen[128:].sum()), size)]


def _features(batches):
    for batch in batches:
        values = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each whole text."""
    return documents(docs).mapInArrow(_features, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes, and the log density offsets."""

    mean: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray
    soften: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = [self.offset[c] - 0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.soften, -500, 500)))


def _moments(batches):
    total = {}
    for batch in batches:
        label = np.array(batch.column("label").to_pylist(), np.int64)
        x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, D)
        for c in (0, 1):
            own = x[label == c]
            old = total.get(c, np.zeros(1 + D + D * D))
            total[c] = old + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    for c, sums in total.items():
        yield pa.RecordBatch.from_pydict({"label": pa.array([c], pa.int64()), "at": pa.array([list(range(len(sums)))]), "sums": pa.array([sums.tolist()])})


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.1, soften: float = 1.0) -> Discriminant:
    """Fit on every row of (x, label 0/1). Tasks send one row of sums a class, so what reaches the driver is of fixed size.

    `shrink`: share of the pooled covariance in each class's own; `ridge`: variance added to each statistic. A class
    without rows takes the mean and covariance of the other, which makes all scores equal to 0.5 plus the prior.
    """
    sums = labelled.select("x", F.col("label").cast("long").alias("label")).where("label IN (0, 1)").mapInArrow(_moments, "label long, at array<long>, sums array<double>")
    got = sums.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + D + D * D) rows at most
    total = np.zeros((2, 1 + D + D * D))
    for r in got:
        total[r.label, r.i] = r.v
    count, both = total[:, 0], total.sum(axis=0)
    mean = np.zeros((2, D))
    scatter = np.zeros((2, D, D))
    for c in (0, 1):
        own = total[c] if count[c] else both
        n = max(own[0], 1)
        mean[c] = own[1 : 1 + D] / n
        scatter[c] = own[1 + D :].reshape(D, D) / n - np.outer(mean[c], mean[c])
    pooled = (count[:, None, None] * scatter).sum(axis=0) / max(count.sum(), 1)
    whiten, offset = np.zeros((2, D, D)), np.zeros(2)
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * scatter[c] + shrink * pooled + ridge * np.eye(D))
        whiten[c] = np.linalg.inv(factor)
        offset[c] = math.log((count[c] + 1) / (count.sum() + 2)) - np.log(np.diag(factor)).sum()
    return Discriminant(mean, whiten, offset, soften)


def _score(model):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score): probability-like score of label 1 for each row of `features`; the empty text has one like any other."""
    return measured.select("doc_id", "x").mapInArrow(_score(model), "doc_id long, score double")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`. A NULL doc_id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)), F.lit(0))


def training(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, label): the labelled documents of the training folds (crc32 mod 4 is not 2). Statistics meet the labels, not texts.

    A document that is labelled several times counts once; one with both labels is not learnt from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(F.col("label").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    agreed = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    return measured.join(agreed.drop("other"), "doc_id").select("x", "label")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of `docs`.

    Fitted on the training folds only, and on the text only. NULL text counts as empty; a NULL label is no label, repeated labels
    are one and conflicting ones none; repeated rows are scored each; with no labelled row at all every score is 0.5. An empty table gives no rows.
    """
    measured = settle(features(docs))  # read to fit and to score: each text is measured once
    scored = score(measured, fit(training(measured, labels)))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def _accept(model, threshold: float):
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, D)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return run


def accept(docs: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of `threshold` or more, as they are: no shuffle, every column kept."""
    return docs.mapInArrow(_accept(model, threshold), docs.schema)


def python_fold(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts
