"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a vector of transformed statistics. Each class has a mean and a covariance, shrunk towards the pooled
one and then towards its average variance; the score is the logistic of the classes' log-density difference
(Mahalanobis distances and determinants from Cholesky factors computed once) plus the log odds of the classes.

Cases: a null text counts as empty; empty texts have the statistics 0 and a score like any; whole texts are read;
rows without a label (or with several labels that disagree evenly) are not learned from; repeated labels count once;
with fewer than two classes every score is the share of label 1, or 0.5 without any; rows with a null id are scored
and never learned from; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:'\"()-?")] = 5
_CLASS[0x80:] = 6
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 7
NAMES = (
    "log_bytes", "log_words", "lower", "upper", "digit", "space", "point", "high", "sign", "word_mean", "word_sd", "longest", "distinct", "pairs",
    "line_mean", "line_repeat", "entropy", "comma_end", "sign_end", "capital_start", "short", "squeeze",
)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text, in the order of ``NAMES``."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * len(NAMES)
    a = np.frombuffer(data, np.uint8)
    hist = np.bincount(a, minlength=256)
    share = np.bincount(_CLASS, weights=hist, minlength=8) / n
    words = data.split()
    w = max(1, len(words))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (_CLASS[a] != 4).view(np.int8), [0]])))
    lengths = edge[1::2] - edge[::2] if edge.size else np.zeros(1)
    ends, starts = (a[edge[1::2] - 1], a[edge[::2]]) if edge.size else (a[:0], a[:0])
    lines = data.split(b"\n")
    p = hist[hist > 0] / n
    root = math.sqrt
    return [
        math.log1p(n), math.log1p(len(words)), *(root(share[k]) for k in range(1, 8)), math.log1p(float(lengths.mean())), math.log1p(float(lengths.std())),
        math.log1p(float(lengths.max())), len(set(words)) / w, len(set(zip(words, words[1:]))) / max(1, len(words) - 1), math.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        float(-(p * np.log(p)).sum()), root((_CLASS[ends] == 5).sum() / w), root((_CLASS[ends] == 7).sum() / w), root((_CLASS[starts] == 2).sum() / w), root((lengths <= 2).sum() / w),
        math.log(n / len(zlib.compress(data, 1))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def learn(labelled: DataFrame, shrink: float = 0.15, ridge: float = 0.02) -> dict:
    """Model from every row of ``labelled`` (``x``, ``label``): sums and products are added up within partitions."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                y = b.column(1).to_numpy(zero_copy_only=False)
                for k, t in total.items():
                    own = x[y == k]
                    t += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0], total[1]], pa.list_(pa.float64()))], names=["label", "s"])

    parts = labelled.select("x", F.col("label").cast("int")).mapInArrow(sums, "label int, s array<double>")
    parts = parts.select("label", F.posexplode("s").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v")).collect()  # 2 x (1 + d + d * d) numbers
    total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for r in parts:
        total[r.label][r.k] = r.v
    n = np.array([total[0][0], total[1][0]])
    model: dict = {"share": float(n[1] / n.sum()) if n.sum() else 0.5, "classes": None}
    if n.min() < 2:
        return model
    means = [total[k][1 : 1 + d] / n[k] for k in (0, 1)]
    within = [total[k][1 + d :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * within[0] + n[1] * within[1]) / n.sum()
    middle = (n[0] * means[0] + n[1] * means[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    classes = []
    for k in (0, 1):
        own = ((1 - shrink) * within[k] + shrink * pooled) / np.outer(scale, scale)
        own = (1 - ridge) * own + ridge * max(np.trace(own) / d, 1e-6) * np.eye(d)
        chol = np.linalg.cholesky(own)
        classes.append(((means[k] - middle) / scale, np.linalg.inv(chol), float(np.log(np.diag(chol)).sum())))
    return model | {"classes": classes, "middle": middle, "scale": scale}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of label 1 for rows of statistics."""
    share = min(max(model["share"], 1e-6), 1 - 1e-6)
    prior = math.log(share / (1 - share))
    if model["classes"] is None:
        return np.full(len(x), prior)
    z = (x - model["middle"]) / model["scale"]
    dens = []
    for mean, whiten, half_det in model["classes"]:
        m = (z - mean) @ whiten.T
        dens.append(-0.5 * (m * m).sum(axis=1) - half_det)
    return dens[1] - dens[0] + prior


def score(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` (which have ``x``) with ``score`` in place of ``x``."""
    kept = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(b.num_rows, -1)
            s = 1 / (1 + np.exp(-np.clip(log_odds(model, x), -700, 700))) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(s, pa.float64())], names=[*kept, "score"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("score", "double"))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """``of, label``: one label for each document, that of most of its rows."""
    mean = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.avg(F.col(column).cast("double")).alias("m"))
    return mean.where("m is not null and m != 0.5").select("of", (F.col("m") > 0.5).cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, column: str, train, cut: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every text; learns from the labelled rows for which ``train(doc_id)`` holds."""
    made = keep(features(docs), "statistics")
    known = made.where(train(F.col("doc_id"))).join(labels_of(labels, column), F.col("doc_id") == F.col("of")).select("x", "label")
    return score(made, learn(known)).withColumn("predicted", (F.col("score") >= cut).cast("int"))
