"""Reranking: pairs of query and text get a score from a model, the best stay.

A model is a function from two lists of texts to scores or logits; it is made once per worker by ``load`` and fed in
batches. Without one the order by lexical overlap is the default. Scores are new columns: hits are never changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tokens import terms
from tessera.operators.lexical import best

Scorer = Callable[[list[str], list[str]], np.ndarray]


def of_logits(logits: np.ndarray) -> np.ndarray:
    """One score a row: the only column, the second of two or more, else the largest value."""
    x = np.asarray(logits, float)
    if x.ndim == 1:
        return x
    if x.ndim == 2:
        return x[:, 0] if x.shape[1] == 1 else x[:, 1]
    return x.reshape(len(x), -1).max(axis=1)


def of_yes_no(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """The probability of yes of two logits."""
    d = np.asarray(yes, float) - np.asarray(no, float)
    return np.where(d >= 0, 1 / (1 + np.exp(-np.abs(d))), np.exp(-np.abs(d)) / (1 + np.exp(-np.abs(d))))


def by_model(hits: DataFrame, load: Callable[[], Scorer], top: int, batch: int = 16, most_chars: int | None = None) -> DataFrame:
    """``hits`` (``query_id, id, query, text``) scored by a model; the best ``top`` per query, with their rank."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            qs, ts = q.fillna("").tolist(), [x[:most_chars] for x in t.fillna("")]
            parts = [of_logits(model(qs[i : i + batch], ts[i : i + batch])) for i in range(0, len(qs), batch)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return best(hits.drop("score", "rank").withColumn("score", run("query", "text")), top)


def by_overlap(hits: DataFrame, top: int) -> DataFrame:
    """Scored by the part of the query's terms that the text has."""
    q, t = F.array_distinct(terms(F.col("query"))), F.array_distinct(terms(F.col("text")))
    score = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)
    return best(hits.drop("score", "rank").withColumn("score", score), top)


def make(backend: str | None, load: Callable[[], Scorer] | None = None, free_mib: list[int] | None = None, need_mib: int = 4000, **how):
    """A reranker by name: ``none``, ``overlap`` or ``model``. A model that finds no device with enough free memory
    gives none, so hits keep their order."""
    if backend in (None, "none", ""):
        return None
    if backend == "overlap":
        return lambda hits: by_overlap(hits, **how)
    if backend == "model":
        if load is None:
            raise ValueError("a model needs load")
        return None if free_mib and max(free_mib) < need_mib else lambda hits: by_model(hits, load, **how)
    raise ValueError(f"unknown backend {backend!r}")
