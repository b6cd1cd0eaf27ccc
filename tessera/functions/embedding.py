"""Vectors of texts: a deterministic default by hashed terms, or any model.

The default needs no model and no training: each term adds 1 or -1 at a place that its md5 gives; vectors have length
1. A null text, or one without terms, has the zero vector.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TERM = re.compile(r"[A-Za-z0-9_+\-./]+|[一-鿿]")


def hashed(texts: list[str], dim: int = 256) -> np.ndarray:
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        for t in _TERM.findall((text or "").lower()):
            h = hashlib.md5(t.encode()).digest()
            row[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 else -1
        norm = float(np.sqrt(row @ row))
        if norm:
            row /= norm
    return out


def embedded(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Column:
    """Vectors of length 1, by a model made once per worker, or the default."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else hashed
        for s in batches:
            v = np.asarray(model(s.fillna("").tolist()), np.float32)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True)) if v.size else np.ones((len(v), 1))
            yield pd.Series(list(v / np.where(norm < 1e-8, 1.0, norm)), dtype=object)

    return run(text)
