"""Language ID by multilingual mixture inference.

Each language is a smoothed distribution over hashed letter trigrams. A document is a mixture of languages: its
proportions are found by expectation-maximisation over its trigrams' likelihoods, and the set of languages by a
penalised likelihood (half the log of the number of trigrams for each language beyond the first). The prediction is
the language of the largest proportion.

Cases: a null text, or one without a letter, is ``und`` with score 0; without any learned language every text is
``und``; equal proportions go to the first language by code point; whole texts are read; repeated rows are predicted
each; rows with a null language are not learned from, rows with a null id are never held out; the tables may be empty;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused
from tessera.llm.encoding import drop_encoder

BINS = 1 << 14
#: Characters counted at a time; bounds the memory that a text of any length takes.
CHUNK = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: For each code point of the basic plane: itself if it is a letter, else the space.
_FOLD = np.array([i if chr(i).isalpha() else 32 for i in range(0x10000)], np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """How many trigrams of lower-cased letters fall in each bin; runs of anything else count as one space."""
    counts, before = np.zeros(BINS, np.int64), np.array([32], np.uint32)
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        a = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        a = np.where(a < 0x10000, _FOLD[np.minimum(a, 0xFFFF)], a)
        a = np.concatenate([before, a, [32] * (at + CHUNK >= len(text))]).astype(np.uint32)
        space = a == 32
        a = a[~(space & np.concatenate([[False], space[:-1]]))]
        if a.size >= 3:
            h = a[:-2] * _M[0] + a[1:-1] * _M[1] + a[2:] * _M[2]
            h ^= h >> np.uint32(15)
            counts += np.bincount(((h * np.uint32(0x2C1B3C6D)) >> np.uint32(18)).astype(np.int64), minlength=BINS)
        before = a[-2:]
    return counts


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, from every row of ``docs`` (``text``, ``lang``) that has both.

    Counts are summed within partitions first; a language is at most ``BINS`` rows of the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoder()
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                held[lang] = held.get(lang, 0) + gram_counts(text.as_py())
        for lang, counts in held.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * found.size, pa.string()), pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["lang", "gram", "n"])

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(sums["lang"]))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((BINS, len(langs)))
    if langs:
        counts[np.array(sums["gram"]), [at[x] for x in sums["lang"]]] = sums["n"]
        counts += 0.5 * counts.sum(axis=1, keepdims=True) / max(counts.sum(), 1) + 0.01
        counts /= counts.sum(axis=0)
    return langs, counts


def proportions(p: np.ndarray, weight: np.ndarray, steps: int = 40, least: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mixture proportions and log-likelihood of grams with probabilities ``p`` (grams x languages), by EM."""
    theta = np.full(p.shape[1], 1.0 / p.shape[1])
    total = weight.sum()
    for _ in range(steps):
        new = theta * ((weight / (p @ theta)) @ p) / total
        moved = np.abs(new - theta).max()
        theta = new
        if moved < least:
            break
    return theta, float(weight @ np.log(p @ theta))


def infer(probabilities: np.ndarray, text: str) -> np.ndarray | None:
    """Proportions of all languages; None without a letter. Starts from all languages and drops, from the least
    proportion on, each whose part in the likelihood is below its penalty."""
    if not _LETTER.search(text):
        return None
    g = gram_counts(text)
    found = np.flatnonzero(g)
    weight, p = g[found].astype(float), probabilities[found]
    total = weight.sum()
    penalty = 0.5 * np.log(total + 1)
    chosen = np.arange(p.shape[1])
    theta, fit = proportions(p, weight)
    single = np.log(p).T @ weight
    while chosen.size > 1:
        if chosen.size > 2:
            fewer = np.delete(chosen, int(theta.argmin()))
            theta_less, fit_less = proportions(p[:, fewer], weight)
        else:
            fewer = chosen[[int(single[chosen].argmax())]]
            theta_less, fit_less = np.ones(1), float(single[fewer[0]])
        best = single[chosen].max()
        if chosen.size > 2 and fit - best <= (chosen.size - 1) * penalty:  # one language does as well as all of them
            fewer = chosen[[int(single[chosen].argmax())]]
            theta_less, fit_less = np.ones(1), float(best)
        elif fit - fit_less > penalty:
            break
        chosen, theta, fit = fewer, theta_less, fit_less
    out = np.zeros(p.shape[1])
    out[chosen] = theta
    return (out * total + 0.5) / (total + 0.5 * out.size)  # a few trigrams are no certainty


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the predicted language's proportion) beside all their columns."""
    langs, probabilities = model
    shared = docs.sparkSession.sparkContext.broadcast(probabilities.astype(np.float32))  # BINS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoder()
        p = shared.value.astype(np.float64)
        for b in batches:
            names, scores = [], []
            for text in (x.as_py() for x in b.column(b.num_columns - 1)):
                theta = infer(p, text) if text and langs else None
                names.append("und" if theta is None else langs[int(theta.argmax())])
                scores.append(0.0 if theta is None else min(1.0, float(theta.max())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    schema = docs.drop("lang_pred", "score").schema
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (name,) = unused(docs, "read_text")
    return docs.select(*kept, F.col("text").cast("string").alias(name)).mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))
