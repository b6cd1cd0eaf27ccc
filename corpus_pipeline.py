"""A training corpus from ``documents``: language ID, line dedup, near-dedup, source mixing and packing in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is stored and read again as the next stage's
``docs``. All but the last return the columns of ``documents``, so whatever a stage decides shows in its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, lines, mixing, packing, sketches
from tessera.llm.common import WORD, held_out, keep
from tessera.llm.queries import vocabulary

#: Documents of which no language makes up at least this part are rejected, as those without a letter are.
LEAST_PART = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a main language."""
    model = langid.learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    seen = langid.predict(docs, model)
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_PART)).select(*docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates from all documents but the first that has them, and the documents that
    have no word left then."""
    out = lines.drop_recurring_lines(docs).where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(WORD)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies."""
    return sketches.drop_near_duplicates(docs, num=80, den=100)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of the sources has it."""
    return mixing.apply_mix(docs, weights=(5, 2, 1), total=1.5, most=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", own_lines),
    ("near_dedup", first_of_copies),
    ("source_mixing", mixed_sources),
    ("packing", packed),
]

#: None: expectation-maximisation, sketches, the cube method and tokenisation have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
