"""The queries that apply the pipeline operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, table
from tessera.llm.lines import oracle


#: A deployment passes its own secret to the operator; the query has to be reproducible.
SURROGATE_KEY = "key of the registered query"


def vocabulary(name: str) -> str:
    """Where a public tokeniser's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.digest import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op2_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), total=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import learn, predict

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).drop("text")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.surrogates import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=SURROGATE_KEY)


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tokenfile import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=1))


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import classify

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", lambda i: ~held_out(i), cut=0.3)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_matched_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2, capacity=1024)


def op8_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lines import drop_recurring_lines

    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_cover_tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.covertree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_bottom_k_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sketches import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quartile_digest, op2_cube_mixing, op3_language_mixture, op4_surrogates, op5_token_blocks, op6_quality_discriminant, op7_matched_packing, op8_template_lines, op9_cover_tree_duplicates, op10_bottom_k_duplicates)
}
ORACLES: dict[str, str] = {"op8_template_lines": oracle()}
