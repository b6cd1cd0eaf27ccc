"""The engine: documents in, answers out. All methods take and return DataFrames, so many queries are one plan.

``Engine.ingest`` makes the tables (chunks, vectors, lexical index) and stores them; ``retrieve``, ``ask`` and
``chat`` read them. Models are parameters; without any, hashed vectors, rules and extracts take their place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import folds
from tessera.functions.embedding import embedded, hashed
from tessera.functions.metadata import chunk_metadata, path_metadata
from tessera.functions.vocabulary import protected_terms
from tessera.operators import answering, chunking, context, fusion, understanding, vector
from tessera.operators.lexical import Index, best, score
from tessera.plans.config import DEFAULT, Settings
from tessera.sources.store import Store

FILTERS = ("vendor", "eda", "layer_count", "copper_oz", "source_type", "effective_date")
#: Records of one request at most.
MOST_RECORDS = 20


def splitter(s: Settings, embed: Callable = hashed) -> tuple[chunking.Splitter, str]:
    """The splitter that the settings name, and the mark of its ids."""
    meaning = chunking.Meaning(embed, s.meaning_max, s.meaning_min, s.meaning_threshold, s.meaning_percentile, s.meaning_overlap, s.meaning_window)
    child = {"most": s.child_max, "least": s.child_min, "overlap": s.child_overlap}
    parent = {"most": s.parent_max, "least": s.parent_min, "least_section": s.parent_min_section, "keep_short": s.keep_short}
    kinds: dict[str, tuple[chunking.Splitter, str]] = {
        "structure": (lambda t: chunking.split_structure(t, s.structure_max, s.structure_min, s.structure_overlap, s.keep_short), "-"),
        "parent_child": (lambda t: chunking.split_children(t, meaning, **child, parent=parent), "-pc-"),
        "attention": (meaning, "-sem-"),
        "semantic": (lambda t: chunking.split_by_distance(t, embed), "-sd-"),
        "hierarchical": (lambda t: chunking.split_levels(t, s.level_sizes), "-h-"),
        "sentence": (lambda t: chunking.split_tokens(t, s.sentence_size, s.sentence_overlap), "-s-"),
    }
    return kinds[s.chunking]


def prepare(docs: DataFrame, s: Settings = DEFAULT, embed: Callable = hashed) -> DataFrame:
    """Chunks of ``docs`` (``doc_id, text, source_path``): cleaned, split, limited, linked, with metadata."""
    ready = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source_path", folds.normalised(F.col("text"), s.clean, s.flatten, s.anchor).alias("text"))
    split, mark = splitter(s, embed)
    made = chunking.limit_bytes(chunking.chunk(ready, split, mark))
    linked = (chunking.link_sections if s.chunking == "attention" else lambda c: c)(chunking.link(made))
    of = ready.select(F.col("doc_id").alias("_d"), path_metadata(F.col("source_path")).alias("p"), F.substring("text", 1, 5000).alias("_head"))
    rows = linked.join(of, F.col("doc_id") == F.col("_d"))
    told = chunk_metadata(F.col("text"), F.col("_head"), F.col("p.source_path"))
    rows = rows.withColumn("m", told.dropFields("section")).select("*", "p.*", "m.*").drop("_d", "p", "m", "_head")
    return rows


@dataclass
class Engine:
    """Stored tables and the ways to ask them."""

    spark: SparkSession
    folder: str
    settings: Settings = DEFAULT
    embed: Callable | None = None
    generate: Callable | None = None
    rerank: Callable[[DataFrame], DataFrame] | None = None

    def ingest(self, docs: DataFrame, upsert: bool = False) -> None:
        chunks = prepare(docs, self.settings, self.embed() if self.embed else hashed)
        chunks = chunks.withColumn("embedding", embedded(F.col("text"), self.embed))
        store = Store(self.spark, f"{self.folder}/chunks")
        (store.upsert if upsert else store.overwrite)(chunks)
        # after each change, so that the index is never older than the chunks
        Index.build(self.chunks(), "chunk_id", protected=protected_terms()).save(f"{self.folder}/index")

    def chunks(self) -> DataFrame:
        return Store(self.spark, f"{self.folder}/chunks").scan()

    def index(self) -> Index:
        return Index.load(self.spark, f"{self.folder}/index")

    def health(self) -> DataFrame:
        """``component, ready``."""
        there = lambda name: F.lit(Store(self.spark, self.folder)._exists(name))
        parts = {"chunks": there("chunks"), "index": there("index"), "generator": F.lit(self.generate is not None), "reranker": F.lit(self.rerank is not None)}
        return self.spark.range(1).select(F.explode(F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v)))).alias("component", "ready"))

    def _understood(self, queries: DataFrame) -> DataFrame:
        q = F.col("query")
        asked = queries.select("query_id", q, understanding.filters(q).alias("f"), understanding.without_filters(q).alias("plain"))
        kind = understanding.classify(q) if self.settings.routing else F.lit("general")
        asked = asked.withColumn("class", kind).withColumn("strategy", understanding.strategy(F.col("class")))
        asked = asked.withColumn("expanded", understanding.with_synonyms(F.col("plain"), self.settings.synonyms))
        n = self.settings.queries
        found = understanding.variants(F.col("expanded"), n) if self.settings.multi_expand else F.array("expanded")
        return asked.withColumn("variants", found)

    def search(self, queries: DataFrame) -> DataFrame:
        """``query_id, id, score, rank`` of each query's best chunks over all routes."""
        s, top = self.settings, self.settings.recall
        # the stated queries, worked out once: each route would plan and run their rules again
        rules = self._understood(queries)
        asked = self.spark.createDataFrame(rules.collect(), rules.schema)
        wanted = asked.select("query_id", "f", "expanded", F.posexplode("variants").alias("variant", "text"))
        wanted = wanted.select(F.concat_ws("#", "query_id", "variant").alias("key"), "text", *(F.col(f"f.{k}").alias(k) for k in FILTERS))
        chunks = self.chunks()
        near = lambda rows, key: vector.search(chunks.select("chunk_id", "embedding", *FILTERS), rows.withColumn("embedding", embedded(F.col("text"), self.embed)), top, "chunk_id", "embedding", key, FILTERS)
        routes = [self._variants(near(wanted, "key")), self._variants(self._words(wanted, chunks))]
        if s.hyde and self.generate is not None:
            said = understanding.generated(F.concat(F.lit("写一段可能回答下面问题的技术资料。\n问题："), F.col("expanded"), F.lit("\n输出：")), self.generate)
            text = understanding.hypothetical(F.col("expanded"), said, s.hyde_chars)
            hyde = asked.select("query_id", text.alias("text"), "expanded", *(F.col(f"f.{k}").alias(k) for k in FILTERS)).where("text <> expanded")
            routes.insert(1, near(hyde, "query_id"))
        return best(self._weighed(routes, asked).withColumn("score", F.round("score", 12)), top)

    def _words(self, wanted: DataFrame, chunks: DataFrame) -> DataFrame:
        """Lexical hits; filters apply before the best are taken, and leave the statistics as they are."""
        scored = score(self.index(), wanted.select(F.col("key").alias("query_id"), "text"), protected=protected_terms())
        asked = wanted.select(F.col("key").alias("query_id"), *(F.col(k).alias(f"_{k}") for k in FILTERS))
        met = scored.join(chunks.select(F.col("chunk_id").alias("id"), *FILTERS), "id").join(asked, "query_id")
        for k in FILTERS:
            met = met.where(F.col(f"_{k}").isNull() | F.col(k).eqNullSafe(F.col(f"_{k}")))
        return best(met.select("query_id", "id", "score"), self.settings.recall)

    def _variants(self, hits: DataFrame) -> DataFrame:
        key = F.split("query_id", "#(?=[0-9]+$)")
        return fusion.first_of_variants(hits.select(key[0].alias("query_id"), key[1].cast("int").alias("variant"), "rank", "id"), 2 * self.settings.recall)

    def _weighed(self, routes: list[DataFrame], asked: DataFrame) -> DataFrame:
        """RRF with the weights that each query's class asks for."""
        weight = {0: F.col("strategy.vector_weight"), len(routes) - 1: F.col("strategy.bm25_weight")}
        parts = [r.select("query_id", "id", "rank", F.lit(i).alias("route")) for i, r in enumerate(routes)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.join(asked.select("query_id", "strategy"), "query_id")
        w = F.when(F.col("route") == 0, weight[0]).when(F.col("route") == len(routes) - 1, weight[len(routes) - 1]).otherwise(F.col("strategy.vector_weight") * self.settings.hyde_weight)
        return rows.groupBy("query_id", "id").agg(F.sum(w / (self.settings.rrf_k + F.col("rank"))).alias("score"))

    def hits(self, queries: DataFrame, top: int = 5, threshold: float = 0.0) -> DataFrame:
        """The best chunks with their text and metadata: searched, reranked, with their context, cut."""
        s, chunks = self.settings, self.chunks()
        found = self.search(queries)
        told = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "doc_node_id", "chunk_idx", "text", "source_path", *(c for c in FILTERS))
        if s.rerank and self.rerank is not None:
            found = self.rerank(found.join(told.select("id", "text"), "id").join(queries.select("query_id", "query"), "query_id")).select("query_id", "id", "score", "rank")
        if s.neighbours or s.with_parents:
            found = context.expand(found, chunks, s.neighbours, s.with_parents)
        return context.cut(found.join(told, "id"), min(max(1, top), MOST_RECORDS), threshold)

    def retrieve(self, queries: DataFrame, top: int = 5, threshold: float = 0.0) -> DataFrame:
        """Records of each query (``query_id, query``); blank queries have none."""
        return context.records(self.hits(queries.where(F.trim("query") != ""), top, threshold))

    def ask(self, queries: DataFrame, top: int = 5, threshold: float = 0.0, rated: bool = False) -> DataFrame:
        asked = queries.where(F.trim("query") != "")
        found = self.hits(asked, top, threshold)
        if rated:
            return answering.rated_answer(asked, found, self.generate, most=self.settings.answer_docs)
        return answering.answer(asked, found, self.generate, self.settings.answer_docs, self.settings.answer_chars)

    def chat(self, messages: DataFrame, top: int = 5) -> DataFrame:
        """Answers to the last message of each conversation (``conv_id, turn, role, text``), read with those before."""
        past = understanding.history(messages, self.settings.history)
        last = past.groupBy("conv_id").agg(F.max_by(F.struct("text", "history", "turn"), "turn").alias("m")).select(F.col("conv_id").cast("string").alias("query_id"), F.col("m.text").alias("query"), F.col("m.history").alias("history"))
        if self.generate is not None:
            said = understanding.generated(F.concat(F.lit("把最新问题改写为独立完整的查询。\n对话历史：\n"), "history", F.lit("\n最新问题："), "query"), self.generate)
            refer = understanding.needs_history(F.col("query"), F.length("history"))
            last = last.withColumn("query", F.when(refer, understanding.accept_rewrite(F.col("query"), said)).otherwise(F.col("query")))
        asked = last.where(F.trim("query") != "")
        return answering.answer(asked, self.hits(asked.select("query_id", "query"), top), self.generate, self.settings.answer_docs, self.settings.answer_chars)
