"""Context around hits: neighbours, parents, documents, records and prompt contexts.

Hits are rows ``query_id, id, score, rank``; chunks have ``chunk_id, doc_id, text, prev_id, next_id`` and may have
``parent_id``. Chunks are joined by id; only ids travel until the last join, which fetches the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import path_stem, strip

# Scores of added context, and the name of a source that has none.
PARENT_SCORE, NEIGHBOUR_SCORE, NO_SOURCE = 0.15, 0.05, "未知来源"


def expand(hits: DataFrame, chunks: DataFrame, hops: int = 1, with_parents: bool = True) -> DataFrame:
    """``query_id, id, score, rank, is_context``: the hits, then neighbours up to ``hops`` away and parents.

    Each hop is a join of the last ones found, less what is there already; chunks without text are not added.
    """
    links = chunks.select(F.col("chunk_id").alias("id"), "prev_id", "next_id", (F.col("parent_id") if "parent_id" in chunks.columns else F.lit(None).cast("string")).alias("parent_id"), (F.col("doc_node_id") if "doc_node_id" in chunks.columns else F.lit("")).alias("doc_node_id"))
    seen = hits.select("query_id", "id").distinct()
    last, added = seen, None
    near = lambda df: df.select("query_id", F.explode(F.array("prev_id", "next_id")).alias("id")).where("id <> ''").distinct()
    for _ in range(hops):
        last = near(last.join(links, "id")).join(seen, ["query_id", "id"], "left_anti")
        seen = seen.unionByName(last)
        added = last if added is None else added.unionByName(last)
    parts = [] if added is None else [added.withColumn("score", F.lit(NEIGHBOUR_SCORE))]
    if with_parents:
        up = hits.select("query_id", "id").join(links, "id").where("parent_id <> '' AND parent_id <> doc_node_id").select("query_id", F.col("parent_id").alias("id")).distinct()
        parts.append(up.join(hits, ["query_id", "id"], "left_anti").withColumn("score", F.lit(PARENT_SCORE)))
    own = hits.select("query_id", "id", "score", "rank", F.lit(False).alias("is_context"))
    if not parts:
        return own
    more = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    more = more.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    there = chunks.where(F.col("text") != "").select(F.col("chunk_id").alias("id")).distinct()
    more = more.join(there, "id", "left_semi")
    count = hits.groupBy("query_id").agg(F.max("rank").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) + F.col("n")
    return own.unionByName(more.join(count, "query_id").select("query_id", "id", "score", place.alias("rank"), F.lit(True).alias("is_context")))


def cut(hits: DataFrame, top: int, threshold: float = 0.0, text: str = "text") -> DataFrame:
    """The first ``top`` hits with content, and with a score of at least ``threshold`` where that is above 0."""
    kept = hits.where(strip(F.col(text)) != "")
    kept = kept.where(F.coalesce("score", F.lit(0.0)) >= threshold) if threshold > 0 else kept
    ranked = kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    return ranked.where(F.col("place") <= top).drop("rank").withColumnRenamed("place", "rank")


def records(hits: DataFrame) -> DataFrame:
    """``query_id, rank, content, score, title, metadata`` of hits with ``text`` and metadata columns."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit("")
    path = of("source_path")
    kind = of("source_type")
    title = F.when(path != "", path_stem(path)).otherwise(F.when(kind != "", kind).otherwise(NO_SOURCE))
    return hits.select(
        "query_id", "rank", strip(F.col("text")).alias("content"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), title.alias("title"),
        F.struct(path.alias("source_path"), kind.alias("source_type"), of("vendor").alias("vendor"), of("eda").alias("eda")).alias("metadata"),
    )


def by_document(hits: DataFrame, most: int = 5) -> DataFrame:
    """``query_id, doc, n_chunks, chunks``: the hits of each document in their order there, ``most`` at most shown."""
    key = F.coalesce(*(F.col(c) for c in ("doc_node_id", "source_path") if c in hits.columns), F.lit("unknown"))
    by = Window.partitionBy("query_id", "doc")
    placed = hits.withColumn("doc", key).withColumns({"_n": F.row_number().over(by.orderBy("chunk_idx", "rank")), "n_chunks": F.count("*").over(by)})
    first = placed.where(F.col("_n") <= most)
    return first.groupBy("query_id", "doc", "n_chunks").agg(F.array_sort(F.collect_list(F.struct("_n", "chunk_idx", "text", "is_context"))).alias("chunks"), F.min("rank").alias("first_rank"))  # ``most`` rows


def grouped_text(groups: DataFrame, title: Column) -> DataFrame:
    """One text a query: each document's title, its chunks with their places, and how many more there are."""
    part = F.transform("chunks", lambda c: F.concat(F.lit("[段落 "), (c["chunk_idx"] + 1).cast("string"), F.lit("]\n"), F.when(c["is_context"], "（上下文）").otherwise(""), c["text"], F.lit("\n")))
    more = F.col("n_chunks") - F.size("chunks")
    body = F.concat(F.lit("【文档："), title, F.lit("】\n"), F.array_join(part, "\n"), F.when(more > 0, F.concat(F.lit("\n... (还有 "), more.cast("string"), F.lit(" 个相关段落)"))).otherwise(""), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("first_rank", body.alias("body"))))
    return groups.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["body"]), "\n").alias("context"))  # the top hits of one query


def context(hits: DataFrame, most: int = 5, chars: int = 1000) -> DataFrame:
    """``query_id, context, sources, doc_count, total_chars``: the first hits as numbered, cut texts.

    ``hits``: ``query_id, id, rank, score, text, source_path``.
    """
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("n") <= most)
    path = F.coalesce("source_path", F.lit(NO_SOURCE))
    name = F.when(path.isin("", NO_SOURCE), path).otherwise(path_stem(path))
    text = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text"))
    own = first.select("query_id", F.struct(F.col("n").alias("index"), path.alias("source_path"), name.alias("source_name"), "score", F.length(text).alias("char_count"), text.alias("text")).alias("d"))
    docs = own.groupBy("query_id").agg(F.array_sort(F.collect_list("d"), lambda a, b: a["index"] - b["index"]).alias("docs"))  # ``most`` rows
    body = F.transform("docs", lambda d: F.concat(F.lit("[文档"), d["index"].cast("string"), F.lit(": "), d["source_name"], F.lit("]\n"), d["text"]))
    return docs.select(
        "query_id", F.array_join(body, "\n\n---\n\n").alias("context"), F.transform("docs", lambda d: d.dropFields("text")).alias("sources"),
        F.size("docs").alias("doc_count"), F.aggregate("docs", F.lit(0), lambda s, d: s + d["char_count"]).alias("total_chars"),
    )
