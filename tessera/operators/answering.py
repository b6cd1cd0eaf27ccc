"""Answers with sources: prompts, citations, formatting, and the generator's own rating.

Answers are rows ``query_id, query, answer`` joined with the hits they rest on; citations are found by expressions.
Generators are functions from a prompt to a text, made once per worker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.metadata import ENTITIES, JAVA
from tessera.functions.text import path_stem
from tessera.operators.context import NO_SOURCE, context
from tessera.operators.understanding import generated

# What is said without documents, the heading and marks of the list of sources, how confidences rank.
NO_ANSWER, SOURCES_HEAD, MARKS, RANKS = "根据提供的文档无法回答该问题，未找到相关文档。", "\n\n📚 参考来源：", {"high": "✓", "medium": "○"}, ("high", "medium", "low")


def standards_in(answer: Column) -> Column:
    """Numbers of standards named in an answer, in capitals without spaces, in order of their kinds."""
    each = [F.regexp_extract_all(answer, F.lit("(?i)" + JAVA + p), F.lit(0)) for k, p in ENTITIES.items() if k.startswith("standard_")]
    return F.array_distinct(F.transform(F.concat(*each), lambda m: F.replace(F.upper(m), F.lit(" "), F.lit(""))))


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, citations``: a struct for each hit, by confidence and score.

    ``high``: a standard named in the answer and the source's name hold one another; ``medium``: the answer has a word
    of the name; else ``low``. ``answers``: ``query_id, answer``; ``hits``: ``query_id, source_path, score, rank``.
    """
    plain = lambda s: F.regexp_replace(F.upper(s), "[/ -]", "")
    rows = hits.join(answers.select("query_id", "answer", standards_in(F.col("answer")).alias("_named")), "query_id")
    path = F.coalesce("source_path", F.lit(""))
    name = F.when(path == "", NO_SOURCE).otherwise(path_stem(path))
    # a mark without a number names no standard
    held = F.filter("_named", lambda s: plain(name).contains(plain(s)) | plain(s).contains(plain(name)))
    words = F.filter(F.regexp_extract_all(name, F.lit(r"[一-鿿]{2,}|[A-Za-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & F.lower("answer").contains(F.lower(w)))
    high, medium = F.size(held) > 0, F.size(words) > 0
    one = F.struct(
        F.when(high, 0).when(medium, 1).otherwise(2).alias("_c"), (-F.coalesce("score", F.lit(0.0))).alias("_s"), F.col("rank").alias("_r"),
        F.when(path == "", name).otherwise(path).alias("source"), name.alias("source_name"),
        F.when(high, F.get(held, F.lit(0))).when(medium, F.get(words, F.lit(0))).otherwise("").alias("matched_text"),
        F.when(high, "high").when(medium, "medium").otherwise("low").alias("confidence"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: c.dropFields("_c", "_s", "_r")).alias("citations"))  # the hits of one query


def formatted(answer: Column, cited: Column, most: int = 5) -> Column:
    """The answer with a numbered list of the sources it names."""
    named = F.slice(F.filter(cited, lambda c: c["confidence"].isin("high", "medium")), 1, most)
    line = lambda c, i: F.concat(F.lit("  "), F.when(c["confidence"] == "high", MARKS["high"]).otherwise(MARKS["medium"]), F.lit(" ["), (i + 1).cast("string"), F.lit("] "), c["source_name"])
    return F.when(F.coalesce(F.size(named), F.lit(0)) > 0, F.concat_ws("\n", answer, F.lit(SOURCES_HEAD), F.array_join(F.transform(named, line), "\n"))).otherwise(answer)


def prompt(query: Column, context_text: Column, history: Column | None = None) -> Column:
    said = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("\n\n对话历史：\n"), history)).otherwise("") if history is not None else F.lit("")
    rules = "只根据参考文档回答；文档中没有的内容请明确说明无法回答；回答末尾注明来源。"
    return F.concat(F.lit(rules), said, F.lit("\n\n参考文档：\n"), context_text, F.lit("\n\n问题："), query, F.lit("\n\n回答："))


def answer(queries: DataFrame, hits: DataFrame, load=None, most: int = 5, chars: int = 1000) -> DataFrame:
    """``query_id, query, answer, citations, sources, doc_count, total_chars`` for each query (``query_id, query`` and
    perhaps ``history``). Without a generator the first document's text is the answer; without hits it says so."""
    found = queries.join(context(hits, most, chars), "query_id", "left")
    past = F.col("history") if "history" in queries.columns else None
    first = hits.groupBy("query_id").agg(F.min_by("text", "rank").alias("_first"))
    found = found.join(first, "query_id", "left")
    body = F.coalesce(generated(prompt(F.col("query"), F.col("context"), past), load), F.lit("")) if load else F.substring("_first", 1, chars)
    done = found.withColumn("answer", F.when(F.col("context").isNull(), NO_ANSWER).otherwise(body))
    cited = citations(done.where("context IS NOT NULL").select("query_id", "answer"), hits)
    out = done.join(cited, "query_id", "left")
    return out.select("query_id", "query", "answer", "citations", F.transform("sources", lambda s: s["source_path"]).alias("sources"), F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"))


RATING = "relevance int, completeness int, accuracy int, sufficiency int, overall double, needs_more_retrieval boolean, retrieval_suggestion string, reason string"


def rating(reply: Column) -> Column:
    """The first flat JSON object of a reply, with defaults for what it lacks; all of them without one."""
    found = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{[^{}]*\}", 0), F.lit("")), RATING)
    default = {"overall": F.lit(3.0), "needs_more_retrieval": F.lit(False), "retrieval_suggestion": F.lit(""), "reason": F.lit("")}
    three = [F.when(found.isNull(), 3).otherwise(found[k]).alias(k) for k in ("relevance", "completeness", "accuracy", "sufficiency")]
    return F.struct(*three, *(F.coalesce(found[k], v).alias(k) for k, v in default.items()))


def follow_up(query: Column, rated: Column, reply: Column | None = None) -> Column:
    """What to ask next: the rating's suggestion, else the reply, else the query again."""
    said = F.trim(rated["retrieval_suggestion"])
    steps = [F.when(F.length(said) > 2, said)] + ([F.when(F.length(F.trim(reply)) > 2, F.trim(reply))] if reply is not None else [])
    return F.coalesce(*steps, query)


def rated_answer(queries: DataFrame, hits: DataFrame, load, judge=None, most: int = 5) -> DataFrame:
    """Answers with ``rating`` and ``final_score``: one round, the rating asks for no further search. Hits that repeat
    an id count once."""
    once = hits.groupBy("query_id", "id").agg(*(F.min_by(c, "rank").alias(c) for c in hits.columns if c not in ("query_id", "id", "rank")), F.min("rank").alias("rank"))
    out = answer(queries, once, load, most)
    ask = F.concat(F.lit("Rate from 1 to 5 as one JSON object with the fields "), F.lit(", ".join(x.split()[0] for x in RATING.split(", "))), F.lit(".\n问题："), F.col("query"), F.lit("\n答案："), F.col("answer"))
    out = out.withColumn("rating", rating(generated(ask, judge or load) if (judge or load) else F.lit(None).cast("string")))
    return out.withColumn("final_score", F.col("rating.overall"))


def rated_text(answer_text: Column, cited: Column, score: Column, rounds: int = 1) -> Column:
    lines = [formatted(answer_text, cited), F.lit("\n\n🔄 Self-RAG 自反思："), F.lit(f"   迭代次数: {rounds}"), F.concat(F.lit("   最终评分: "), score.cast("string"), F.lit("/5"))]
    return reduce(lambda a, b: F.concat(a, F.lit("\n"), b), lines)
