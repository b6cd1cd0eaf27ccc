"""Rank fusion: routes of hits to one list.

A route is rows ``query_id, id, rank`` (and ``score``). Every step is a grouping by query and id, so queries fuse at
once and independently. Ties go to the hit that came first: by the routes' order, then rank, then id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_variants(hits: DataFrame, most: int) -> DataFrame:
    """``query_id, id, rank``: hits of several variants in a row, each id once, where it came first."""
    seen = hits.groupBy("query_id", "id").agg(F.min(F.struct("variant", "rank")).alias("at"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")))
    return ranked.where(F.col("rank") <= most).select("query_id", "id", "rank")


def _together(routes: Sequence[tuple[DataFrame, float]]) -> DataFrame | None:
    used = [(i, df, float(w)) for i, (df, w) in enumerate(routes) if w > 0]
    parts = [df.select("query_id", "id", "rank").withColumns({"route": F.lit(i), "weight": F.lit(w)}) for i, df, w in used]
    return reduce(DataFrame.unionByName, parts) if parts else None


def weighted_rrf(routes: Sequence[tuple[DataFrame, float]], top: int, k: float | Column = 60) -> DataFrame:
    """``query_id, id, score, rank``: the sum of ``weight / (k + rank)`` over the routes; routes without weight are out."""
    rows = _together(routes)
    if rows is None:
        return routes[0][0].select("query_id", "id", F.lit(0.0).alias("score"), "rank").limit(0)
    summed = rows.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank")) if not isinstance(k, Column) else F.col("weight") / (k + F.col("rank"))).alias("score"), F.min(F.struct("route", "rank")).alias("at"))
    return _top(summed, top)


def _top(scored: DataFrame, top: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "at", "id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "id", "score", "rank")


def rrf(dense: DataFrame, sparse: DataFrame, top: int = 50, k: int = 60) -> DataFrame:
    return weighted_rrf([(dense, 1.0), (sparse, 1.0)], top, k)


def rrf_or_dense(dense: DataFrame, sparse: DataFrame, top: int = 50, k: int = 60) -> DataFrame:
    """RRF, but the dense hits with their own scores for the queries that have no sparse hit."""
    found = sparse.select("query_id").distinct()
    alone = dense.join(found, "query_id", "left_anti").where(F.col("rank") <= top).select("query_id", "id", "score", "rank")
    return rrf(dense.join(found, "query_id", "left_semi"), sparse, top, k).unionByName(alone)


def rrf_with_overlap(dense: DataFrame, sparse: DataFrame, top: int, weights: tuple[float, float] = (0.5, 0.5), k: int = 60) -> DataFrame:
    """Weighted RRF in which ids of both routes gain ``0.1 / (1 + sqrt(rank * rank) / 20)``; ``k`` grows to half the
    shorter route's length."""
    sizes = [r.groupBy("query_id").agg(F.count("*").alias(f"n{i}")) for i, r in enumerate((dense, sparse))]
    k_of = sizes[0].join(sizes[1], "query_id", "full").select("query_id", F.greatest(F.lit(k), F.floor(F.least(F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))) / 2)).alias("k"))
    d, s = (r.select("query_id", "id", F.col("rank").alias(n)) for r, n in ((dense, "a"), (sparse, "b")))
    met = d.join(s, ["query_id", "id"], "full").join(k_of, "query_id")
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.col("k") + F.col(rank)), F.lit(0.0))
    boost = F.coalesce(F.lit(0.1) / (1 + F.sqrt(F.col("a") * F.col("b")) / 20), F.lit(0.0))
    at = F.struct(F.when(F.col("a").isNotNull(), 0).otherwise(1).alias("route"), F.coalesce("a", "b").alias("rank"))
    return _top(met.select("query_id", "id", (part("a", weights[0]) + part("b", weights[1]) + boost).alias("score"), at.alias("at")), top)


def normalised(hits: DataFrame, how: str = "minmax") -> DataFrame:
    """Scores of each query brought to 0..1: by their range (1 where all are equal) or by rank."""
    by = Window.partitionBy("query_id")
    if how == "rank":
        return hits.withColumn("score", 1 - (F.col("rank") - 1) / F.count("*").over(by))
    low, high = F.min("score").over(by), F.max("score").over(by)
    return hits.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def score_fusion(routes: Sequence[tuple[DataFrame, float]], top: int, how: str = "minmax") -> DataFrame:
    """The weighted sum of normalised scores."""
    parts = [normalised(df, how).select("query_id", "id", (F.col("score") * w).alias("score"), F.struct(F.lit(i).alias("route"), "rank").alias("at")) for i, (df, w) in enumerate(routes) if w > 0]
    rows = reduce(DataFrame.unionByName, parts)
    return _top(rows.groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.min("at").alias("at")), top)


def union_of(routes: Sequence[DataFrame], top: int) -> DataFrame:
    """All ids of the routes, each once, by its best rank."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "id", "rank", F.lit(i).alias("route")) for i, r in enumerate(routes)])
    best = rows.groupBy("query_id", "id").agg(F.min(F.struct("rank", "route")).alias("at"))
    return _top(best.select("query_id", "id", (1.0 / F.col("at.rank")).alias("score"), "at"), top)


def retrieve(mode: str, routes: Mapping[str, DataFrame], top: int, weights: tuple[float, float] = (0.45, 0.55), k: int = 60, rerank=None) -> DataFrame:
    """One of the retrieval modes over the routes ``vector`` and ``bm25`` (and ``*_expanded`` with variants' hits)."""
    v, b = routes.get("vector"), routes.get("bm25")
    v_all, b_all = routes.get("vector_expanded", v), routes.get("bm25_expanded", b)
    plans = {
        "vector": lambda: v.where(F.col("rank") <= top).select("query_id", "id", "score", "rank"),
        "bm25": lambda: b.where(F.col("rank") <= top).select("query_id", "id", "score", "rank"),
        "fusion": lambda: weighted_rrf([(v, weights[0]), (b, weights[1])], top, k),
        "fusion_rerank": lambda: rerank(weighted_rrf([(v, weights[0]), (b, weights[1])], top, k)),
        "fusion_expand": lambda: weighted_rrf([(v_all, weights[0]), (b_all, weights[1])], top, k),
        "fusion_score": lambda: score_fusion([(v, weights[0]), (b, weights[1])], top),
        "union": lambda: union_of([v, b], top),
        "rrf": lambda: rrf(v, b, top, k),
        "union_rrf": lambda: weighted_rrf([(v_all, 1.0), (b_all, 1.0)], top, k),
    }
    if mode not in plans:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(plans)}")
    return plans[mode]()
