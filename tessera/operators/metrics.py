"""Ranking quality: per query and over all, for any set of cut-offs.

``hits``: ``query_id, id, rank`` from 1; ``truth``: ``query_id, id``. Queries with truth and no hit count with 0;
hits of queries without truth are not counted; a repeated truth or hit counts once, a hit where it came first.

Truth may be a label that query and document share. It is then not written out, since it has as many rows as the queries
times their labels' documents: labels are counted, and only hits are looked up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(hits: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """A row a query: reciprocal rank, average precision, R-precision and, for each k, hit, precision, recall, F1, NDCG."""
    wanted = truth.select("query_id", "id").distinct()
    size = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    return _measured(size, _first(hits).join(wanted, ["query_id", "id"], "left_semi"), ks)


def per_query_by_label(hits: DataFrame, queries: DataFrame, docs: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """``per_query`` where ``docs``, ``id, label``, of the labels of a query, ``query_id, label``, are its truth."""
    # a query has one label as a rule; of several, documents count once
    asked = queries.where("label IS NOT NULL").groupBy("query_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    known = docs.where("label IS NOT NULL").select("id", "label").distinct()
    sets = asked.select("labels").distinct().select("labels", F.explode("labels").alias("label"))
    one = sets.where(F.size("labels") == 1).join(known.groupBy("label").agg(F.count("*").alias("n")), "label").select("labels", "n")
    several = sets.where(F.size("labels") > 1).join(known, "label").groupBy("labels").agg(F.count_distinct("id").alias("n"))
    size = asked.join(one.unionByName(several), "labels").select("query_id", "n")
    labelled = _first(hits).join(known, "id").join(asked, "query_id")
    return _measured(size, labelled.where(F.array_contains("labels", F.col("label"))).select("query_id", "id", "rank").distinct(), ks)


def _first(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))


def _measured(size: DataFrame, found: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``size``: ``query_id, n``, how many are right; ``found``: ``query_id, id, rank`` of the right hits."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    met = size.join(found.withColumn("nth", nth), "query_id", "left")
    rank = F.col("rank")
    sums = {"first": F.min("rank"), "precisions": F.sum(F.col("nth") / rank), "at_n": F.sum((rank <= F.col("n")).cast("int"))}
    for k in ks:
        sums[f"hits_{k}"] = F.sum((rank <= k).cast("int"))
        sums[f"gain_{k}"] = F.sum(F.when(rank <= k, 1 / F.log2(rank + 1)))
    out = met.groupBy("query_id", "n").agg(*(F.coalesce(v, F.lit(0)).alias(name) for name, v in sums.items()))
    n = F.col("n")
    columns = {"reciprocal_rank": F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0), "average_precision": F.col("precisions") / n, "r_precision": F.col("at_n") / n}
    for k in ks:
        p, r = F.col(f"hits_{k}") / k, F.col(f"hits_{k}") / n
        ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), n)), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        columns |= {f"hit_{k}": (F.col(f"hits_{k}") > 0).cast("double"), f"precision_{k}": p, f"recall_{k}": r, f"f1_{k}": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), f"ndcg_{k}": F.col(f"gain_{k}") / ideal}
    return out.select("query_id", *(v.cast("double").alias(name) for name, v in columns.items()))


def report(hits: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """``metric, value`` of the means over all queries, and their number ``n``."""
    return means(per_query(hits, truth, ks))


def means(each: DataFrame) -> DataFrame:
    """``report`` of a table of ``per_query``."""
    names = [c for c in each.columns if c != "query_id"]
    label = {"reciprocal_rank": "mrr", "average_precision": "map"}
    over_all = each.agg(F.count("*").cast("double").alias("n"), *(F.avg(c).alias(label.get(c, c)) for c in names))
    return over_all.select(F.explode(F.create_map(*(x for c in over_all.columns for x in (F.lit(c), F.col(c))))).alias("metric", "value"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """``metric, old, new, delta`` of two reports; metrics of one of them have nulls."""
    a, b = old.select("metric", F.col("value").alias("old")), new.select("metric", F.col("value").alias("new"))
    return a.join(b, "metric", "full").withColumn("delta", F.col("new") - F.col("old"))


def golden_set(chunks: DataFrame, ask, per_chunk: int = 2, limit: int = 200) -> DataFrame:
    """``query_id, query, id, text``: questions that ``ask`` (a text to questions) has for ``limit`` chunks, chosen by
    the hash of their ids."""
    from collections.abc import Iterator

    import pandas as pd

    @F.pandas_udf("array<string>")
    def questions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(ask(t))[:per_chunk] for t in s], dtype=object)

    chosen = chunks.where("text <> ''").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(limit)
    rows = chosen.select(F.col("chunk_id").alias("id"), "text", F.posexplode(questions("text")).alias("i", "query"))
    return rows.select(F.concat_ws("-", "id", "i").alias("query_id"), "query", "id", "text")
