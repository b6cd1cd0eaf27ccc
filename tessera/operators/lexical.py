"""Lexical search: an inverted index as tables, and BM25+ over it.

``Index.build`` explodes terms once; counts are summed within tasks before the shuffle, and a task has ``PART_BYTES`` of
the table, so its terms stay in memory at every size. A search reads the query terms to the driver and filters by them,
so it counts and joins the postings of those terms only, and keeps the best ``k`` per query within tasks before they meet
(a ranked window over a limit). Frequent terms, those in more than ``MOST_DOCS`` of all documents,
are left out before the join, so no posting list of nearly the corpus's size is scored.

Cases: a null or empty text has no terms, still counts as a document and can match nothing; a query without a known
term gives no row; ties are ordered by id; repeated ids are one document of their joined terms.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokens import terms

# The parameters of BM25+.
K1, B, DELTA, MOST_DOCS, MOST_REPEATS, BOOST = 1.5, 0.75, 1.0, 0.8, 3, 1.2
#: Bytes of the stored table whose terms one task counts.
PART_BYTES = 4 << 20


def _parts(docs: DataFrame) -> int:
    """How many parts an index is made in, by Spark's estimate of the table's size."""
    least = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 46:  # not known
        return max(least, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // PART_BYTES))


@dataclass(frozen=True)
class Index:
    """``postings``: id, term, tf; ``lengths``: id, dl; ``frequencies``: term, df; ``stats``: one row, n and avgdl."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", term_column: Column | None = None, **how) -> Index:
        # dealt by id first: postings and lengths then need no shuffle of their own, and postings are larger than texts
        found = docs.withColumn("_id", F.col(doc_id)).repartition(_parts(docs), "_id").select(F.col("_id").alias("id"), (term_column if term_column is not None else terms(F.col(text), **how)).alias("terms"))
        # outer: else a filter on the array is put below, and all terms are made twice
        postings = found.select("id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL").groupBy("id", "term").agg(F.count("*").alias("tf"))
        # dealt once more, though by the same: one small exchange that the statistics and a search share
        lengths = found.groupBy("id").agg(F.sum(F.coalesce(F.size("terms"), F.lit(0)).cast("long")).alias("dl")).repartition("id")
        frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
        return cls(postings, lengths, frequencies, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))

    def save(self, path: str) -> None:
        """Writes the tables; postings in ranges of their terms, so that a search skips most of their files."""
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("lengths", "frequencies", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "frequencies", "stats")))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text", **how) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(text), **how)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, qtf: Column, boosted: Column) -> Column:
    rarity = F.log((n + 1.0) / (df + 0.5)) * F.when(boosted, BOOST).otherwise(1.0)
    average = F.when(avgdl > 0, avgdl).otherwise(1.0)
    return rarity * (tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / average)) + DELTA) * F.least(qtf, F.lit(MOST_REPEATS))


def score(index: Index, queries: DataFrame, protected: Collection[str] = (), **how) -> DataFrame:
    """``query_id, id, score`` of every document with a term of a query. ``queries``: ``query_id, text``.

    The queries' terms, the caller's stated set, are read to the driver, so that no other term is counted or joined; how
    to join the queries, Spark decides by size.
    """
    q = query_terms(queries, protected=protected, **how)
    asked = F.col("term").isin(*sorted(r.term for r in q.select("term").distinct().collect()))
    frequencies, postings = index.frequencies.where(asked), index.postings.where(asked)
    known = q.join(frequencies, "term").crossJoin(F.broadcast(index.stats)).where(F.col("df") <= MOST_DOCS * F.col("n"))  # one row
    met = postings.join(known, "term").join(index.lengths, "id")
    boosted = F.col("term").isin(*protected) if protected else F.lit(False)
    each = term_score(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("qtf"), boosted)
    return met.groupBy("query_id", "id").agg(F.round(F.sum(each), 9).alias("score")).where("score > 0")


def best(scored: DataFrame, k: int, by: str = "query_id", score_column: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` best rows of each query, with ``rank`` from 1."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score_column), F.asc(tie))))
    return ranked.where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, allowed: DataFrame | None = None, **how) -> DataFrame:
    """``query_id, id, score, rank``. ``allowed``: the ids that a metadata filter lets pass; it does not change the
    statistics."""
    scored = score(index, queries, **how)
    return best(scored if allowed is None else scored.join(allowed.select("id"), "id", "left_semi"), k)


def search_texts(docs: DataFrame, queries: DataFrame, k: int = 20, allowed: Column | None = None, doc_id: str = "doc_id", text: str = "text", protected: Collection[str] = (), **how) -> DataFrame:
    """``search`` without an index: texts are read once, and only what they have of the queries' terms is shuffled.

    A row with its length and those terms goes to its id, where rows of one id are one document, as in an index. The
    statistics and the scores are made of the same exchange. ``allowed`` filters what is returned (an id if one of its
    rows is allowed) and leaves the statistics as they are.
    """
    asked = query_terms(queries, protected=protected, **how)
    wanted = sorted(r.term for r in asked.select("term").distinct().collect())  # the stated queries' terms
    found = docs.select(F.col(doc_id).alias("id"), *([] if allowed is None else [allowed.alias("ok")]), terms(F.col(text), protected=protected, **how).alias("t"))
    none = F.array().cast("array<string>")
    rows = found.select("id", *([] if allowed is None else ["ok"]), F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("dl"), F.coalesce(F.filter("t", lambda x: x.isin(*wanted)) if wanted else none, none).alias("hits"))
    ok = [] if allowed is None else [F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok")]
    rows = rows.groupBy("id").agg(*ok, F.sum("dl").alias("dl"), F.flatten(F.collect_list("hits")).alias("hits"))  # rows of one id
    # the filter, of which all is true, keeps the column, so that both uses have one exchange
    all_rows = rows if allowed is None else rows.where(F.col("ok") | ~F.col("ok"))
    counts = all_rows.select("dl", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct("hits"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))
    total = counts.where("term = ''").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    known = asked.join(counts.select("term", "df"), "term").crossJoin(F.broadcast(total)).where(F.col("df") <= MOST_DOCS * F.col("n"))  # a row a query's term
    tf = (F.size("hits") - F.size(F.array_remove(F.col("hits"), F.col("term")))).cast("double")
    met = (rows if allowed is None else rows.where("ok")).select("id", "dl", "hits", F.explode(F.array_distinct("hits")).alias("term")).select("id", "dl", "term", tf.alias("tf")).join(F.broadcast(known), "term")
    boosted = F.col("term").isin(*protected) if protected else F.lit(False)
    each = term_score(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("qtf"), boosted)
    return best(met.groupBy("query_id", "id").agg(F.round(F.sum(each), 9).alias("score")).where("score > 0"), k)
