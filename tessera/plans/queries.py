"""The registered queries over the given tables, and the same in SQL for the correctness check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import metadata, text, tokens, vocabulary
from tessera.operators import answering, chunking, context, fusion, lexical, metrics, understanding, vector
from tessera.operators.filters import Condition, Conditions, predicate
from tessera.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What is searched for in ``documents``, in two wordings: the two routes of the fusion queries.
ASKED = [(1, "tion ble ther thon", "thon with from er"), (2, "und von mit der", "auf den sich"), (3, "pour une qui", "par avec le la"), (4, "re thhe re thnt re re", "heat here from this")]


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _asked(spark: SparkSession, wording: int = 1) -> DataFrame:
    return spark.createDataFrame([(r[0], r[wording]) for r in ASKED], "query_id int, text string")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# --- terms and lexical search -------------------------------------------------------------------------------------

_TERMS = rf"""
  words AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_+\-./]+'), lambda x: lower(x)), lambda x: NOT list_contains({_list(w for w in tokens.STOP_WORDS if w.isascii())}, x)) AS w FROM documents),
  terms AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS t FROM words),
  postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY ALL),
  lengths AS (SELECT doc_id, coalesce(len(t), 0) AS dl FROM terms),
  frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths)"""


def _query_terms(said: str) -> list[str]:
    words = [w for w in said.lower().split() if w not in tokens.STOP_WORDS]
    return words + [f"{a}_{b}" for a, b in zip(words, words[1:])]


def _scored(name: str, wording: int = 1, asked=ASKED) -> str:
    rows = ", ".join(f"({r[0]}, '{t}')" for r in asked for t in _query_terms(r[wording]))
    return f"""
  q_{name} AS (SELECT query_id, term, count(*) AS qtf FROM (VALUES {rows}) v(query_id, term) GROUP BY ALL),
  {name}_scored AS (SELECT query_id, p.doc_id AS id, round(sum(ln((n + 1.0) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) + 1.0) * least(qtf, 3)), 9) AS score
    FROM q_{name} JOIN frequencies USING (term) JOIN postings p USING (term) JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN stats WHERE df <= 0.8 * n GROUP BY query_id, p.doc_id),
  {name} AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM {name}_scored)"""


@query(f"WITH {_TERMS} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term")
def token_df(spark: SparkSession, sf: str) -> DataFrame:
    postings = lexical.Index.build(_t(spark, sf, "documents")).postings
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_TERMS} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM postings WHERE contains(term, '_')")
def ascii_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    postings = lexical.Index.build(_t(spark, sf, "documents")).postings
    return postings.where(F.col("term").contains("_")).withColumnRenamed("id", "doc_id")


@query(f"WITH {_TERMS} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, CAST(min(dl) AS BIGINT) AS shortest, CAST(max(dl) AS BIGINT) AS longest FROM stats, lengths GROUP BY n, avgdl")
def doc_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    lengths = lexical.Index.build(_t(spark, sf, "documents")).lengths
    return lengths.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.min("dl").alias("shortest"), F.max("dl").alias("longest"))


@query(rf"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_+\-./]+'), lambda x: list_contains({_list(w for w in tokens.STOP_WORDS if w.isascii())}, x))) AS INTEGER) AS dropped FROM documents""")
def stop_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    plain = lambda stop: tokens.terms(F.col("text"), stop, bigrams=False)
    return docs.select("doc_id", (F.size(plain(())) - F.size(plain(tokens.STOP_WORDS))).alias("dropped"))


def _round(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_OUT = "query_id, id, round(score, 6) AS score, rank"


@query(f"WITH {_TERMS}, {_scored('a')} SELECT {_OUT} FROM a WHERE rank <= 10 AND query_id = 1")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _round(lexical.search_texts(_t(spark, sf, "documents"), _asked(spark).where("query_id = 1"), 10))


@query(f"WITH {_TERMS}, {_scored('a')} SELECT {_OUT} FROM a WHERE rank <= 20")
def bm25_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    return _round(lexical.search_texts(_t(spark, sf, "documents"), _asked(spark), 20))


@query(ORACLES["bm25_multi_query"])
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    return _round(lexical.search(lexical.Index.build(_t(spark, sf, "documents")), _asked(spark), 20))


@query(f"""WITH {_TERMS}, {_scored('a')}, ok AS (SELECT a.query_id, a.id, a.score, CAST(row_number() OVER (PARTITION BY a.query_id ORDER BY a.score DESC, a.id) AS INTEGER) AS rank
  FROM a JOIN documents d ON d.doc_id = a.id WHERE d.lang IN ('en', 'de') AND (d.n_chars >= 500 OR contains(d.source, 'a'))) SELECT {_OUT} FROM ok WHERE rank <= 10""")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    tree = Conditions([Condition("lang", ["en", "de"], "in"), Conditions([Condition("n_chars", 500, ">="), Condition("source", "a", "contains")], any_of=True)])
    return _round(lexical.search_texts(docs, _asked(spark), 10, predicate(docs, tree)))


@query("""SELECT 'eq' AS condition, CAST(count(*) AS BIGINT) AS rows FROM documents WHERE lang = 'en' UNION ALL SELECT 'ne', count(*) FROM documents WHERE lang IS DISTINCT FROM 'en'
  UNION ALL SELECT 'nin', count(*) FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'fr') UNION ALL SELECT 'gt', count(*) FROM documents WHERE n_chars > 1000
  UNION ALL SELECT 'lte', count(*) FROM documents WHERE n_chars <= 1000 UNION ALL SELECT 'text_gt', 0 UNION ALL SELECT 'unknown', count(*) FROM documents UNION ALL SELECT 'or_of_none', 0""")
def filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    trees = {
        "eq": Condition("lang", "en"), "ne": Condition("lang", "en", "!="), "nin": Condition("lang", ["en", "fr"], "nin"), "gt": Condition("n_chars", "1000", ">"),
        "lte": Condition("n_chars", 1000, "<="), "text_gt": Condition("lang", "x", ">"), "unknown": Condition("lang", "en", "like"), "or_of_none": Conditions([], any_of=True),
    }
    counts = docs.agg(*(F.count_if(predicate(docs, t)).alias(k) for k, t in trees.items()))
    return counts.select(F.explode(F.create_map(*(x for k in trees for x in (F.lit(k), F.col(k))))).alias("condition", "rows"))


# --- vectors ------------------------------------------------------------------------------------------------------

_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
_NEAR = f"""near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COSINE}, 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM near)"""


def _near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    return vector.search(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k)


@query(f"WITH {_NEAR} SELECT {_OUT} FROM ranked WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_near(spark, sf, 10))


@query(f"""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COSINE}, 12) AS score FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 20 = 0),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM near) SELECT {_OUT} FROM ranked WHERE rank <= 10""")
def vector_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    return _round(vector.search(e, e.where("vec_id % 20 = 0 AND label IS NOT NULL").withColumnRenamed("vec_id", "query_id"), 10, filters=("label",)))


@query(f"""SELECT q.label AS key, q.vec_id AS id, e.vec_id AS other, round({_COSINE}, 6) AS score FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 20 = 0 AND {_COSINE} >= 0.78""")
def soft_match(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    return vector.similar_pairs(e.where("vec_id % 20 = 0"), e, 0.78, "label").withColumn("score", F.round("score", 6))


@query("""WITH grouped AS (SELECT vec_id // 10 AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
  sims AS (SELECT q.g AS query_id, d.g AS id, q.v AS qv, max(list_cosine_similarity(q.v, d.v)) AS m FROM grouped q, grouped d WHERE q.g % 20 = 0 GROUP BY q.g, d.g, q.v),
  scored AS (SELECT query_id, id, round(sum(m), 12) AS score FROM sims GROUP BY query_id, id),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored) SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
def max_sim(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings").where("embedding IS NOT NULL")
    docs = e.groupBy(F.floor(F.col("vec_id") / 10).alias("id")).agg(F.collect_list("embedding").alias("tokens"))  # ten tokens each
    return _round(vector.search_tokens(docs, docs.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10))


_ADJACENT = """adjacent AS (SELECT label, vec_id, coalesce(list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p)) + 1e-8), 1.0) AS score, count(*) OVER (PARTITION BY label) AS n
    FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings))"""


@query(f"""WITH {_ADJACENT} SELECT label, vec_id, round(score, 6) AS score, round(CASE WHEN n <= 6 THEN score ELSE avg(score) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END, 6) AS smooth FROM adjacent""")
def adjacent_similarity(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("label").orderBy("vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e = _t(spark, sf, "embeddings").withColumn("p", F.lag("embedding").over(by))
    v, p = F.col("embedding"), F.col("p")
    e = e.withColumn("score", F.coalesce(dot(v, p) / (F.sqrt(dot(v, v)) * F.sqrt(dot(p, p)) + 1e-8), F.lit(1.0)))
    n = F.count("*").over(Window.partitionBy("label"))
    smooth = F.when(n <= 6, F.col("score")).otherwise(F.avg("score").over(by.rowsBetween(-3, 3)))
    return e.select("label", "vec_id", F.round("score", 6).alias("score"), F.round(smooth, 6).alias("smooth"))


# --- fusion -------------------------------------------------------------------------------------------------------

_ROUTES = f"{_TERMS}, {_scored('a_all')}, {_scored('b_all', 2)}, a AS (SELECT * FROM a_all WHERE rank <= 50), b AS (SELECT * FROM b_all WHERE rank <= 50)"


def _routes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # both wordings in one search, so that texts are read once; ids of the second start at 1000
    both = _asked(spark).unionByName(_asked(spark, 2).withColumn("query_id", F.col("query_id") + 1000))
    found = lexical.search_texts(_t(spark, sf, "documents"), both, 50)
    return found.where("query_id < 1000"), found.where("query_id >= 1000").withColumn("query_id", F.col("query_id") - 1000)


def _fused(score: str, top: int = 20, rows: str = "a FULL JOIN b USING (query_id, id)") -> str:
    return f"""WITH {_ROUTES}, f AS (SELECT query_id, id, {score} AS score, CASE WHEN a.rank IS NULL THEN 1 ELSE 0 END AS r, coalesce(a.rank, b.rank) AS pos FROM {rows}),
  o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r, pos, id) AS INTEGER) AS rank FROM f) SELECT query_id, id, round(score, 6) AS score, rank FROM o WHERE rank <= {top}"""


@query(_fused("coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0)"))
def rrf_two_route(spark: SparkSession, sf: str) -> DataFrame:
    return _round(fusion.rrf(*_routes(spark, sf), top=20))


@query(_fused("coalesce(0.45 / (40 + a.rank), 0) + coalesce(0.55 / (40 + b.rank), 0)"))
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _routes(spark, sf)
    return _round(fusion.weighted_rrf([(a, 0.45), (b, 0.55)], 20, 40))


@query(_fused("coalesce(0.5 / (k + a.rank), 0) + coalesce(0.5 / (k + b.rank), 0) + coalesce(0.1 / (1 + sqrt(a.rank * b.rank) / 20), 0)", 20, """a FULL JOIN b USING (query_id, id) JOIN
    (SELECT query_id, greatest(10, least(coalesce(na, 0), coalesce(nb, 0)) // 2) AS k FROM (SELECT query_id, count(*) AS na FROM a GROUP BY 1) FULL JOIN (SELECT query_id, count(*) AS nb FROM b GROUP BY 1) USING (query_id)) USING (query_id)"""))
def rrf_overlap_boost(spark: SparkSession, sf: str) -> DataFrame:
    return _round(fusion.rrf_with_overlap(*_routes(spark, sf), top=20, k=10))


_SCALED = "CASE WHEN max(score) OVER (PARTITION BY query_id) > min(score) OVER (PARTITION BY query_id) THEN (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) ELSE 1.0 END"


@query(_fused("coalesce(0.35 * a.s, 0) + coalesce(0.65 * b.s, 0)", 20, f"(SELECT query_id, id, rank, {_SCALED} AS s FROM a) a FULL JOIN (SELECT query_id, id, rank, {_SCALED} AS s FROM b) b USING (query_id, id)"))
def score_fusion(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _routes(spark, sf)
    return _round(fusion.score_fusion([(a, 0.35), (b, 0.65)], 20))


@query(f"""WITH {_ROUTES}, v AS (SELECT query_id, id, min(struct_pack(variant := variant, rank := rank)) AS pos FROM (SELECT *, 0 AS variant FROM a UNION ALL SELECT *, 1 AS variant FROM b) GROUP BY query_id, id),
  o AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos.variant, pos.rank, id) AS INTEGER) AS rank FROM v) SELECT * FROM o WHERE rank <= 60""")
def variant_dedup(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _routes(spark, sf)
    return fusion.first_of_variants(a.withColumn("variant", F.lit(0)).unionByName(b.withColumn("variant", F.lit(1))), 60).withColumn("rank", F.col("rank").cast("int"))


@query(f"""WITH {_ROUTES}, u AS (SELECT query_id, id, min(rank) AS r, min_by(route, (rank, route)) AS route FROM (SELECT *, 0 AS route FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY query_id, id),
  o AS (SELECT query_id, id, 1.0 / r AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r, route, id) AS INTEGER) AS rank FROM u) SELECT query_id, id, round(score, 6) AS score, rank FROM o WHERE rank <= 30""")
def union_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _round(fusion.retrieve("union", dict(zip(("vector", "bm25"), _routes(spark, sf))), 30))


# --- ranking quality ----------------------------------------------------------------------------------------------

_METRIC = f"""WITH {_NEAR}, h AS (SELECT * FROM ranked WHERE rank <= 10), gt AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 20 = 0),
  n AS (SELECT query_id, count(*) AS n FROM gt GROUP BY 1), rel AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM h JOIN gt USING (query_id, id)),
  e AS (SELECT query_id, n, coalesce(1.0 / min(rank), 0) AS rr, coalesce(sum(nth / rank), 0) / n AS ap, count(*) FILTER (rank <= n) / n AS rp,
    max(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS hit_5, count(*) FILTER (rank <= 5) / 5 AS p_5, count(*) FILTER (rank <= 5) / n AS r_5, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS g_5 FROM n LEFT JOIN rel USING (query_id) GROUP BY query_id, n)
  SELECT query_id, round(rr, 6) AS reciprocal_rank, round(ap, 6) AS average_precision, round(rp, 6) AS r_precision, hit_5, round(p_5, 6) AS precision_5, round(r_5, 6) AS recall_5,
    round(CASE WHEN p_5 + r_5 > 0 THEN 2 * p_5 * r_5 / (p_5 + r_5) ELSE 0 END, 6) AS f1_5, round(g_5 / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_5 FROM e"""


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), "label")
    return metrics.per_query_by_label(_near(spark, sf, 10), rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, ks=(5,))


@query(_METRIC)
def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    each = _quality(spark, sf)
    return each.select("query_id", *(F.round(c, 6).alias(c) for c in each.columns if c != "query_id"))


@query(f"""WITH e AS ({_METRIC}) SELECT unnest(['n', 'mrr', 'map', 'hit_5', 'ndcg_5']) AS metric, unnest([CAST(count(*) AS DOUBLE), round(avg(reciprocal_rank), 4), round(avg(average_precision), 4), round(avg(hit_5), 4), round(avg(ndcg_5), 4)]) AS value FROM e""")
def ir_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.means(_quality(spark, sf)).where(F.col("metric").isin("n", "mrr", "map", "hit_5", "ndcg_5"))
    return rows.select("metric", F.round("value", 4).alias("value"))


# --- text quality -------------------------------------------------------------------------------------------------

_S, _V = text.SPACE, text.VALID
_RATIOS = rf"""SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[{_V}{_S}]+', '', 'g')) AS bad, length(regexp_replace(text, '[{_S}]+', '', 'g')) AS visible,
  length(text) - length(regexp_replace(text, '[{text.CHINESE}]+', '', 'g')) AS zh, length(text) - length(replace(text, '{text.REPLACEMENT}', '')) AS repl, length(text) - length(regexp_replace(text, '[\x{{c0}}-\x{{ff}}]+', '', 'g')) AS moji FROM documents"""


@query(f"""WITH r AS ({_RATIOS}), s AS (SELECT doc_id, n, CASE WHEN visible > 0 THEN bad / visible ELSE 0 END AS garbage, CASE WHEN n > 0 THEN bad / n ELSE 0 END AS garbage_all, CASE WHEN n > 0 THEN zh / n ELSE 0 END AS chinese,
    CASE WHEN n > 0 THEN repl / n ELSE 0 END AS replacement, CASE WHEN n > 0 THEN moji / n ELSE 0 END AS mojibake FROM r WHERE text IS NOT NULL)
  SELECT doc_id, round(garbage, 6) AS garbage, round(garbage_all, 6) AS garbage_all, round(chinese, 6) AS chinese, round(replacement, 6) AS replacement, round(mojibake, 6) AS mojibake,
    round(garbage + 2 * replacement + 0.6 * mojibake + CASE WHEN n > 50 AND chinese < 0.01 THEN 0.05 ELSE -0.5 * least(chinese, 0.2) END, 6) AS score,
    n >= 50 AND (replacement > 0.002 OR (mojibake > 0.08 AND chinese < 0.02)) AS needs_repair FROM s""")
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    values = {"garbage": text.garbage_ratio(t), "garbage_all": text.garbage_ratio(t, of_visible=False), "chinese": text.chinese_ratio(t), "replacement": text.replacement_ratio(t), "mojibake": text.mojibake_ratio(t), "score": text.quality_score(t)}
    return _t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", *(F.round(v, 6).alias(k) for k, v in values.items()), text.needs_repair(t).alias("needs_repair"))


def _cleaned(column: str) -> str:
    out = rf"regexp_replace({column}, '[\x{{0}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}]+', '', 'g')"
    out = f"replace({out}, '{text.REPLACEMENT}', '')"
    for run in text.OCR_RUNS:
        out = f"regexp_replace({out}, '{run}', '', 'g')"
    out = f"regexp_replace({out}, '[^{_V}{_S}]+', '', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({out}, '\A[{_S}]+|[{_S}]+\z', '', 'g')"


@query(f"SELECT doc_id, md5(c) AS cleaned_md5, length(c) AS n_chars FROM (SELECT doc_id, {_cleaned('text')} AS c FROM documents)")
def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("c"))
    return rows.select("doc_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("n_chars"))


@query(f"SELECT page_id, md5(c) AS cleaned_md5, length(c) AS n_chars FROM (SELECT page_id, {_cleaned('html')} AS c FROM pages)")
def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("c"))
    return rows.select("page_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("n_chars"))


_LINES = r"""ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), lines AS (SELECT doc_id, unnest(l) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS i FROM ls)"""
_BARE = rf"regexp_replace(line, '\A[{_S}]+|[{_S}]+\z', '', 'g')"
_ROW = rf"(length({_BARE}) >= 4 AND (length({_BARE}) - length(replace({_BARE}, '|', '')) >= 2 OR contains(line, chr(9)) OR len(list_filter(regexp_split_to_array({_BARE}, ' {{2,}}'), lambda c: c <> '')) >= 3))"


def _line_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, i FROM lines WHERE {_ROW}), g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r)
  SELECT doc_id, min(i) AS first_line, CAST(count(*) AS BIGINT) AS n_lines, count(*) >= 3 AS is_table FROM g GROUP BY doc_id, island""")
def aligned_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _line_rows(spark, sf).where(text.is_aligned_row(F.col("line"))).select("doc_id", "i")
    island = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    runs = rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("i").alias("first_line"), F.count("*").alias("n_lines"))
    return runs.select("doc_id", "first_line", "n_lines", (F.col("n_lines") >= 3).alias("is_table"))


#: Lines of the domain; one follows each document, so that rules for headings, terms and Chinese text have rows.
DOMAIN = [
    "1 范围", "1.1 术语和定义 GB/T 4588.3-2002", "附录A 试验方法", "第二章 总则", "表 1 板厚 与 线宽 FR-4 1oz", "图 2-1 阻抗 50 ohm", "FR 4 , CEM-3 , 聚酰亚胺 , Rogers 4350", "喷锡 或 沉金 , OSP , 沉银 .",
    "thickness and trace width, impedance 50 ohm, 2 oz", "AOI , 飞针 , flying probe , ICT , 在线测试 .", "IPC-6012 ISO 9001:2015 SJ/T 10309-2016", "no term here",
]
_DOMAIN = f"domain AS (SELECT doc_id, text || chr(10) || ({_list(DOMAIN)})[doc_id % {len(DOMAIN)} + 1] AS text FROM documents)"


def _domain(spark: SparkSession, sf: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, DOMAIN)), (F.col("doc_id") % len(DOMAIN) + 1).cast("int"))
    return _t(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n"), line).alias("text"))


def _of_section(k: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}') THEN regexp_extract(b, '{p}', {k})" for p, _ in chunking.LINE_SECTIONS) + " END"


_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}') THEN '{k}'" for p, k in chunking.LINE_SECTIONS) + " END"


@query(f"""WITH {_DOMAIN}, {_LINES.replace('FROM documents', 'FROM domain')}, k AS (SELECT doc_id, {_BARE} AS b, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines)
  SELECT doc_id, CAST(start AS INTEGER) AS start, {_SECTION} AS kind, {_of_section(1)} AS number, {_of_section(2)} AS title FROM k WHERE {_SECTION} IS NOT NULL""")
def section_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _domain(spark, sf).select("doc_id", F.explode(chunking.sections(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.start", "s.kind", "s.number", "s.title")


_BLOCK_KIND = r"""CASE WHEN regexp_matches(left(p, 100), '(?m)^(?:[\d]+[.、)]|[a-z][.)]|[-•·※])\s+') THEN 'list' WHEN regexp_matches(left(p, 100), '(?m)^[\s]*(?:def |class |import |from |if |for |while |#)') THEN 'code' ELSE 'paragraph' END"""


@query(rf"""WITH ps AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda p: regexp_replace(p, '\A[{_S}]+|[{_S}]+\z', '', 'g')), lambda p: p <> '') AS l FROM documents),
  e AS (SELECT doc_id, unnest(l) AS p, CAST(unnest(range(len(l))) AS INTEGER) AS block FROM ps) SELECT doc_id, block, {_BLOCK_KIND} AS kind, length(p) AS n_chars, md5(p) AS text_md5 FROM e""")
def paragraph_blocks(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", r"\n{2,}"), text.strip), lambda p: p != "")
    rows = _t(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("block", "p"))
    head = F.substring("p", 1, 100)
    kind = F.when(head.rlike("(?md)" + chunking.LIST_START.pattern), "list").when(head.rlike("(?md)" + chunking.CODE_START.pattern), "code").otherwise("paragraph")
    return rows.select("doc_id", "block", kind.alias("kind"), F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("text_md5"))


# --- metadata -----------------------------------------------------------------------------------------------------


def _ladder(t: str, low: str) -> str:
    steps = [f"WHEN regexp_matches({t}, '(?i){p}') THEN '{k}'" for p, k in metadata.STANDARD_TYPES]
    for words in (metadata.TYPE_WORDS, metadata.TYPE_FALLBACKS):
        steps += [f"WHEN {' OR '.join(f'''contains({low}, '{w.lower()}')''' for w in ws)} THEN '{k}'" for k, ws in words.items()]
    return "CASE " + " ".join(steps) + " ELSE 'general' END"


@query(f"SELECT doc_id, {_ladder('text', 'lower(text)')} AS doc_type FROM documents WHERE text IS NOT NULL")
def document_types(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", metadata.document_type(F.col("text")).alias("doc_type"))


def _entity_sql() -> str:
    edge = r"[^\p{L}\p{N}_]"  # a word's edge, for letters of any script

    def one(kind: str, p: str) -> str:
        first, last = p.startswith(r"\b"), p.endswith(r"\b")
        core = p[2 * first : len(p) - 2 * last]
        whole = (f"(?:^|{edge})" if first else "") + f"({core})" + (f"(?:$|{edge})" if last else "")
        return f"SELECT doc_id, '{kind}' AS kind, list_distinct(list_transform(regexp_extract_all(text, '(?i){whole}', 1), lambda x: trim(x))) AS found FROM domain"

    return f"WITH {_DOMAIN}, e AS ({' UNION ALL '.join(one(*x) for x in metadata.ENTITIES.items())}) SELECT doc_id, kind, CAST(least(len(found), 10) AS INTEGER) AS n FROM e WHERE len(found) > 0"


@query(_entity_sql())
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _domain(spark, sf).select("doc_id", F.explode(metadata.entities(F.col("text"))).alias("kind", "found"))
    return rows.select("doc_id", "kind", F.size("found").alias("n"))


@query(rf"""SELECT doc_id, regexp_matches(text, '(?:\t.*){{3,}}|\|.*\|.*\|') AS has_table, regexp_matches(text, '{metadata.FORMULA}') AS has_formula,
  regexp_matches(text, '(?m){metadata.LIST}') AS has_list, length(text) AS char_count, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents WHERE text IS NOT NULL""")
def structure_flags(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    n = F.length(t).cast("long")
    return _t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", metadata.has_table(t).alias("has_table"), metadata.has_formula(t).alias("has_formula"), metadata.has_list(t).alias("has_list"), n.alias("char_count"), (n - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("line_count"))


def _date_sql(t: str) -> str:
    def one(p: str) -> str:
        y, m, d = (f"regexp_extract({t}, '{p}', {k})" for k in (1, 2, 3))
        return f"CASE WHEN TRY_CAST({m} AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST({d} AS INTEGER) BETWEEN 1 AND 31 THEN {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') END"

    return "coalesce(" + one(r"(20\d{2})[-._](\d{1,2})[-._](\d{1,2})") + ", " + one(r"(20\d{2})(\d{2})(\d{2})") + ")"


@query(f"""SELECT page_id, {_date_sql('url')} AS url_date, {_date_sql('html')} AS text_date,
  CASE {' '.join(f"WHEN contains(lower(url), '{a}') THEN '{b}'" for a, b in metadata.VENDORS)} END AS vendor, CASE {' '.join(f"WHEN contains(lower(url), '{a}') THEN '{b}'" for a, b in metadata.TOOLS)} END AS eda FROM pages""")
def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return _t(spark, sf, "pages").select("page_id", metadata.effective_date(u).alias("url_date"), metadata.effective_date(F.col("html")).alias("text_date"), metadata.vendor(u).alias("vendor"), metadata.design_tool(u).alias("eda"))


# --- queries, conversations, sessions -----------------------------------------------------------------------------


def _class_sql() -> str:
    scores = []
    for name, c in vocabulary.CLASSES.items():
        parts = [f"CASE WHEN {' OR '.join(f'''regexp_matches(q, '(?i){r}')''' for r in c['regex'])} THEN 10.0 ELSE 0 END"] if c.get("regex") else []
        parts += [f"CASE WHEN contains(l, '{k.lower()}') THEN 3.0 + CASE WHEN regexp_matches(q, '(?i)(?:^|[^\\pL\\pN_]){k}(?:[^\\pL\\pN_]|$)') THEN 1 ELSE 0 END ELSE 0 END" for k in c["keywords"]]
        parts += [f"CASE WHEN contains(l, '{p.lower()}') THEN 2.0 + CASE WHEN starts_with(l, '{p.lower()}') THEN 1 ELSE 0 END ELSE 0 END" for p in c["patterns"]]
        scores.append(f"{' + '.join(parts)} AS {name}")
    names = list(vocabulary.CLASSES)
    top = f"greatest({', '.join(names)})"
    terms = " OR ".join(f"contains(l, '{w}')" for w in sorted(vocabulary.protected_terms()))
    units = r"(?i)(?:^|[^\pL\pN_])\d+(?:\.\d+)?\s*(?:mm|mil|oz|ohm|μm|um|Ω|层)(?:[^\pL\pN_]|$)"
    return f"""WITH b AS (SELECT conv_id, turn, {_BARE.replace('line', 'text')} AS q, lower({_BARE.replace('line', 'text')}) AS l FROM conversations), s AS (SELECT *, {', '.join(scores)} FROM b),
  k AS (SELECT conv_id, turn, CASE WHEN coalesce(q, '') = '' THEN 'general' WHEN {top} >= 2 THEN CASE {' '.join(f"WHEN {n} = {top} THEN '{n}'" for n in names)} END WHEN regexp_matches(q, '{units}') THEN 'specification'
    WHEN length(q) > 35 OR length(q) - length(replace(q, '，', '')) > 2 THEN 'definition' WHEN length(q) < 15 AND ({terms}) THEN 'specification' ELSE 'general' END AS query_class FROM s)
  SELECT conv_id, turn, query_class, CASE query_class {' '.join(f"WHEN '{n}' THEN {c['weights'][0]}::DOUBLE" for n, c in vocabulary.CLASSES.items())} ELSE {vocabulary.GENERAL['weights'][0]}::DOUBLE END AS vector_weight FROM k"""


@query(_class_sql())
def query_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", understanding.classify(F.col("text")).alias("query_class"))
    return rows.withColumn("vector_weight", understanding.strategy(F.col("query_class"))["vector_weight"])


_SAID = "CASE WHEN role = 'user' THEN '用户：' || coalesce(text, '') WHEN role = 'assistant' THEN '助手：' || coalesce(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, '') END"


@query(f"""WITH s AS (SELECT conv_id, turn, {_SAID} AS line FROM conversations) SELECT conv_id, turn, md5(coalesce(array_to_string(list_filter(list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), chr(10)), '')) AS history_md5 FROM s""")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    return understanding.history(_t(spark, sf, "conversations")).select("conv_id", "turn", F.md5("history").alias("history_md5"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("ts"))


_SESSIONS = "s AS (SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS updated_at, CAST(count(*) AS BIGINT) AS message_count FROM events GROUP BY user_id)"
_NOW = "2024-01-30 12:00:00"


@query(f"WITH {_SESSIONS} SELECT session_id, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us, message_count, updated_at < TIMESTAMP '{_NOW}' - INTERVAL 60 MINUTE AS is_expired FROM s")
def session_ttl(spark: SparkSession, sf: str) -> DataFrame:
    s = sessions.summaries(_events(spark, sf))
    now = F.lit(_NOW).cast(s.schema["updated_at"].dataType)
    old = F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(sessions.MINUTES))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("session_id", us("created_at").alias("created_us"), us("updated_at").alias("updated_us"), "message_count", old.alias("is_expired"))


@query(f"WITH {_SESSIONS} SELECT session_id, message_count FROM s ORDER BY updated_at DESC, session_id LIMIT 100")
def session_lru(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.most_recent(sessions.summaries(_events(spark, sf)), 100).select("session_id", "message_count")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id AS key, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 60 MINUTE) AS closed_us, CAST(count(*) AS BIGINT) AS n_events FROM n GROUP BY user_id, k""")
def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return sessions.idle_sessions(_t(spark, sf, "events")).select("key", us("started_at").alias("started_us"), us("closed_at").alias("closed_us"), "n_events")


# --- contexts and citations ---------------------------------------------------------------------------------------

_HITS = f"WITH {_TERMS}, {_scored('a')}, h AS (SELECT a.*, d.text, d.source || '/' || d.doc_id || '.txt' AS source_path, d.doc_id || '' AS source_name FROM a JOIN documents d ON d.doc_id = a.id WHERE rank <= 5 AND d.source IS NOT NULL)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    found = lexical.search_texts(docs, _asked(spark), 5)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return found.join(docs.where("source IS NOT NULL").select(F.col("doc_id").alias("id"), "text", path.alias("source_path")), "id")


_PART = "CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END"


@query(f"""{_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h)
  SELECT query_id, md5(string_agg('[文档' || i || ': ' || source_name || ']' || chr(10) || {_PART}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS context_md5, CAST(count(*) AS INTEGER) AS doc_count, CAST(sum(length({_PART})) AS INTEGER) AS total_chars FROM n GROUP BY query_id""")
def context_build(spark: SparkSession, sf: str) -> DataFrame:
    return context.context(_hits(spark, sf)).select("query_id", F.md5("context").alias("context_md5"), "doc_count", "total_chars")


@query(f"""{_HITS} SELECT query_id, rank, md5(regexp_replace(text, '\\A[{_S}]+|[{_S}]+\\z', '', 'g')) AS content_md5, round(score, 6) AS score, source_name AS title FROM h""")
def retrieval_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = context.records(_hits(spark, sf))
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), F.md5("content").alias("content_md5"), "score", "title")


@query(f"""{_HITS} SELECT query_id, id, CASE WHEN contains('the answer is in document 1234567890', source_name) THEN 'medium' ELSE 'low' END AS confidence FROM h WHERE length(source_name) >= 2""")
def citation_confidence(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).where(F.length(F.regexp_extract("source_path", r"(\d+)\.txt$", 1)) >= 2)
    answers = hits.select("query_id").distinct().withColumn("answer", F.lit("the answer is in document 1234567890"))
    cited = answering.citations(answers, hits)
    rows = cited.select("query_id", F.explode("citations").alias("c"))
    return rows.select("query_id", F.regexp_extract("c.source", r"(\d+)\.txt$", 1).cast("long").alias("id"), "c.confidence")


# --- chunks: folds without a form in SQL, held against brute force in the tests -----------------------------------


def _chunks(spark: SparkSession, sf: str, split, mark: str) -> DataFrame:
    return chunking.link(chunking.chunk(_t(spark, sf, "documents"), split, mark))


@query()
def chunk_structure(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, chunking.split_structure, "-")


@query()
def chunk_parent_child(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, chunking.split_children, "-pc-")


@query()
def chunk_meaning(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.embedding import hashed

    return chunking.link_sections(chunking.chunk(_t(spark, sf, "documents"), chunking.Meaning(hashed), "-sem-"))


@query()
def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_t(spark, sf, "documents"), chunking.split_tokens, "-s-")


@query()
def chunk_levels(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_t(spark, sf, "documents"), chunking.split_levels, "-h-")


@query()
def chunk_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.length_stats(chunking.chunk(_t(spark, sf, "documents"), chunking.split_children, "-pc-"))


_PARAS = rf"""WITH ps AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda p: regexp_replace(p, '\A[{_S}]+|[{_S}]+\z', '', 'g')), lambda p: p <> '') AS l FROM documents),
  c AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(range(len(l))) AS chunk_idx FROM ps), ch AS (SELECT *, md5(doc_id || '-p-' || chunk_idx) AS chunk_id FROM c),
  linked AS (SELECT *, lag(chunk_id, 1, '') OVER w AS prev_id, lead(chunk_id, 1, '') OVER w AS next_id FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx))"""


def _lines_as_chunks(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda p: p != "")
    rows = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(parts).alias("chunk_idx", "text"))
    rows = rows.withColumns({"chunk_id": F.md5(F.concat("doc_id", F.lit("-p-"), "chunk_idx")), "parent_idx": F.floor(F.col("chunk_idx") / 4).cast("int")})
    return chunking.link(rows)


@query(_PARAS + """ SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, chunk_id, prev_id, next_id, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks_in_doc,
  chunk_idx = min(chunk_idx) OVER (PARTITION BY doc_id, chunk_idx // 4) AS is_first_in_parent, chunk_idx = max(chunk_idx) OVER (PARTITION BY doc_id, chunk_idx // 4) AS is_last_in_parent FROM linked""")
def chunk_links(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_as_chunks(spark, sf).select("doc_id", "chunk_idx", "chunk_id", "prev_id", "next_id", "total_chunks_in_doc", "is_first_in_parent", "is_last_in_parent")


@query(_PARAS + """, h AS (SELECT 1 AS query_id, chunk_id, doc_id, chunk_idx FROM linked WHERE chunk_idx = 3), n AS (SELECT DISTINCT h.query_id, l.chunk_id FROM h JOIN linked l ON l.doc_id = h.doc_id AND abs(l.chunk_idx - h.chunk_idx) <= 2)
  SELECT n.query_id, n.chunk_id AS id, CASE WHEN h.chunk_id IS NULL THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END AS score, h.chunk_id IS NULL AS is_context FROM n LEFT JOIN h USING (query_id, chunk_id)""")
def chunk_expand(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _lines_as_chunks(spark, sf)
    hits = chunks.where("chunk_idx = 3").select(F.lit(1).alias("query_id"), F.col("chunk_id").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return context.expand(hits, chunks, hops=2, with_parents=False).select("query_id", "id", "score", "is_context")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Two routes of lexical search over all documents, fused by weighted reciprocal rank."""
    return rrf_weighted(spark, sf)
