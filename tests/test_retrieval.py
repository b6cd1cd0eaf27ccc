"""Search, fusion, context, answers, understanding, metrics and sessions against plain Python."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import tokens
from tessera.operators import answering, context, fusion, lexical, metrics, rerank, understanding, vector
from tessera.operators.filters import Condition, Conditions, predicate

DOCS = [(1, "The annular ring of the PCB"), (2, "ring ring ring width"), (3, ""), (4, None), (5, "线宽 与 阻抗 width"), (6, "the the the")]


def _terms(spark, text, **how):
    return spark.createDataFrame([(text,)], "t string").select(tokens.terms(F.col("t"), **how).alias("x")).first().x


def test_terms(spark):
    assert _terms(spark, "The Annular ring, IPC-6012") == ["annular", "ring", "ipc-6012", "annular_ring", "ring_ipc-6012"]
    assert _terms(spark, "线宽的") == ["线宽的", "线宽", "宽的", "线", "宽"]
    assert _terms(spark, "的 阻") == ["阻", "阻"]
    assert _terms(spark, "of a", protected=("of",)) == ["of"]
    assert _terms(spark, None) is None and _terms(spark, "") == []
    assert _terms(spark, "线宽", segment=lambda r: list(r)) == ["线", "宽", "线宽"]


def _brute(query: str, spark) -> list[tuple[float, int]]:
    all_terms = {i: Counter(_terms(spark, t) or []) for i, t in DOCS}
    n, avg = len(DOCS), sum(sum(c.values()) for c in all_terms.values()) / len(DOCS)
    df = Counter(t for c in all_terms.values() for t in c)
    out = []
    for i, c in all_terms.items():
        s = 0.0
        for t, q in Counter(_terms(spark, query)).items():
            if c[t] and df[t] <= 0.8 * n:
                s += math.log((n + 1) / (df[t] + 0.5)) * (c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) + 1) * min(q, 3)
        if s > 0:
            out.append((s, i))
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("query", ["ring width", "annular ring ring ring ring ring", "线宽", "the", "absent"])
def test_bm25_agrees_with_brute_force(spark, query):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    asked = spark.createDataFrame([(7, query)], "query_id int, text string")
    want = _brute(query, spark)
    for rows in (lexical.search(lexical.Index.build(docs), asked), lexical.search_texts(docs, asked)):
        got = [(r.score, r.id) for r in rows.orderBy("rank").collect()]
        assert [i for _, i in got] == [i for _, i in want]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-6)


def test_search_counts_only_the_terms_asked_for(spark):
    docs = spark.createDataFrame([*DOCS, (1, "ring width"), (2, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "ring width"), (8, "annular")], "query_id int, text string")
    made = lexical.search(lexical.Index.build(docs), asked)
    assert sorted(made.collect()) == sorted(lexical.search_texts(docs, asked).collect())  # repeated ids are one document
    lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = [b for b, line in zip(lines, lines[1:]) if "Generate explode(terms" in line]
    assert len(above) == 2 and all(" IN (annular,ring,ring_width,width)" in b for b in above)  # postings and the counts of their documents


def test_an_index_is_made_in_parts_by_the_tables_size(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(lexical, "PART_BYTES", 10_000)
    n = lexical._parts(docs)
    plan = lexical.Index.build(docs).postings._jdf.queryExecution().optimizedPlan().toString()
    assert n >= 29 and any("RepartitionByExpression [_id" in line and line.endswith(f", {n}") for line in plan.split("\n"))


def test_search_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "x")], "query_id int, text string")
    assert lexical.search_texts(docs, asked).collect() == [] and lexical.search(lexical.Index.build(docs), asked).collect() == []


def test_vector_search_agrees_with_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)).astype("float32")
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, [0.0] * 8, 0), (901, None, 0), (902, [1.0], 0), (903, [float("nan")] * 8, 0), (904, x[5].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    q = df.where("vec_id IN (5, 17)").withColumnRenamed("vec_id", "query_id")
    got = vector.search(df, q, 6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for query in (5, 17):
        found = [r.id for r in got.where(f"query_id = {query}").orderBy("rank").collect()]
        order = sorted([*range(200), 904], key=lambda i: (-round(float(unit[query] @ unit[5 if i == 904 else i]), 6), i))
        assert found == order[:6]
    own = vector.search(df, q, 6, filters=("label",)).join(df.select(F.col("vec_id").alias("id"), "label"), "id").join(q.select("query_id", F.col("label").alias("l")), "query_id")
    assert own.where("label <> l").count() == 0 and own.count() == 12
    near = vector.approximate(df.where("vec_id <> 904"), q, 1).collect()
    assert {r.query_id: r.id for r in near} == {5: 5, 17: 17}


def _route(spark, *ids):
    return spark.createDataFrame([(1, i, 1.0 - k / 10, k + 1) for k, i in enumerate(ids)], "query_id int, id string, score double, rank int")


def test_fusion(spark):
    a, b = _route(spark, "x", "y", "z"), _route(spark, "y", "w")
    rows = {r.id: r.score for r in fusion.weighted_rrf([(a, 1.0), (b, 2.0), (a, 0.0)], 10, 40).collect()}
    assert rows == pytest.approx({"x": 1 / 41, "y": 1 / 42 + 2 / 41, "z": 1 / 43, "w": 2 / 42})
    same = [[(r.id, round(r.score, 12)) for r in fusion.rrf(p, q).orderBy("rank").collect()] for p, q in ((a, b), (b, a))]
    assert dict(same[0]) == dict(same[1])
    boosted = {r.id: r.score for r in fusion.rrf_with_overlap(a, b, 10).collect()}
    assert boosted["y"] == pytest.approx(0.5 / 62 + 0.5 / 61 + 0.1 / (1 + math.sqrt(2) / 20))
    assert {r.id: r.score for r in fusion.rrf_or_dense(a, b.limit(0)).collect()} == {"x": 1.0, "y": 0.9, "z": 0.8}
    assert [r.score for r in fusion.normalised(a).orderBy("rank").collect()] == pytest.approx([1, 0.5, 0])
    for mode in ("vector", "bm25", "fusion", "fusion_expand", "fusion_score", "union", "rrf", "union_rrf"):
        assert fusion.retrieve(mode, {"vector": a, "bm25": b}, 2).count() == 2


def test_context_and_records(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", f"t{i}" if i != 3 else "", f"c{i - 1}" if i else "", f"c{i + 1}" if i < 5 else "", "p" if i == 2 else "", "root") for i in range(6)] + [("p", "d", "parent", "", "", "", "root")], "chunk_id string, doc_id string, text string, prev_id string, next_id string, parent_id string, doc_node_id string")
    hits = spark.createDataFrame([(1, "c2", 0.9, 1)], "query_id int, id string, score double, rank int")
    rows = context.expand(hits, chunks, hops=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [("c2", 0.9), ("p", 0.15), ("c0", 0.05), ("c1", 0.05), ("c4", 0.05)]
    found = spark.createDataFrame([(1, "a", 0.5, 1, " x ", "dir/GBT4588.4-2017.pdf"), (1, "b", 0.4, 2, "  ", None), (1, "c", 0.1, 3, "y" * 1500, None)], "query_id int, id string, score double, rank int, text string, source_path string")
    assert [r.id for r in context.cut(found, 5, 0.2).collect()] == ["a"]
    assert [(r.content[:1], r.title) for r in context.records(found).orderBy("rank").collect()][0] == ("x", "GBT4588.4-2017")
    made = context.context(found).first()
    assert made.context.startswith("[文档1: GBT4588.4-2017]\n x \n\n---\n\n[文档2: 未知来源]") and made.doc_count == 3 and made.total_chars == 3 + 2 + 1003


def test_answers_and_citations(spark):
    hits = spark.createDataFrame([(1, "a", 0.2, 1, "text a", "d/other-name.pdf"), (1, "b", 0.1, 2, "text b", "d/GBT4588.4-2017.pdf"), (1, "c", 0.3, 3, "c", None)], "query_id int, id string, score double, rank int, text string, source_path string")
    said = spark.createDataFrame([(1, "见 GB/T 4588.4-2017 及 name")], "query_id int, answer string")
    cited = answering.citations(said, hits).first().citations
    assert [(c.source_name, c.confidence) for c in cited] == [("GBT4588.4-2017", "high"), ("other-name", "medium"), ("未知来源", "low")]
    out = answering.answer(spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query string"), hits, load=lambda: lambda p: "依据 GB/T 4588.4-2017").orderBy("query_id").collect()
    assert out[0].answer == "依据 GB/T 4588.4-2017" and out[0].sources == ["d/other-name.pdf", "d/GBT4588.4-2017.pdf", "未知来源"] and out[1].answer == answering.NO_ANSWER
    text = spark.createDataFrame([("x {\"overall\": 4, \"reason\": \"ok\"} y",), ("none",), (None,)], "t string").select(answering.rating(F.col("t")).alias("r")).collect()
    assert [(r.r.overall, r.r.reason) for r in text] == [(4.0, "ok"), (3.0, ""), (3.0, "")]


def test_understanding(spark):
    queries = ["vendor=JLCPCB 4层 1oz", "4层PCB", "kicad 4-layer", "layers: x", "什么是HDI", "GB/T 4588", "<tag> a  b", "PCB测试", "", None]
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    q = F.col("q")
    rows = df.select(understanding.filters(q).alias("f"), understanding.without_filters(q).alias("w"), understanding.classify(q).alias("k"), understanding.with_tags(q).alias("t"), understanding.with_synonyms(q).alias("s"), understanding.variants(q, 5).alias("v")).collect()
    assert (rows[0].f.vendor, rows[0].f.layer_count, rows[0].f.copper_oz, rows[0].w) == ("JLCPCB", 4, 1.0, "4层 1oz")
    assert rows[1].f.layer_count is None and rows[2].f.layer_count is None and rows[2].f.eda == "kicad" and rows[3].f.layer_count == 0
    assert [rows[i].k for i in (4, 5, 8, 9)] == ["definition", "standard", "general", "general"]
    assert rows[6].t == "<tag> a b tag" and rows[7].s == "PCB测试 印制板 印制电路板 线路板 printed circuit board 试验 检验 检测"
    assert rows[7].v[0] == "PCB测试" and rows[7].v[1] == rows[7].s and len(rows[7].v) == 5
    assert understanding.rewritten("PCB测试", lambda p: "1. 甲\n- 乙\nPCB测试", 2) == ["PCB测试", "甲", "乙"]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "y", 1)], "query_id int, id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (3, "q")], "query_id int, id string")
    rows = {r.query_id: r for r in metrics.per_query(hits, truth, (1, 3)).collect()}
    assert rows[1].reciprocal_rank == 1 and rows[1].average_precision == pytest.approx((1 + 2 / 3) / 2) and rows[1].r_precision == 0.5
    assert rows[1].recall_3 == 1 and rows[1].ndcg_3 == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3))) and rows[3].hit_3 == 0
    report = metrics.report(hits, truth, (1,))
    assert {r.metric: r.value for r in report.collect()}["mrr"] == pytest.approx(1 / 3)
    assert {r.delta for r in metrics.compare(report, report).collect()} == {0.0}


def test_metrics_by_label_are_those_of_the_truth_written_out(spark):
    docs = spark.createDataFrame([(i, i % 4) for i in range(40)] + [(3, 1), (5, 1), (7, None)], "id long, label int")
    queries = spark.createDataFrame([(100, 1), (101, 3), (102, 3), (102, 1), (103, None), (104, 9), (101, 3)], "query_id long, label int")
    hits = spark.createDataFrame([(q, (q + 3 * r) % 40, r) for q in range(100, 105) for r in range(1, 11)] + [(100, 3, 4)], "query_id long, id long, rank int")
    truth = queries.join(docs, "label")
    made = metrics.per_query_by_label(hits, queries, docs, (1, 5))
    assert sorted(made.collect()) == sorted(metrics.per_query(hits, truth, (1, 5)).collect()) and made.count() == 3
    # no table of all queries' documents
    from tessera.plans import queries as registered

    sf, seen = "/root/testdata/sf0.001", []
    own, metrics._measured = metrics._measured, lambda size, found, ks: seen.append((size, found)) or own(size, found, ks)
    try:
        registered.QUERIES["ir_metrics"](spark, sf)
    finally:
        metrics._measured = own
    ((size, found),) = seen
    assert "label" not in size.columns and found.count() <= 10 * size.count()
    plan = size._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Join Inner")[1]  # queries meet counts of labels, not documents


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "a", "ring width", "width", 0.1, 1), (1, "b", "ring width", "ring width", 0.0, 2)], "query_id int, id string, query string, text string, score double, rank int")
    assert [r.id for r in rerank.by_overlap(hits, 1).collect()] == ["b"]
    load = lambda: lambda q, t: np.array([[0.0, float(len(x))] for x in t])
    assert [(r.id, r.score) for r in rerank.make("model", load, top=2)(hits).orderBy("rank").collect()] == [("b", 10.0), ("a", 5.0)]
    assert rerank.make("model", load, free_mib=[100], top=2) is None and rerank.make(None) is None
    assert rerank.of_yes_no(np.array([0.0]), np.array([0.0]))[0] == 0.5 and rerank.of_logits(np.array([[1.0], [2.0]])).tolist() == [1.0, 2.0]


def test_filters(spark):
    df = spark.createDataFrame([("JLCPCB", 4, ["x"]), (None, None, None)], "vendor string, layer_count int, standards array<string>")
    n = lambda t: df.where(predicate(df, t)).count()
    assert n(Condition("vendor", "JLCPCB")) == 1 and n(Condition("vendor", "JLCPCB", "!=")) == 1 and n(Condition("layer_count", "2", ">")) == 1
    assert n(Condition("standards", "x", "contains")) == 1 and n(Condition("vendor", "PCB", "contains")) == 1 and n(Condition("absent", 1)) == 0 and n(Condition("absent", 1, "!=")) == 2
    assert n(Conditions([Condition("vendor", "JLCPCB"), Condition("layer_count", 9, ">=")], any_of=True)) == 1 and n(Conditions([], any_of=True)) == 0 and n(Conditions([])) == 2


def test_max_similarity(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[2.0, 0.0], [1.0, 1.0]]), (None, [[1.0, 0.0]])], "q array<array<double>>, d array<array<double>>")
    assert [r.s for r in df.select(vector.max_similarity(F.col("q"), F.col("d")).alias("s")).collect()] == pytest.approx([1 + math.sqrt(0.5), 0.0])


def test_similar_pairs_meet_in_products(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, [float("nan")] * 8, 0), (901, [0.0] * 8, 0), (902, [1.0, None] * 4, 0), (903, x[3].tolist(), None), (904, x[0].tolist(), 0), (905, [1.0], 0), (906, [2.0], 0), (907, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    made = vector.similar_pairs(df.where("vec_id % 20 = 0 OR vec_id > 900"), df, 0.7, "label")
    good = {i: (np.array(v), label) for i, v, label in rows if v and None not in v and label is not None and 0 < np.dot(v, v) < np.inf}
    cos = {(a, b): good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) for a in good for b in good if (a % 20 == 0 or a > 900) and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])}
    assert {(r.id, r.other): r.score for r in made.collect()} == pytest.approx({p: s for p, s in cos.items() if s >= 0.7})
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()  # no row a pair before the threshold
    assert vector.similar_pairs(df.where("false"), df, 0.7, "label").collect() == []


def test_vector_search_keeps_the_smallest_ids_of_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0 + (i % 2)], f"k{i % 2}") for i in range(9000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3)
    got = vector.search(df, df.where("vec_id IN (0, 1)").withColumnRenamed("vec_id", "query_id"), 4)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == [(q, n + 1, q + 2 * n) for q in (0, 1) for n in range(4)]
    by_text = vector.search(df.withColumn("vec_id", F.col("vec_id").cast("string")), df.where("vec_id IN (0, 1)").withColumnRenamed("vec_id", "query_id").withColumn("label", F.when(F.col("query_id") == 0, F.lit("k1"))), 2, filters=("label",))
    assert sorted((r.query_id, r.id) for r in by_text.collect()) == [(0, "1"), (0, "1001"), (1, "1"), (1, "1001")]
