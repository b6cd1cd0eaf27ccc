"""Sources, store, sessions, the engine end to end, and the registered queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import queries
from tessera.plans.config import PRESETS
from tessera.plans.engine import Engine, prepare
from tessera.sources import files, store
from tessera.streaming import sessions

SF = "/root/testdata/sf0.001"
TEXT = "1 范围\n本标准规定了印制板的阻抗要求。阻抗应符合 GB/T 4588.4-2017。\n\n2 要求\n线宽和铜箔厚度应满足设计要求。" * 6


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    docs = spark.createDataFrame([("a", TEXT, "标准/国家标准/GBT4588.4-2017.txt"), ("b", "KiCad 4 layer board, annular ring width. " * 40, "jlcpcb/kicad 4层.txt"), ("c", None, "x.txt")], "doc_id string, text string, source_path string")
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    e.ingest(docs)
    return e


def test_engine_answers(spark, engine):
    asked = spark.createDataFrame([("q1", "印制板阻抗要求"), ("q2", "eda=kicad annular ring"), ("q3", "  ")], "query_id string, query string")
    rows = engine.retrieve(asked, 3).collect()
    assert {r.title for r in rows if r.query_id == "q1"} >= {"GBT4588.4-2017"} and {r.title for r in rows if r.query_id == "q2"} == {"kicad 4层"} and not [r for r in rows if r.query_id == "q3"]
    answers = {r.query_id: r for r in engine.ask(asked, 3).collect()}
    assert set(answers) == {"q1", "q2"} and answers["q1"].doc_count >= 1
    talk = spark.createDataFrame([(1, 0, "user", "印制板阻抗"), (1, 1, "assistant", "..."), (1, 2, "user", "它的要求")], "conv_id long, turn long, role string, text string")
    assert engine.chat(talk).count() == 1 and engine.health().where("ready").count() >= 2


def test_every_chunking_prepares(spark):
    docs = spark.createDataFrame([("a", TEXT, "p.txt"), ("b", "", "q.txt")], "doc_id string, text string, source_path string")
    for name in ("high-precision", "high-speed", "hierarchical"):
        assert prepare(docs, PRESETS[name]).where("doc_id = 'a' AND chunk_id IS NOT NULL").count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    chinese = "1 范围\n印制板的尺寸和厚度应符合标准要求。" * 5
    (tmp_path / "in" / "a.txt").write_bytes(chinese.encode("gbk"))
    (tmp_path / "in" / "sub" / "b.MD").write_bytes(chinese.encode())
    (tmp_path / "in" / "c.bin").write_bytes(b"\x00")
    (tmp_path / "in" / "d.rtf").write_bytes(rb"{\rtf1\ansi {\fonttbl x}plain\par text}")
    found = files.read_files(spark, str(tmp_path / "in"), ("txt", "md"))
    assert found.count() == 2
    report = {r.input.rsplit("/", 1)[1]: r for r in files.preprocess(found).collect()}
    assert report["a.txt"].original_encoding == "gbk" and report["a.txt"].status == "success" and report["b.MD"].status == "skip"
    docs = {r.source_path.rsplit("/", 1)[1]: r for r in files.documents(files.read_files(spark, str(tmp_path / "in"))).collect()}
    assert docs["a.txt"].text == chinese and docs["c.bin"].text is None and docs["c.bin"].error and docs["d.rtf"].text == "plain\ntext"
    assert [r.encoding for r in files.fix_encodings(found).collect()] == ["gbk"]
    assert files.summary(files.preprocess(found)).count() == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    row = lambda *x: spark.createDataFrame(list(x), "chunk_id string, text string")
    s.upsert(row(("a", "1"), ("", "none")))
    s.upsert(row(("a", "2"), ("b", "3")))
    assert {(r.chunk_id, r.text) for r in s.scan().collect()} == {("a", "2"), ("b", "3")}
    assert s.lookup(row(("b", ""))).count() == 1
    chunks = spark.createDataFrame([("a", "d", "汉" * 4000, "v"), ("b", "d", " ", None)], "chunk_id string, doc_id string, text string, vendor string")
    store.write_corpus(chunks, str(tmp_path / "c"))
    (r,) = store.read_corpus(spark, str(tmp_path / "c")).collect()
    assert r.id == "a" and len(r.text) == 2666 and r.vendor == "v"


def test_session_tables(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 0), ("a", "2024-01-01 00:30:00", 1), ("b", "2024-01-01 01:30:00", 0), ("c", "2024-01-01 01:31:00", 0)], "session_id string, ts string, turn int").withColumn("ts", F.to_timestamp("ts"))
    s = sessions.summaries(rows)
    now = F.to_timestamp(F.lit("2024-01-01 02:30:00"))
    assert {r.session_id for r in sessions.expired(s, now).collect()} == {"a"} and {r.session_id for r in sessions.live(s, now).collect()} == {"b", "c"}
    assert [r.session_id for r in sessions.most_recent(s, 1).collect()] == ["c"]
    assert sessions.cleared(rows, spark.createDataFrame([("a",)], "session_id string")).count() == 2
    said = rows.withColumns({"role": F.lit("user"), "text": F.lit("x")})
    assert {r.session_id: len(r.history) for r in sessions.transcript(said, 1).collect()} == {"a": 1, "b": 1, "c": 1}
    assert sessions.with_ids(said.withColumn("session_id", F.lit(None).cast("string")), ["ts", "turn"]).where("session_id IS NULL").count() == 0


def test_session_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = spark.createDataFrame([("a", "user", "hi"), ("a", "assistant", "yes"), ("b", "user", "x")], "session_id string, role string, text string")
    one.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).json(str(tmp_path / "in"))
    run = sessions.stateful(stream).writeStream.format("memory").queryName("session_rows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = {(r.session_id, r.turn): r for r in spark.table("session_rows").collect()}
    assert len(rows) == 3 and rows["a", 0].is_new and not rows["a", 1].is_new and '"hi"' in rows["a", 1].history


def _same(a, b) -> bool:
    plain = lambda df: sorted(repr(tuple(None if x != x else x for x in row)) for row in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None))
    return sorted(a.columns) == sorted(b.columns) and plain(a) == plain(b)


@pytest.mark.parametrize("name", ["bm25_multi_query", "rrf_overlap_boost", "text_quality", "clean_documents", "aligned_runs", "query_classes", "session_ttl", "chunk_expand", "ir_metrics", "context_build"])
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert _same(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df())
