"""Digest, mixing, language ID, quality and the pipeline on small tables with nulls, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import digest, langid, mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 0.5) for i, t, l, s in rows], DOCS)


def test_digest_meets_the_next_text(spark):
    texts = {1: "alpha beta gamma " * 50, 2: None, 3: "alpha beta gamma " * 50, 5: "", 9: "xyz" * 100_000}
    rows = {r.doc_id: r for r in digest.compare_with_next(_docs(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    ids = sorted(texts)
    for at, i in enumerate(ids):
        text, following = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        new = digest.edited(text, following)
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert rows[i].near_next == pytest.approx(digest.likeness(digest.fingerprint(text.encode()), digest.fingerprint(following.encode())))
    assert rows[1].fingerprint == rows[3].fingerprint and digest.compare_with_next(_docs(spark, [])).collect() == []
    assert digest.likeness(rows[1].fingerprint, rows[9].fingerprint) < 0.75


def test_counts_do_not_depend_on_chunks(monkeypatch):
    data = bytes(range(256)) * 20
    whole = digest.bucket_counts(data)
    monkeypatch.setattr(digest, "CHUNK", 100)
    assert (digest.bucket_counts(data) == whole).all()


def test_shares_reshare_the_excess():
    assert mixing.shares([100, 100, 100], [5, 2, 1], 300, 2.0) == pytest.approx([187.5, 75, 37.5])
    assert mixing.shares([10, 100, 0], [5, 2, 1], 165, 2.0) == pytest.approx([20, 145, 0])


def test_mix_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), None, [None, "a", "b"][i % 3]) for i in range(900)] + [(7, "w w", None, "b"), (7, "w w", None, "b"), (5000, None, None, "a"), (5001, "", None, "c")]
    docs = _docs(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and sorted((r.doc_id, r["copies"]) for r in out) == sorted((r.doc_id, r["copies"]) for r in mixing.mix(docs.repartition(7)).collect())
    for source in (None, "a", "b"):
        own = [r for r in out if r.source == source]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0].target, abs=40)
        assert all(0 <= r["copies"] <= 2 for r in own)
    assert mixing.mix(_docs(spark, [])).collect() == []
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(docs).count() == sum(r["copies"] for r in out)


def test_language_is_learned_and_mixed(spark):
    en, de = "the house and the garden with this that ", "das haus und der garten mit dieser nicht "
    docs = _docs(spark, [(i, en * 5, "en", "s") for i in range(4)] + [(i, de * 5, "de", "s") for i in range(4, 8)] + [(8, None, "en", "s"), (9, "123 !", None, "s"), (10, en * 30 + de * 3, None, "s"), (11, "", "de", "s")])
    model = langid.learn(docs)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [rows[i].lang_pred for i in (0, 5, 8, 9, 10, 11)] == ["en", "de", "und", "und", "en", "und"]
    assert rows[0].score > 0.9 and 0.6 < rows[10].score < 0.99 and rows[8].score == 0 and rows[0].asDict().keys() >= set(docs.columns) - {"score"}
    assert langid.learn(docs.limit(0))[0] == [] and langid.predict(docs, langid.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_quality_separates_classes(spark):
    good, bad = "A calm sentence, with words and an end. ", "$$ BUY!!! 999 %% click### "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5), None, "s") for i in range(60)] + [(100, None, None, "s"), (101, "", None, "s"), (None, good, None, "s")]
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 0), (None, 1), (41, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, labels, "quality", lambda i: F.lit(True)).collect()}
    assert all((out[i].score > 0.5) == bool(i % 2) for i in range(60)) and 0 <= out[100].score <= 1 and out[100].score == out[101].score
    none = quality.classify(docs, labels.limit(0), "quality", lambda i: F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline as p

    rows = [(i, f"This is document number {i} about things and other things that matter, part {i * i}.\nAll rights of this page are reserved here.", "en", "ab"[i % 2]) for i in range(12)]
    rows += [(50, rows[3][1], "en", "a"), (51, None, "en", "a"), (52, "123", None, "b")]
    docs = _docs(spark, rows)
    for name, stage in p.STAGES[:-1]:
        was, docs = docs.columns, stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == was, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.where("doc_id IN (50, 51, 52)").count() == 0 and docs.where("text LIKE '%All rights%'").select("doc_id").distinct().count() <= 1
    packed = p.STAGES[-1][1](spark, docs, "").collect()
    assert all(r.length + r.offset <= 1024 for r in packed)
