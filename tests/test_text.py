"""Text quality, cleaning, decoding and layout against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import folds, metadata, text

TEXTS = [None, "", "   ", "plain words", "中文文本 with PCB", "x" * 60, "Ã©Ã¨Ãª " * 20, "a\x00b�c", "  keep\n\n\n\n\nthis\t\tline  ", "emoji 😀 and 汉字", "1 范围\n正文"]


def test_measures_agree_with_the_rules_for_one_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    rows = df.select("i", text.quality_score(t, of_visible=False).alias("all"), text.quality_score(t).alias("seen")).collect()
    for r in rows:
        if TEXTS[r.i] is None:
            assert r["all"] is None
        else:
            assert r["all"] == pytest.approx(folds.quality(TEXTS[r.i]))
            assert r["seen"] == pytest.approx(folds.quality(TEXTS[r.i], of_visible=True))


def test_clean_text(spark):
    cleaned = {r.t: r.c for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", text.clean_text(F.col("t")).alias("c")).collect()}
    assert cleaned[None] is None and cleaned[""] == "" and cleaned["   "] == ""
    assert cleaned["a\x00b�c"] == "abc"
    assert cleaned["  keep\n\n\n\n\nthis\t\tline  "] == "keep\n\nthis line"
    assert cleaned["emoji 😀 and 汉字"] == "emoji and 汉字"


def test_cleaning_makes_each_step_once(spark):
    texts = ["a\t b", "a \t", " \t\t ", "x  y   z", "\n\n\n\n", "a\n\n\nb \n", "IJK Ĵ ӡ\x7f", "a\u2028 \u0085b\u00a0", "\x1c\x1f x", None]
    cleaned = text.clean_text(F.col("t")).alias("c")
    made = {r.t: r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", cleaned).collect()}
    assert list(map(made.get, texts)) == ["a b", "a", "", "x y z", "", "a\n\nb", "K Ĵ \x7f".replace("Ĵ ", ""), "a\u2028 \u0085b", "x", None]
    plan = spark.createDataFrame([("a",)], "t string").select(cleaned)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t#") == 1  # a step's text is not made again for each of its uses


def test_decoding_finds_the_table():
    chinese = "印制板的尺寸和厚度应符合标准要求。" * 5
    assert folds.decode(chinese.encode("gbk")) == (chinese, "gbk")
    assert folds.decode(chinese.encode()) == (chinese, "utf-8")
    assert folds.detect(b"\xef\xbb\xbfabc") == "utf-8-sig"
    assert folds.detect(b"\xff\xfea\x00") == "utf-16-le"
    assert folds.decode(b"")[0] == ""
    wrong = chinese.encode().decode("latin1")
    score, again, way = folds.repair(wrong)
    assert again == chinese and way == "mojibake:latin1->utf-8" and score < 0


def test_layout_rules():
    rows = "a | b | c\nd | e | f\ng | h | i\ntext"
    assert folds.flatten_rows(rows) == "a | b | c\n\nd | e | f\n\ng | h | i\n\ntext"
    assert folds.flatten_rows("a | b | c\nd | e | f\ntext") == "a | b | c\nd | e | f\ntext"
    said = folds.anchor_figures("见图 3-1\n\n第一行\n第二行\n2.1 标题\n第三行")
    assert said.split("\n")[1] == "锚点：第一行 第二行"
    assert folds.anchor_figures(said) == said
    long = "图 1-2 " + "x" * 80 + "\n后文"
    assert folds.anchor_figures(long) == long


def test_byte_budgets():
    assert folds.cut_bytes("汉字汉字", 7) == "汉字"
    assert folds.cut_bytes("abcdef", 5, "..") == "abc.."
    assert "".join(folds.byte_pieces("汉字a" * 9, 8)) == "汉字a" * 9
    pieces = folds.budget_pieces("one two. three four.\n\nfive\n\n" + "汉" * 30, 20)
    assert all(len(p.encode()) <= 20 for p in pieces) and "".join(pieces).count("汉") == 30


def test_path_stem_and_dates(spark):
    paths = ["a/b/GBT4588.4-2017.pdf", "x.tar.gz", ".hidden", "plain", "a/", "/标准/国家标准/x 2020-1-5.pdf", "jlcpcb/4层 1oz 20201332.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.path_stem(F.col("p")).alias("s"), metadata.path_metadata(F.col("p")).alias("m")).collect()
    assert [r.s for r in rows[:5]] == ["GBT4588.4-2017", "x.tar", ".hidden", "plain", "a"]
    assert rows[5].m.source_type == "standard_national" and rows[5].m.effective_date == "2020-01-05"
    assert (rows[6].m.vendor, rows[6].m.layer_count, rows[6].m.copper_oz, rows[6].m.effective_date) == ("JLCPCB", 4, 1.0, None)


def test_types_entities_sections(spark):
    texts = ["见 GB/T 4588.4-2017 与 IPC-A-600G 与 GB/T 4588.4-2017", "半固化片与铜箔", "nothing here", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(metadata.document_type(F.col("t")).alias("k"), metadata.entities(F.col("t")).alias("e")).collect()
    assert [r.k for r in rows[:4]] == ["national_standard", "material_spec", "general", "general"]
    assert rows[0].e["standard_gb"] == ["GB/T 4588.4-2017"] and rows[0].e["standard_ipc"] == ["IPC-A-600G"]
    at = spark.createDataFrame([("1.2 一般要求\n正文",), ("1.1.1 细则\n",), ("x",)], "t string").select(metadata.section(F.col("t")).alias("s")).collect()
    assert [tuple(r.s) for r in at] == [("1.2 一般要求", ""), ("", "1.1.1 细则"), ("", "")]
