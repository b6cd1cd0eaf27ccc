"""Raw files as documents, and the batch that repairs text files.

Files are read by Spark, whatever store they lie in; nothing is written in place. Extractors turn bytes to texts by
suffix; a format whose library is missing gives a null text and says why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import folds
from tessera.functions.text import clean_text, garbage_ratio, needs_repair, quality_score
from tessera.operators.chunking import line_sections

Extractor = Callable[[bytes], str]


def _pdf(data: bytes) -> str:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def _docx(data: bytes) -> str:
    import io
    import zipfile
    from xml.etree import ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def _rtf(data: bytes) -> str:
    import re

    text = data.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\par[d]?\b ?", "\n", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text).strip()


EXTRACTORS: dict[str, Extractor] = {"pdf": _pdf, "docx": _docx, "doc": _rtf, "rtf": _rtf, **dict.fromkeys(("txt", "md", "text"), lambda data: folds.decode(data)[0])}


def read_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """``path, content, length, modificationTime`` of all files below a folder, with the wanted suffixes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows if suffixes is None else rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def documents(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """``doc_id, source_path, text, error`` of files; the id follows from the path."""
    by_suffix = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for path, data in zip(b["path"], b["content"], strict=True):
                text, error = None, None
                try:
                    text = by_suffix[path.rsplit(".", 1)[-1].lower()](data)
                except Exception as e:  # a file that can't be read is a row that says so
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"source_path": b["path"], "text": texts, "error": errors})

    made = files.select("path", "content").mapInPandas(run, "source_path string, text string, error string")
    return made.select(F.md5("source_path").alias("doc_id"), "source_path", "text", "error")


def n_sections(text: Column) -> Column:
    """How many lines of a text are headings, tables' or figures' lines."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else len(line_sections(t)) for t in s], dtype="Int32")

    return run(text)


def preprocess(files: DataFrame) -> DataFrame:
    """The batch's report with the texts: ``input, original_encoding, garbage_ratio_before, garbage_ratio_after,
    sections_found, status, text``. ``skip``: good already, or no better when cleaned; its text is the original."""
    got = files.select(F.col("path").alias("input"), folds.decoded(F.col("content"), least_chinese=0.1, with_gb2312=True).alias("d"))
    rows = got.select("input", F.col("d.encoding").alias("original_encoding"), F.col("d.text").alias("raw"))
    raw = F.col("raw")
    good = (F.col("original_encoding") == "utf-8") & (quality_score(raw, of_visible=False) < 0.05) & ~needs_repair(raw)
    rows = rows.withColumns({"cleaned": clean_text(raw, strict=True), "garbage_ratio_before": garbage_ratio(raw, of_visible=False), "good": good})
    rows = rows.withColumn("garbage_ratio_after", F.when(F.col("good"), 0.0).otherwise(garbage_ratio(F.col("cleaned"), of_visible=False)))
    skip = F.col("good") | (F.col("garbage_ratio_after") > F.col("garbage_ratio_before") + 0.01)
    return rows.select(
        "input", "original_encoding", "garbage_ratio_before", "garbage_ratio_after", F.when(F.col("good"), 0).otherwise(n_sections(F.col("cleaned"))).alias("sections_found"),
        F.when(raw.isNull(), "error").when(skip, "skip").otherwise("success").alias("status"), F.when(skip, raw).otherwise(F.col("cleaned")).alias("text"),
    )


def summary(report: DataFrame) -> DataFrame:
    """``original_encoding, files, ok, skipped, failed``."""
    n = lambda s: F.sum((F.col("status") == s).cast("int")).alias
    return report.groupBy("original_encoding").agg(F.count("*").alias("files"), n("success")("ok"), n("skip")("skipped"), n("error")("failed"))


def fix_encodings(files: DataFrame) -> DataFrame:
    """``path, text, encoding`` of the files that are not UTF-8 and read well once decoded."""
    got = files.select("path", folds.decoded(F.col("content")).alias("d")).select("path", "d.text", "d.encoding")
    return got.where((F.col("encoding") != "utf-8") & (garbage_ratio(F.col("text")) < 0.3))
