"""Stored chunks: scan, lookup by ids, overwrite, upsert, and the lexical corpus as JSON lines.

A version of a table is a folder; a pointer file names the current one, so a reader sees a whole version or the one
before, also when executors are lost while the next is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The metadata that the lexical corpus carries, and bytes of a text there at most.
CORPUS_KEYS, CORPUS_BYTES = ("source_type", "source_path", "vendor", "eda", "layer_count", "copper_oz", "effective_date"), 8000
CORPUS = "id string, doc_id string, text string, metadata struct<source_type: string, source_path: string, vendor: string, eda: string, layer_count: int, copper_oz: double, effective_date: string>"


class Store:
    """A table of rows with an id, in versions below a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "chunk_id") -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _version(self) -> str | None:
        found = self.spark.read.text(f"{self.folder}/current").orderBy("value").collect() if self._exists("current") else []  # one row a version written
        return found[-1].value.split(" ", 1)[1] if found else None

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def overwrite(self, rows: DataFrame) -> None:
        name, n = f"v-{uuid.uuid4().hex}", 0
        rows.write.parquet(f"{self.folder}/{name}")
        if self._exists("current"):
            n = self.spark.read.text(f"{self.folder}/current").count()
        self.spark.createDataFrame([(f"{n:012d} {name}",)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/current")

    def upsert(self, rows: DataFrame) -> None:
        """New rows take the place of those with their ids; of new rows with one id, any one stays."""
        rows = rows.dropDuplicates([self.key])
        now = self._version()
        if now is not None:
            old = self.spark.read.parquet(f"{self.folder}/{now}")
            rows = old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True)
        self.overwrite(rows)

    def scan(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All rows with an id."""
        now = self._version()
        if now is None:
            raise FileNotFoundError(f"nothing is stored below {self.folder}")
        rows = self.spark.read.parquet(f"{self.folder}/{now}").where(F.col(self.key) != "")
        return rows if columns is None else rows.select(*columns)

    def lookup(self, ids: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of some ids (a column named as the key)."""
        return self.scan(columns).join(ids.select(self.key).distinct(), self.key, "left_semi")


def write_corpus(chunks: DataFrame, path: str) -> None:
    """The lexical corpus: chunks with text, cut to a size, with the metadata that filters know."""
    from tessera.functions.folds import truncated

    of = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast({"layer_count": "int", "copper_oz": "double"}.get(c, "string"))
    rows = chunks.where(F.trim("text") != "").select(F.col("chunk_id").alias("id"), "doc_id", truncated(F.col("text"), CORPUS_BYTES).alias("text"), F.struct(*(of(c).alias(c) for c in CORPUS_KEYS)).alias("metadata"))
    rows.write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path).where(F.trim("text") != "").select("id", "doc_id", "text", "metadata.*")
