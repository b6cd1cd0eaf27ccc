"""Shared pieces of the pipeline operators: tables, scratch space, stable partition order."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a table that is broadcast, at most.
BROADCAST_BYTES = 32 << 20
#: Scratch tables that this thread has written and not yet released, by application.
_local = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, whose executors are the driver, may go
    without; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _tables(spark: SparkSession) -> list[str]:
    by_application = _local.__dict__.setdefault("written", {})
    return by_application.setdefault(spark.sparkContext.applicationId, [])


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many scratch tables this thread holds: where an operator starts, see ``settle``."""
    return len(_tables(spark))


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes this thread's scratch tables, for results that have been stored elsewhere."""
    held, jvm = _tables(spark), spark.sparkContext._jvm
    for path in held[since:until]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del held[since:until]


def settle(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` as a table in the shared folder; the scratch tables written from ``since`` on, from which it was made,
    are deleted. An operator so leaves one table, which its lazy result reads, until ``release``."""
    out = keep(df, name)
    release(df.sparkSession, since, -1)
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, marked for broadcast if all its rows, at ``row_bytes`` at most and what a hash table takes for
    each, stay within ``BROADCAST_BYTES``; a larger one is left to a join by shuffle."""
    return F.broadcast(df) if df.count() * (row_bytes + 48) <= BROADCAST_BYTES else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that are held out of every training: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(in_fold(doc_id), F.lit(False))
