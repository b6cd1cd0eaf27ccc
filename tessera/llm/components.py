"""Connected components of links by alternating large and small stars; labels are the smallest ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import keep, settle, written


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` with ``m``, the least ``v`` of each ``u``. The least ones are summed up within tasks first and come by
    broadcast, or else from a stored table, so that the links of one hub need not meet in one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(F.broadcast(least) if 16 * rows <= common.BROADCAST_BYTES else keep(least, "least"), "u")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that has a link; ``links``: ``u, v`` long, in any direction.

    A round hangs the larger neighbours of each node, then its smaller ones, on the smallest of them; the number of
    links never grows, and a logarithmic number of rounds suffices. Each round is stored, so lineage stays short.
    """
    since = written(links.sparkSession)
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, was = keep(edges, "links"), None
    while True:
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r.n, r.h) == was:
            break
        was = (r.n, r.h)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * r.n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = keep(large.where("u <> v").distinct(), "hung")
        # u itself and its smaller neighbours hang on the smallest of them
        met = _with_least(small, 2 * r.n)
        hung = met.select("u", F.col("m").alias("v")).unionByName(met.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = keep(hung.where("u <> v").distinct(), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return settle(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", since)
