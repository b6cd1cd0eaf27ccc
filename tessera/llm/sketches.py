"""MinHash near-dedup by bottom-k sketches from one hash function.

Texts of one shingle set are one class, which its smallest id stands for. A class keeps the ``K`` smallest hashes of
its set. Runs of ``RUN`` neighbouring retained values are the keys of inverted lists; classes in a list of two or more
are candidates. Where all of a set is retained, two sets of a similarity of 0.8 or more always share such a run (a
union of six or more of which at most a fifth differs has ``RUN`` shared neighbours; sets of five or fewer have keys
of two values too); where it is not, they fail to with a probability below 1e-9. Single values would make lists of
all texts with a common passage; runs do not.

The classes of all lists with the same first class are a group, which meets in one task with its full sets (large
groups: in several). There, pivots are compared with all others outside their component: the union of two sketches
estimates the similarity and filters, the exact similarity of the full sets decides. No pairs leave a task, only
links that join components.

Cases: texts that are null or have no words have empty sets and are linked with nothing; fewer words than a shingle
make one shingle; whole texts are read; copies and repeated rows are one class; rows with a null id are linked with
nothing, have no component and are kept; the table may be empty; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep, settle, shuffle_width, small, unused, written
from tessera.llm.components import components
from tessera.llm.encoding import drop_encoder
from tessera.llm.shingles import _mix, shingles

K, RUN = 64, 3
#: An estimate this far below the threshold rules a pair out: six standard deviations of a sketch of K.
MARGIN = 6 * (0.25 / K) ** 0.5
#: Shingles that a task takes at a time from one group; larger groups are dealt to several tasks.
GROUP_SHINGLES = 4_000_000


def run_keys(sketch: np.ndarray) -> np.ndarray:
    """Hashes of the runs of neighbouring retained values, as signed integers."""
    found = []
    for run in (2, RUN) if sketch.size <= 5 else (RUN,):
        n = max(0, sketch.size - run + 1)
        h = sketch[:n].copy()
        for j in range(1, run):
            h = _mix(h * np.uint64(31) + sketch[j : j + n])
        found.append(h)
    return np.unique(np.concatenate(found)).view(np.int64)


def link_group(sets: list[np.ndarray], num: int, den: int, pivots: list[int] | None = None, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all components of the sets: ``den * |A & B| >= num * |A | B|``.

    Without ``pivots``, every pair across components is compared: a set is a pivot until all sets outside the largest
    component have been one. With ``pivots``, only pairs with one of them. ``joined`` gives known components.
    """
    m = len(sets)
    size = np.array([s.size for s in sets])
    values, cols = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    short = np.minimum(size, K)
    s_start = np.concatenate([[0], np.cumsum(short)])
    s_cols = cols[np.repeat(start[:-1] - s_start[:-1], short) + np.arange(s_start[-1])]
    s_last = s_cols[s_start[1:] - 1]
    comp = np.array(joined if joined is not None else np.arange(m))
    done = np.zeros(m, bool)
    popular = np.add.reduceat(np.bincount(cols, minlength=values.size)[cols], start[:-1]) / size
    order = np.argsort(-popular, kind="stable") if pivots is None else np.array(pivots, np.int64)
    floor, links = num / den - MARGIN, []
    mark = np.zeros(values.size, bool)

    def pivot(p: int) -> None:
        done[p] = True
        near = np.flatnonzero((comp != comp[p]) & (den * np.minimum(size, size[p]) >= num * np.maximum(size, size[p])))
        if not near.size:
            return
        own = s_cols[s_start[p] : s_start[p + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[s_cols], s_start[:-1], dtype=np.int64)[near]
        mark[own] = False
        # the union's sketch: values up to the last that both have seen; sets that are retained whole have seen all
        seen = np.minimum(np.where(size[near] > K, s_last[near], values.size), own[-1] if size[p] > K else values.size)
        below = np.searchsorted(own, seen, "right")
        theirs = np.where(s_last[near] <= seen, short[near], 0)
        for k in np.flatnonzero(s_last[near] > seen):
            j = near[k]
            theirs[k] = np.searchsorted(s_cols[s_start[j] : s_start[j + 1]], seen[k], "right")
        near = near[shared >= floor * (below + theirs - shared)]
        full = cols[start[p] : start[p + 1]]
        mark[full] = True
        for j in near:
            if comp[j] != comp[p]:
                inter = int(np.count_nonzero(mark[cols[start[j] : start[j + 1]]]))
                if den * inter >= num * (int(size[p] + size[j]) - inter):
                    links.append((p, int(j)))
                    comp[comp == comp[j]] = comp[p]
        mark[full] = False

    if pivots is not None:
        for p in order:
            pivot(int(p))
        return links
    while True:
        names, counts = np.unique(comp, return_counts=True)
        left = order[~done[order] & (comp[order] != names[counts.argmax()])] if done.any() else order[:1]
        if not left.size:
            return links
        largest = names[counts.argmax()]
        for p in left:
            if comp[p] != largest or not done.any():
                pivot(int(p))


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_id, keys`` of every row; ``set_id`` is equal for equal sets and null for empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoder()
        for b in batches:
            n, names, keys = [], [], []
            for text in b.column(1):
                s = shingles(text.as_py())
                n.append(s.size)
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None)
                keys.append(run_keys(s[:K]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "set_id", "keys"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, set_id binary, keys array<long>")


def _linker(num: int, den: int):
    """Rows sorted by ``anchor, part`` with ``doc, pivot, joined, text`` to the links of each group's part."""

    def close(docs: list[int], sets: list[np.ndarray], pivots: list[int], joined: list[int]) -> pa.RecordBatch:
        if len(docs) < 2:
            found = []
        elif pivots:
            found = link_group(sets, num, den, pivots, joined)
        else:
            found = link_group(sets, num, den)
        return pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in found], pa.int64()), pa.array([docs[j] for _, j in found], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        docs: list[int] = []
        sets: list[np.ndarray] = []
        pivots: list[int] = []
        joined: list[int] = []
        for b in batches:
            names = zip(*(b.column(k).to_pylist() for k in ("anchor", "part", "doc", "pivot", "joined")), strict=True)
            for (anchor, part, doc, pivot, comp), data in zip(names, b.column("s"), strict=True):
                if (anchor, part) != at:
                    if len(docs) > 1:
                        yield close(docs, sets, pivots, joined)
                    at, docs, sets, pivots, joined = (anchor, part), [], [], [], []
                if pivot:
                    pivots.append(len(docs))
                docs.append(doc)
                joined.append(comp)
                sets.append(np.frombuffer(data.as_py(), np.uint64))
        if len(docs) > 1:
            yield close(docs, sets, pivots, joined)

    return run


def _with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (``doc`` and an array ``at`` of places) with the set of each text, one row for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["doc", "at", "s"])

    kind = members.schema["at"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    # always by shuffle, so that the plan is the same at every size
    one = members.hint("merge").join(texts, "doc").select("doc", "at", "text").mapInArrow(run, f"doc long, at {kind}, s binary")
    return one.select("doc", "s", F.explode("at").alias("at")).select("doc", "s", "at.*")


def link_texts(docs: DataFrame, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Sketched rows (``doc_id, n, set_id``) and the links (``u, v``: smallest ids of classes) that join components."""
    if 100 * num < 80 * den:
        raise ValueError("runs of retained values find pairs of a similarity of 0.8 or more only")
    sketched = keep(sketch(docs), "sketches")
    width = shuffle_width(docs.sparkSession)
    classes = sketched.where("doc_id is not null and set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    known = sketched.where("set_id is not null").select("doc_id", "n", "set_id", "keys").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    postings = known.select(F.col("doc_id").alias("doc"), "n", F.explode("keys").alias("key"))
    by_key = Window.partitionBy("key")
    listed = postings.withColumn("anchor", F.min("doc").over(by_key)).withColumn("listed", F.count("*").over(by_key)).where("listed > 1")
    groups = keep(listed.select("anchor", "doc", "n").distinct(), "groups")
    parts = groups.groupBy("anchor").agg(F.sum("n").alias("all")).select("anchor", F.ceil(F.col("all") / GROUP_SHINGLES).cast("int").alias("parts"))
    dealt = groups.join(small(keep(parts, "parts"), 12), "anchor")
    whole = F.when(F.col("doc") == F.col("anchor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.hash("doc"), F.col("parts"))))
    placed = dealt.withColumn("part", F.explode(whole))
    columns = ["anchor", "part", "pivot", "joined"]
    members = placed.select("doc", F.struct("anchor", "part", F.lit(False).alias("pivot"), F.lit(0).cast("long").alias("joined")).alias("at")).groupBy("doc").agg(F.collect_list("at").alias("at"))  # at most K lists

    def met(rows: DataFrame) -> DataFrame:
        together = _with_sets(docs, rows).select(*columns, "doc", "s").repartition(width, "anchor", "part").sortWithinPartitions("anchor", "part", "doc")
        return keep(together.mapInArrow(_linker(num, den), "u long, v long"), "met")

    links = met(members)
    if dealt.where("parts > 1").limit(1).count():
        # of a group in several parts, what is outside its first class's component meets every part
        of = components(links).withColumnRenamed("node", "doc")
        large = placed.where("parts > 1").join(of, "doc", "left").withColumn("joined", F.coalesce("component", "doc")).drop("component")
        main = keep(large.where("doc = anchor").select("anchor", F.col("joined").alias("main")).distinct(), "main")
        large = large.join(small(main, 16), "anchor").withColumn("pivot", F.col("joined") != F.col("main"))
        every = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
        rows = large.withColumn("part", F.explode(every)).select("doc", F.struct(*columns).alias("at")).distinct().groupBy("doc").agg(F.collect_list("at").alias("at"))
        links = links.unionByName(met(rows))
    return sketched, links


def _decide(sketched: DataFrame, links: DataFrame) -> DataFrame:
    classes = sketched.where("doc_id is not null and set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    of = components(links)
    classes = classes.join(of, classes.rep == of.node, "left").select("set_id", F.coalesce("component", "rep").alias("class_component"))
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(classes, "set_id", "left")
    alone = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("class_component", "doc_id"))
    return rows.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row. ``num / den`` is 0.8 at least."""
    since = written(docs.sparkSession)
    return settle(_decide(*link_texts(docs, num, den)), "near-duplicates", since)


def drop_near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` of which each group of near duplicates keeps one: that of its smallest id. Rows that
    repeat an id and its text are copies too."""
    since = written(docs.sparkSession)
    sketched, links = link_texts(docs, num, den)
    name, copies = unused(docs, "gone", "copies")
    decided = _decide(sketched, links).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(copies), F.bool_and("kept").alias("kept"))
    noted = settle(decided.where(~F.col("kept") | (F.col(copies) > 1)).select(F.col("doc_id").alias(name), "kept", copies), "gone", since)
    same = F.col("doc_id").cast("long") == F.col(name)
    left = docs.join(small(noted.where("not kept").select(name), 8), same, "left_anti")
    again = noted.where("kept").select(name)
    if not again.limit(1).count():
        return left
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
