"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Cosine at or above a threshold is a bounded distance between unit vectors, so a metric tree finds all such pairs.
Equal vectors of a label are one class first. A label with many classes is dealt to cells, level by level: the classes
of a cell go to the nearest of its pivots (an evenly hashed choice of some ``FAN`` of them), until a cell has at most
``CELL``. A class also visits, as a guest, every cell that may hold a partner: those whose border with its nearest
pivot's cell is no further away than the threshold's distance. A cell that pivots do not take apart (its children are
nearly as large as itself, or guests multiply) is dealt in blocks, each of which meets each other, so that no task
holds more than two blocks, however dense the vectors lie. In a cell, cover trees (nested levels with
halving radii) of the cell's classes and of its guests are traversed together: a pair of nodes is dropped when their
covering radii cannot bring them within the distance, counted whole when these cannot take them out of it, and
compared in double precision at the leaves. A cell returns a count for each class and links that join its components,
never pairs.

Cases: vectors that are null or empty, have a null or non-finite component or only zeros, or a null label link with
nothing; vectors of unlike length do not link; ties between pivots go to the first by id; repeated rows are other vectors at the same place; rows with a null id
link with nothing, have no component and are kept; the table may be empty; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, settle, shuffle_width, small, written
from tessera.llm.components import components

LEAF, SLACK = 32, 1e-6
#: Classes that a cell is to hold, pivots of a larger one, and bytes of the pivots that are broadcast at a time.
CELL, FAN, PIVOT_BYTES = 8192, 16, 32 << 20
#: A cell is not taken apart if a child keeps this part of it, or if one in ``SAMPLE`` of its rows, dealt for a test,
#: become so many times more. Either way all pairs are met.
STUCK, CROWDED, SAMPLE = 0.9, 3, 16
#: Distances computed at a time.
BLOCK = 1 << 21


class Node:
    """A centre, all that it covers, the exact covering radius, and the nodes of the next level (None at a leaf)."""

    __slots__ = ("centre", "kids", "members", "radius")

    def __init__(self, x: np.ndarray, members: np.ndarray, centre: int) -> None:
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[members] @ x[centre])))
        self.centre, self.members, self.radius, self.kids = centre, members, float(apart.max()), None
        if len(members) <= LEAF or self.radius < SLACK:
            return
        half = 2.0 ** (math.ceil(math.log2(self.radius)) - 1)
        self.kids, rest, at = [], members, centre
        near = apart <= half
        while True:
            self.kids.append(Node(x, rest[near], at))
            rest = rest[~near]
            if not rest.size:
                return
            at = int(rest[0])
            near = 2.0 - 2.0 * (x[rest] @ x[at]) <= half * half
            near[0] = True


class Cell:
    """Counts and joining links of classes (the first ``own`` rows) among all rows, or only among the others."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, own: int, cosine: float, within: bool = True) -> None:
        self.raw, self.norm, self.sizes, self.cosine = raw, np.sqrt((raw * raw).sum(axis=1)), sizes, cosine
        self.x = raw / self.norm[:, None]
        self.far = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
        self.counts = np.zeros(len(raw), np.int64)
        self.parent = list(range(len(raw)))
        self.links: list[tuple[int, int]] = []
        if not own:
            return
        tree = Node(self.x, np.arange(own), 0)
        if within:
            self._traverse([(tree, None)])
        if own < len(raw):
            self._traverse([(tree, Node(self.x, np.arange(own, len(raw)), own))])

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _join(self, i: int, j: int) -> None:
        a, b = self._root(i), self._root(j)
        if a != b:
            self.parent[b] = a
            self.links.append((i, j))

    def _all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every member of one node links with every one of the other."""
        self.counts[a] += self.sizes[b].sum()
        self.counts[b] += self.sizes[a].sum()
        for i in a[1:]:
            self._join(int(i), int(b[0]))
        for j in b:
            self._join(int(a[0]), int(j))

    def _exact(self, a: np.ndarray, b: np.ndarray | None) -> None:
        own = b is None
        b = a if own else b
        step = max(1, BLOCK // len(b))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            linked = (self.raw[part] @ self.raw[b].T) / (self.norm[part][:, None] * self.norm[b][None, :]) >= self.cosine
            if own:
                linked[np.arange(len(part)), np.arange(at, at + len(part))] = False
            self.counts[part] += linked @ self.sizes[b]
            if not own:
                self.counts[b] += self.sizes[part] @ linked
            for i, j in zip(*np.nonzero(linked), strict=True):
                self._join(int(part[i]), int(b[j]))

    def _traverse(self, pairs: list[tuple[Node, Node | None]]) -> None:
        """``(p, None)``: the pairs within p."""
        while pairs:
            p, q = pairs.pop()
            if q is None:
                if p.kids is None:
                    if 2 * p.radius <= self.far - SLACK and len(p.members) > LEAF:
                        self.counts[p.members] += self.sizes[p.members].sum() - self.sizes[p.members]
                        for i in p.members[1:]:
                            self._join(int(p.members[0]), int(i))
                    else:
                        self._exact(p.members, None)
                    continue
                pairs += [(k, None) for k in p.kids if len(k.members) > 1]
                self._meet(p.kids, p.kids, True, pairs)
            elif p.kids is None and q.kids is None:
                self._meet([p], [q], False, pairs)
            else:
                self._meet(p.kids or [p], q.kids or [q], False, pairs)

    def _meet(self, ps: list[Node], qs: list[Node], same: bool, pairs: list) -> None:
        at_p, at_q = np.array([n.centre for n in ps]), np.array([n.centre for n in qs])
        r_p, r_q = np.array([n.radius for n in ps]), np.array([n.radius for n in qs])
        xq, step = self.x[at_q], max(1, BLOCK // len(qs))
        for first in range(0, len(ps), step):
            rows = slice(first, first + step)
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x[at_p[rows]] @ xq.T)))
            for i, j in zip(*np.nonzero(d <= r_p[rows][:, None] + r_q[None, :] + self.far + SLACK), strict=True):
                if same and j <= i + first:
                    continue
                p, q = ps[i + first], qs[j]
                if d[i, j] + p.radius + q.radius <= self.far - SLACK:
                    self._all(p.members, q.members)
                elif p.kids is None and q.kids is None:
                    self._exact(p.members, q.members)
                else:
                    pairs.append((p, q))


def _usable(v: Column) -> Column:
    """A vector with a direction."""
    number = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, number) & F.exists(v, lambda y: y != 0), F.lit(False))


#: What a row is to its cell: a guest, one whose pairs within the cell are met elsewhere, one whose pairs are all met.
GUEST, APART, OWN = 0, 1, 2
_CELL = ["label", "dim", "cell"]


def _dealt(of: DataFrame, rows: DataFrame, level: int, far: float) -> DataFrame:
    """Rows of a chunk of cells to the cells of their pivots, with ``parent``; ``first`` marks one place of each row.
    The pivots are chosen among all rows of the chunk, ``of``."""
    chosen = of.where(F.col("role") == OWN).where(F.pmod(F.xxhash64("rep", F.lit(level)), F.greatest(F.ceil(F.col("size") / FAN), F.lit(1))) == 0)
    pivots: dict[tuple, np.ndarray] = {}
    for r in chosen.groupBy(*_CELL).agg(F.array_sort(F.collect_list(F.struct("rep", "v"))).alias("p")).collect():  # PIVOT_BYTES or so: some FAN a cell
        x = np.array([p.v for p in r.p], float)
        pivots[r.label, r.dim, r.cell] = x / np.sqrt((x * x).sum(axis=1))[:, None]
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between: dict[tuple, np.ndarray] = {}
        for b in batches:
            at, cells, roles, first = [], [], [], []
            names = zip(*(b.column(k).to_pylist() for k in (*_CELL, "role")), strict=True)
            for k, ((label, dim, cell, role), v) in enumerate(zip(names, b.column("v"), strict=True)):
                p = shared.value.get((label, dim, cell))
                places, home = [0], 0
                if p is not None:
                    x = np.array(v.as_py(), float)
                    d2 = 2 - 2 * (p @ (x / math.sqrt(x @ x)))
                    home = int(d2.argmin())
                    key = (label, dim, cell, home)
                    if key not in between:
                        if len(between) > 4096:
                            between.clear()
                        between[key] = np.sqrt(np.maximum(0.0, 2 - 2 * (p @ p[home])))
                    places = np.flatnonzero(d2 - d2[home] <= 2 * between[key] * (far + SLACK) + SLACK).tolist()
                at += [k] * len(places)
                cells += [f"{cell}/{place}" for place in places]
                roles += [OWN if role == OWN and place == home else GUEST for place in places]
                first += [place == places[0] for place in places]
            out = b.take(pa.array(at, pa.int64()))
            kept = [out.column(k) for k in ("label", "dim", "v", "rep", "m")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cells, pa.string()), pa.array(roles, pa.int32()), pa.array(first, pa.bool_()), out.column("cell"), out.column("size")], names=["label", "dim", "v", "rep", "m", "cell", "role", "first", "parent", "size"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select(*_CELL, "v", "rep", "m", "role", "size").mapInArrow(run, f"label {kind}, dim int, v array<double>, rep long, m long, cell string, role int, first boolean, parent string, size long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of cells that stay large, each cell's classes in blocks: one that a block meets itself in, and one for each
    other block, whose guests it also meets."""
    parts = F.ceil(F.col("size") / CELL).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(-1)), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    spot = lambda i, j, role: F.struct(F.concat_ws("#", F.col("cell"), i, j).alias("cell"), role.cast("int").alias("role"))
    own, part = F.col("role") == OWN, F.col("part")
    as_own = F.transform(F.filter(every, lambda j: own), lambda j: spot(part, j, F.when(j == part, OWN).otherwise(APART)))
    as_guest = F.transform(F.filter(every, lambda i: ~own | (i != part)), lambda i: spot(i, part, F.lit(GUEST)))
    out = dealt.withColumn("at", F.explode(F.concat(as_own, as_guest)))
    return out.select("label", "dim", "v", "rep", "m", "at.cell", "at.role")


def cells(classes: DataFrame, far: float) -> DataFrame:
    """``label, dim, v, rep, m, cell, role`` of all classes in cells of at most ``CELL`` (and guests)."""
    columns, key = ["label", "dim", "v", "rep", "m", "cell", "role"], F.col("role") == OWN
    rows, ready, level = classes.select("label", "dim", "v", "rep", "m", F.lit("").alias("cell"), F.lit(OWN).alias("role")), [], 0
    while True:
        sizes = rows.where(key).groupBy(*_CELL).agg(F.count("*").alias("size"))
        if level:  # of the parents: their sizes, and whether their guests were too many
            was = rows.groupBy(*_CELL).agg(F.first("size").alias("was"))
            sizes = sizes.join(was, _CELL)
        sizes = keep(sizes.where(F.col("size") > CELL), "sizes")
        marked = rows.drop("size").join(small(sizes, 200), _CELL, "left")
        ready.append(marked.where("size is null").select(*columns))
        if level:
            ready.append(_blocks(marked.where(F.col("size") >= STUCK * F.col("was"))))
            marked = marked.where(F.col("size") < STUCK * F.col("was"))
            sizes = sizes.where(F.col("size") < STUCK * F.col("was"))
        total = sizes.agg(F.sum(F.lit(FAN * 8) * F.col("dim")).alias("b")).first().b
        if not total:
            return reduce(DataFrame.unionByName, ready)
        chunks = int(-(-total // PIVOT_BYTES))
        open_ = keep(marked.where("size is not null").select(*columns, "size").withColumn("chunk", F.pmod(F.xxhash64(*_CELL), F.lit(chunks))), "open")
        parts = [open_.where(F.col("chunk") == chunk) for chunk in range(chunks)]
        tried = [_dealt(p, p.where(F.pmod(F.xxhash64("rep", F.lit(-2)), F.lit(SAMPLE)) == 0), level, far) for p in parts]
        grown = reduce(DataFrame.unionByName, tried).groupBy("label", "dim", F.col("parent").alias("cell")).agg(F.count("*").alias("out"), F.sum(F.col("first").cast("int")).alias("in"))
        crowded = small(keep(grown.where(F.col("out") > CROWDED * F.col("in")).select(*_CELL), "crowded"), 200)
        ready.append(_blocks(open_.join(crowded, _CELL, "left_semi")))
        dealt = [_dealt(p, p.join(crowded, _CELL, "left_anti"), level, far) for p in parts]
        rows, level = keep(reduce(DataFrame.unionByName, dealt).select(*columns, "size"), "dealt"), level + 1


def link_vectors(vectors: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (``label, v, rep, m``), counts (``rep, n``: vectors of other classes linked) and links (``u, v``)."""
    spark, far = vectors.sparkSession, math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))
    classes = keep(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes").withColumn("dim", F.size("v"))

    def close(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[3] == GUEST)
        own = sum(r[3] != GUEST for r in rows)
        c = Cell(np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], np.int64), own, cosine, any(r[3] == OWN for r in rows))
        u = [r[1] for r in rows[:own]] + [rows[i][1] for i, _ in c.links]
        v = [None] * own + [rows[j][1] for _, j in c.links]
        n = c.counts[:own].tolist() + [None] * len(c.links)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for label, dim, cell, *r in zip(*(b.column(k).to_pylist() for k in (*_CELL, "v", "rep", "m", "role")), strict=True):
                if (label, dim, cell) != at:
                    if rows:
                        yield close(rows)
                    at, rows = (label, dim, cell), []
                rows.append(tuple(r))
        if rows:
            yield close(rows)

    placed = cells(classes, far).repartition(shuffle_width(spark), *_CELL).sortWithinPartitions(*_CELL, "rep")
    met = keep(placed.mapInArrow(run, "u long, v long, n long"), "met")
    return classes.drop("dim"), met.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n")), met.where("v is not null").select("u", "v")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector; only vectors of one label link."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    since = written(embeddings.sparkSession)
    classes, counts, links = link_vectors(rows, cosine)
    of = components(links)
    known = classes.join(counts, "rep", "left").join(of, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = settle(known, "linked-vectors", since)
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")) & F.col("vec_id").isNotNull(), "left")
    alone = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("vec_id") == alone, F.lit(True)).alias("kept"))
