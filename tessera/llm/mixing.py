"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size says how often each of its documents is taken on average: the whole part always, the
fraction as an inclusion probability. The flight phase of the cube method moves these probabilities within blocks of
one source through the null space of two constraints (the tokens taken and the documents taken), until at most two
or so per block are neither 0 nor 1; these are gathered in new blocks, level by level, until one block a source is
left. Two dozen units of a source's first block, a ladder of sizes from the longest down, never fly; the landing
gives them and what is left of the flight, of all their roundings, the one nearest to the totals: of tokens first,
of documents where it costs few tokens. Every draw is a hash of the row and the seed: reruns agree.

Cases: a null text has no words; a null source is a source of its own, ordered last; sources without words get the
target 0 and their documents are not taken; rows equal in id, source and size are decided together, as one unit of
their total size; an empty table gives an empty mix; further columns are kept by ``apply_mix``, whatever their names, and not
read; texts of any length are counted whole; roundings that are equally near: the first in order of size, then of draws.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import WORD, keep, settle, unused, written

#: Units that fly together.
BLOCK = 2048
#: Units that stay behind for the landing, and how many times smaller than the one before each is to be.
LANDING, STEP = 24, 1.4
_UNIT = "s long, doc_id long, source string, size long, m long, pi double, base long"


def shares(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets that share ``total`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    out, free = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}
    left = min(total, most * sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * unit > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else weights[i] * unit
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def _draw(seed: int, row: tuple) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *row)).encode(), digest_size=7).digest(), "big") / 2**56


def staying(sizes: list[float]) -> set[int]:
    """Places of the units (the longest first) that stay behind for the landing: a ladder of sizes, so that their
    roundings make up for any error."""
    left, out = list(range(len(sizes))), set()
    if len(sizes) <= LANDING + 2:
        return set(left)
    for j in range(LANDING):
        wanted = sizes[0] / STEP**j
        k = bisect.bisect_left(left, -wanted, key=lambda i: -sizes[i])
        if k == len(left) or k and abs(sizes[left[k - 1]] - wanted) <= abs(sizes[left[k]] - wanted):
            k -= 1
        out.add(left.pop(k))
    return out


def landed(pi: list[float], sizes: list[float]) -> list[float]:
    """The rounding of a few probabilities whose totals of tokens and of documents are nearest to theirs.

    The errors of both halves' roundings are listed, and each of one half meets those of the other that nearly undo it.
    """
    p, z, half = np.array(pi), np.array(sizes), len(pi) // 2
    one = z.mean() if z.size and z.any() else 1.0

    def roundings(p: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = ((np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1).astype(float)
        return ends, (ends - p) @ z, (ends - p).sum(axis=1)

    a, tokens_a, docs_a = roundings(p[:half], z[:half])
    b, tokens_b, docs_b = roundings(p[half:], z[half:])
    order = np.argsort(tokens_b, kind="stable")
    near = np.searchsorted(tokens_b[order], -tokens_a)[:, None] + np.arange(-32, 32)
    met = order[np.clip(near, 0, len(order) - 1)]
    cost = np.abs(tokens_a[:, None] + tokens_b[met]) / one + 0.02 * np.abs(docs_a[:, None] + docs_b[met])
    i, j = np.unravel_index(int(np.argmin(np.round(cost, 9))), cost.shape)
    return [*a[i].tolist(), *b[met[i, j]].tolist()]


def fly(pi: list[float], sizes: list[float], draws: list[float], land: bool, hold: bool = False) -> list[float]:
    """Cube method over units in the given order: the flight phase, and the landing too if ``land``. With ``hold`` the
    units for a later landing stay behind.

    The totals of ``pi * size`` and of ``pi`` stay as they are while three units are neither 0 nor 1.
    """
    p, open_, at, n = list(pi), [], 0, len(pi)
    eps = 1e-12
    behind = staying(sizes) if land or hold else set()

    def settled(i: int) -> bool:
        if p[i] < eps:
            p[i] = 0.0
        elif p[i] > 1 - eps:
            p[i] = 1.0
        return not 0.0 < p[i] < 1.0

    while True:
        while len(open_) < 3 and at < n:
            if at not in behind and not settled(at):
                open_.append(at)
            at += 1
        if len(open_) < 3:
            break
        a, b, c = open_
        v = {a: sizes[b] - sizes[c], b: sizes[c] - sizes[a], c: sizes[a] - sizes[b]}
        if not any(v.values()):  # all of one size
            v = {a: 1.0, b: -1.0, c: 0.0}
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in v.items() if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in v.items() if x)
        step = up if draws[a] * (up + down) < down else -down
        draws[a] = (draws[a] * 7919.123456789 + 0.618033988749895) % 1.0  # the next draw of this unit
        for i, x in v.items():
            p[i] += step * x
        was = open_
        open_ = [i for i in was if not settled(i)]
        if len(open_) == len(was):  # rounding left all inside: the nearest to an end is put there
            i = min(was, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = float(round(p[i]))
            open_.remove(i)
    if land:
        left = sorted([*open_, *(i for i in behind if not settled(i))])
        for i, x in zip(left, landed([p[i] for i in left], [sizes[i] for i in left]), strict=True):
            p[i] = x
    return p


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for each row of ``docs``.

    Sources in order of code points weigh ``weights``, repeating, and share ``total`` times all sizes; no target is
    above ``most`` times its source's size. Sources are collected as one row each: their number is a property of the
    collection, not of its documents.
    """
    spark = docs.sparkSession
    since = written(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    units = keep(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    found = sorted(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in found]
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(found))], total * sum(sizes), most)
    plan = [(i, r.source, r["size"], t, t / r["size"] if r["size"] else 0.0, r.n) for i, (r, t) in enumerate(zip(found, targets, strict=True))]
    sources = spark.createDataFrame(plan, "s long, source string, source_size long, target double, rate double, units long")

    bytes_of_plan = sum(100 + 4 * len(r[1] or "") for r in plan)

    def small(of_sources: DataFrame) -> DataFrame:
        return F.broadcast(of_sources) if bytes_of_plan <= common.BROADCAST_BYTES else of_sources

    def level(land_below: int, depth: int):
        def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(draw=[_draw(seed + 1000 * depth, (int(m), str(d), str(s), int(z))) for d, s, z, m in zip(pdf.doc_id, pdf.source, pdf["size"], pdf.m, strict=True)])
            pdf = pdf.assign(all=pdf["size"] * pdf.m).sort_values(["all", "draw", "doc_id"], ascending=[False, True, True], kind="stable")
            land = key[2] <= land_below
            pi = fly(pdf.pi.tolist(), [float(x) for x in pdf["all"]], pdf.draw.tolist(), bool(land), hold=key[1] == 0)
            return pdf.assign(pi=pi)[["s", "doc_id", "source", "size", "m", "pi", "base"]]

        return run

    rate = F.col("rate")
    joined = units.join(small(sources.select("s", F.col("source").alias("of"), "rate")), F.col("source").eqNullSafe(F.col("of")))
    state = joined.select("s", "doc_id", "source", "size", "m", (rate - F.floor(rate)).alias("pi"), F.floor(rate).cast("long").alias("base"))
    done, counts, depth = None, {r[0]: r[5] for r in plan}, 0
    while counts:
        blocks = spark.createDataFrame([(s, -(-n // BLOCK), n) for s, n in counts.items()], "s long, blocks long, n long")
        dealt = state.join(small(blocks), "s").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + depth), "doc_id", "size"), F.col("blocks")))
        # by block, or else a join by source would leave all blocks of a source in one task
        dealt = dealt.repartition("s", "block")
        flown = keep(dealt.groupBy("s", "block", "n").applyInPandas(level(BLOCK, depth), _UNIT), "flight")
        over = flown.where("pi <= 0 or pi >= 1")
        done = over if done is None else done.unionByName(over)
        state = flown.where("pi > 0 and pi < 1")
        counts = {r.s: r["count"] for r in state.groupBy("s").count().collect()}
        depth += 1
    if done is None:
        done = state.limit(0)
    taken = done.select("s", "doc_id", "source", "size", "m", (F.col("base") + F.col("pi").cast("long")).alias("copies"))
    taken = settle(taken, "mix", since)
    return taken.join(small(sources.select("s", "source_size", "target")), "s").withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).select("doc_id", "source", "size", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed table: each row of ``docs``, with all its columns, as often as the mix takes it."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    decided = mix(docs, **how).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.first("copies").alias("copies"))
    d, of, z, copies = unused(docs, "of", "from", "words", "copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(of)) & size.eqNullSafe(F.col(z))
    out = docs.join(decided.toDF(d, of, z, copies), same).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
