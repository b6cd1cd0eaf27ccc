"""Best-fit packing by large-item matching.

Only lengths decide a packing, and lengths are at most the capacity. So the packing is planned on the histogram of
lengths, which is bounded by the capacity whatever the corpus: pieces above a third of the capacity can share a bin
with at most one other such piece, and each, from the longest on, is matched with the longest partner that fits;
smaller pieces then go, from the longest on, to the tightest gap that takes them; what is left opens new bins. The plan
says how many bins of each pattern there are. A piece takes its place in the plan by its rank among the pieces of
its length, which is counted in chunks of rows, so neither a frequent length nor a large corpus meets in one task.

Cases: a null text is empty and gives one piece, the end id; documents longer than the capacity are cut into full
pieces after a shorter first one; repeated rows are packed each; an empty table gives no piece; further columns are
not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep
from tessera.llm.encoding import drop_encoder, encoder

#: Pieces whose ranks are counted together.
CHUNK_ROWS = 4096


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How many bins hold which lengths: ``[(lengths in order, bins)]``, from the number of pieces of each length."""
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is not between 1 and the capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - n) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        if k < 0:
            bins[(n,)] += left[n]
            left[n] = 0
        elif large[k] == n:
            bins[(n, n)] += left[n] // 2
            bins[(n,)] += left[n] % 2
            left[n] = 0
        else:
            m = large[k]
            take = min(left[n], left[m])
            bins[(n, m)] += take
            left[n] -= take
            left[m] -= take
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for held, count in bins.items():
        if count:
            gaps[capacity - sum(held)][held] = count
    rooms = sorted(gaps)
    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):  # no gap: bins of this length alone, the last perhaps with fewer
                each = capacity // n
                full, rest = divmod(left[n], each)
                new = [((n,) * each, full)] + [((n,) * rest, 1)] * bool(rest)
                left[n] = 0
            else:
                room = rooms[k]
                held, count = gaps[room].popitem()
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(k)
                each = room // n
                whole = min(count, left[n] // each)  # such gaps are filled up, one after the other
                new = [(held + (n,) * each, whole)]
                left[n] -= whole * each
                if whole < count:
                    new += [(held + (n,) * left[n], 1), (held, count - whole - 1)] if left[n] else [(held, count - whole)]
                    left[n] = 0
            for held, count in new:
                if count:
                    room = capacity - sum(held)
                    if room not in gaps:
                        bisect.insort(rooms, room)
                    gaps[room][held] = gaps[room].get(held, 0) + count
    return sorted((held, count) for by in gaps.values() for held, count in by.items())


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on, in which first bin and at which offset its pieces stand."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first = 0
    for held, count in plan:
        offset = 0
        for n in held:
            out[n].append((ranks[n], first, offset))
            ranks[n] += count
            offset += n
        first += count
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in out.items()}


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the pieces that the texts' ids are cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer, end)
        for b in batches:
            out: list[list[int]] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py())
                size, at, k = len(ids) // 4, 0, 0
                while at < size:
                    to = at + ((size - at) % capacity or capacity)
                    for x, column in zip((doc_id, k, at, to - at, zlib.crc32(memoryview(ids)[4 * at : 4 * to]), part << 33 | n), out, strict=True):
                        column.append(x)
                    at, k, n = to, k + 1, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = 1024) -> DataFrame:
    """Pieces of all texts with the sequence and the offset that they are packed to."""
    made = keep(pieces(docs, tokenizer, end, capacity), "pieces")  # once, so that every later step sees the same rows
    counts = made.groupBy("length").count().collect()  # at most one row for each length up to the capacity
    places = _places(plan_bins({r["length"]: r["count"] for r in counts}, capacity))
    chunks = max(1, sum(r["count"] for r in counts) // CHUNK_ROWS)
    ranked = made.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("chunk", "length").orderBy("row")) - 1)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.groupBy(F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"), "length").count()
    bases = bases.select("chunk", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoder()
        for b in batches:
            lengths, ranks = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            bins, offsets = np.empty_like(ranks), np.empty_like(ranks)
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                starts, first, offset = places[int(n)]
                k = np.searchsorted(starts, ranks[own], "right") - 1
                bins[own], offsets[own] = first[k] + ranks[own] - starts[k], offset[k]
            kept = [b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offsets)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.join(bases, ["chunk", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    return out.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
