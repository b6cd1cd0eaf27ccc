"""Token-ID / binary output: patched frame-of-reference blocks.

A shard is one binary value (see ``pack_shard``): documents in ascending id, their ids in blocks of 256. A block
stores its minimum and packs the differences at the bit width that its ``PERCENTILE`` needs; differences that need
more bits keep their low bits there and put the high ones in the block's exception list. The index holds each
block's start, so a reader can seek to any block. Shards are written by Spark into a Parquet container (one row a shard, columns
``part, shard, before, n_docs, n_ids, data``; ``before``: ids before it in its range): Spark's own committer then gives whole files on any store, also when
executors are lost.

Cases: a null text is empty and gives the end id alone; repeated rows give repeated entries; rows with a null id come
last; rows with equal ids are ordered by text; an empty table gives no shard; one document may be longer than a shard,
which then holds it alone; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, shuffle_width
from tessera.llm.encoding import drop_encoder, encoder

MAGIC, BLOCK, PERCENTILE = b"PFOR1\0\0\0", 256, 90
#: Ids after which a shard is closed at the next document's end.
SHARD_IDS = 1 << 20
_NO_ID = -(1 << 63)


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, highest bit first (widths 8 and 16: as little-endian numbers)."""
    if width == 8:
        return x.astype(np.uint8)
    if width == 16:
        return x.astype("<u2").view(np.uint8).reshape(len(x), -1)
    whole = 16 if width < 16 else 32
    bits = np.unpackbits(x.astype(f">u{whole // 8}").view(np.uint8), axis=1).reshape(len(x), BLOCK, whole)
    return np.packbits(bits[:, :, whole - width :].reshape(len(x), -1), axis=1)


def _unpack(b: np.ndarray, width: int) -> np.ndarray:
    if width == 8:
        return b.astype(np.uint32)
    if width == 16:
        return np.ascontiguousarray(b).view("<u2").astype(np.uint32)
    whole = 16 if width < 16 else 32
    bits = np.zeros((len(b), BLOCK, whole), np.uint8)
    bits[:, :, whole - width :] = np.unpackbits(b, axis=1).reshape(len(b), BLOCK, width)
    return np.packbits(bits.reshape(len(b), -1), axis=1).view(f">u{whole // 8}").astype(np.uint32)


def encode_ids(ids: np.ndarray) -> bytes:
    """Ids (unsigned, 32 bits) as blocks: count, index of block starts, minima, widths, packed bits, exceptions."""
    n = ids.size
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<QI", 0, 0)
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = BLOCK * PERCENTILE // 100
    width = _widths(np.partition(rest, at, axis=1)[:, at])
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 8))])
    packed = np.empty(starts[-1], np.uint8)
    masked = rest & ((np.uint64(1) << width[:, None].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed[starts[own][:, None] + np.arange(w * (BLOCK // 8))] = _pack(masked[own], int(w))
    rows, cols = np.nonzero(over)
    parts = [struct.pack("<QI", n, len(rows)), starts[:-1].astype("<u8").tobytes(), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes()]
    parts += [np.searchsorted(rows, np.arange(blocks + 1)).astype("<u4").tobytes(), cols.astype(np.uint8).tobytes(), over[rows, cols].astype("<u4").tobytes(), packed.tobytes()]
    return b"".join(parts)


def decode_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids from ``first`` up to ``last``; only the blocks that hold them are unpacked."""
    n, n_over = struct.unpack_from("<QI", data)
    if not n:
        return np.empty(0, np.uint32)
    last = n if last is None else min(last, n)
    blocks, at = -(-n // BLOCK), 12
    out = []
    for kind, count in (("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u4", blocks + 1), ("u1", n_over), ("<u4", n_over)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    starts, low, width, exceptions, cols, over = out
    b0, b1 = first // BLOCK, max(first // BLOCK, -(-last // BLOCK))
    body = np.frombuffer(data, np.uint8, offset=at) if at < len(data) else np.empty(0, np.uint8)
    rest = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width[b0:b1]):
        if w:
            own = np.flatnonzero(width[b0:b1] == w)
            rest[own] = _unpack(body[starts[b0:b1][own].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))], int(w))
    e0, e1 = int(exceptions[b0]), int(exceptions[b1])
    rows = np.repeat(np.arange(b0, b1), np.diff(exceptions[b0 : b1 + 1]).astype(np.int64))
    rest[rows - b0, cols[e0:e1]] |= (over[e0:e1].astype(np.uint64) << width[rows].astype(np.uint64)).astype(np.uint32)
    return (rest + low[b0:b1, None]).reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK]


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard: magic, number of documents, their ids and lengths, then the blocks."""
    head = MAGIC + struct.pack("<Q", len(doc_ids))
    return head + np.array([_NO_ID if x is None else x for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + encode_ids(ids)


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a shard."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    (n,) = struct.unpack_from("<Q", data, 8)
    docs, lengths = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<u8", n, 16 + 8 * n).astype(np.int64)
    return [None if x == _NO_ID else int(x) for x in docs], lengths, decode_ids(data[16 + 16 * n :])


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str | None = None) -> DataFrame:
    """Encodes every text, appends ``end`` and writes shards in ascending document id; returns the stored shards.

    Texts are dealt by id range once; the ranges' numbers and the shards' numbers within them order the shards.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names, lengths, data, size = [], [], [], 0
        encode = encoder(tokenizer, end)

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([ids.size], pa.int64()), pa.array([pack_shard(names, lengths, ids)], pa.binary())], names=["part", "shard", "before", "n_docs", "n_ids", "data"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = encode(text.as_py())
                if names and size + len(one) // 4 > SHARD_IDS:
                    yield close()
                    names, lengths, data, size, shard, before = [], [], [], 0, shard + 1, before + size
                names.append(doc_id)
                lengths.append(len(one) // 4)
                data.append(one)
                size += len(one) // 4
        if names:
            yield close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    shards = own.repartitionByRange(shuffle_width(spark), *order[:1]).sortWithinPartitions(*order).mapInArrow(run, "part long, shard long, before long, n_docs long, n_ids long, data binary")
    if path is None:
        return keep(shards, "tokens")
    shards.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the stored shards alone."""
    bases, at = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row a range, as many as shuffle partitions
        bases[r.part] = at
        at += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoder()
        for b in batches:
            for part, before, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                docs, lengths, ids = unpack_shard(data.as_py())
                start = bases[part] + before
                ends = np.cumsum(lengths)
                raw, crcs = memoryview(ids.astype("<u4").tobytes()), []
                for first, last in zip(ends - lengths, ends, strict=True):
                    crcs.append(zlib.crc32(raw[4 * first : 4 * last]))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
