"""Dense search: exact cosine top-k in blocks, approximate top-k by random projections, and late interaction.

The exact search ships the queries to the vectors: a block of queries (a bounded matrix) meets a piece of each Arrow
batch in one matrix product, and a task keeps ``k`` rows a query, so what is shuffled is ``k`` rows a query and task,
whatever the number of vectors. Similar pairs are found by the same products, within a key. The products' number is
that of the queries times the vectors; their memory is that of one block.

Cases: vectors that are null, of another length, zero or not finite are never found; queries like that find nothing;
ties are ordered by id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.lexical import best

#: Queries and vectors of one product, and bytes of the queries that are sent out together at most.
BLOCK, PIECE, BLOCK_BYTES = 1024, 2048, 32 << 20
#: More than what two ways to add up a cosine differ by.
SLACK = 1e-11


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable vectors of one length, their norms and which of the rows they are."""
    if not dim:
        return np.empty((0, 0)), np.empty(0), np.empty(0, np.int64)
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null is not a number here
    norm = np.sqrt(np.einsum("nd,nd->n", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return x[good], norm[good], right[good]


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and which of the rows they are."""
    x, norm, rows = _vectors(column, dim)
    return x / norm[:, None], rows


def _to_driver(stated: DataFrame) -> pa.RecordBatch:
    """A stated set's rows as one batch."""
    t = stated.toArrow().combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], schema=t.schema)


def _dealt(vectors: DataFrame, vec_id: str) -> DataFrame:
    """The rows in as many even parts as keep the cores busy: their products cost far more than their reading."""
    return vectors.repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism, vec_id)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; null where one of them is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


class _Best:
    """The ``k`` best of each of ``n`` queries so far, by score to 12 places, then by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least, self.last = k, np.full(n, -np.inf), np.zeros(n, object)
        self.q, self.s, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """``s``: the scores of all queries with the vectors ``ids``; what is not searched has ``-inf``."""
        cut = self.least
        if s.shape[1] > self.k and np.isneginf(cut).any():
            cut = np.maximum(cut, np.partition(s, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero(s >= np.where(np.isneginf(cut), np.finfo(float).min, cut - SLACK)[:, None])
        score, new = np.round(s[q, c], 12), ids[c]
        full = ~np.isneginf(self.least[q])
        keep = score >= self.least[q]
        tie = np.flatnonzero(full & (score == self.least[q]))
        keep[tie] = new[tie] < self.last[q[tie]]  # copies of a vector that have larger ids
        if not keep.any():
            return
        q, score, new = np.concatenate([self.q, q[keep]]), np.concatenate([self.s, score[keep]]), new[keep] if self.ids is None else np.concatenate([self.ids, new[keep]])
        place = new if new.dtype != object else np.unique(new, return_inverse=True)[1]
        order = np.lexsort((place, -score, q))
        q, score, new = q[order], score[order], new[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.s, self.ids = (x[nth < self.k] for x in (q, score, new))
        ends = np.flatnonzero(nth == self.k - 1)
        self.least[q[ends]], self.last[q[ends]] = score[ends], new[ends]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id", filters: Sequence[str] = ()) -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` vectors nearest to each query. The queries are the caller's stated
    set; they are read to the driver and sent out block by block. ``filters``: columns of both tables; where a query
    has a value there, only vectors with this value are searched."""
    asked = _to_driver(queries.select(query_id, embedding, *filters))
    kinds = {"query_id": queries.schema[query_id].dataType, "id": vectors.schema[vec_id].dataType}
    schema = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kinds.items()), ("score", pa.float64())])
    sizes = pc.list_value_length(asked.column(1))
    dim = next((n for n in sizes.to_pylist() if n), 0)
    step, found = max(1, BLOCK_BYTES // max(1, 8 * dim)), None
    for at in range(0, max(1, asked.num_rows), step):
        part = asked.slice(at, step)
        q, which = _unit(part.column(1), dim)
        names = part.column(0).take(pa.array(which))
        codes = [{x: i for i, x in enumerate(dict.fromkeys(part.column(c).to_pylist())) if x is not None} for c in range(2, part.num_columns)]
        wanted = [np.array([code.get(x, -1) for x in part.column(c).to_pylist()], np.int64)[which] for c, code in enumerate(codes, 2)]

        def run(batches: Iterator[pa.RecordBatch], q=q, names=names, codes=codes, wanted=wanted) -> Iterator[pa.RecordBatch]:
            starts = range(0, len(q), BLOCK)
            held = [_Best(len(q[i : i + BLOCK]), k) for i in starts]
            for b in batches:
                x, rows = _unit(b.column(1), dim)
                ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
                has = [np.array([code.get(v, -2) for v in b.column(c).to_pylist()], np.int64)[rows] for c, code in enumerate(codes, 2)]
                for at in range(0, len(x), PIECE):
                    for i, own in zip(starts, held, strict=True):
                        s = q[i : i + BLOCK] @ x[at : at + PIECE].T
                        for w, h in zip(wanted, has, strict=True):
                            w = w[i : i + BLOCK, None]
                            s[(w != -1) & (w != h[None, at : at + PIECE])] = -np.inf
                        own.add(s, ids[at : at + PIECE])
            for i, own in zip(starts, held, strict=True):
                if len(own.q):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own.q + i)).cast(schema.field(0).type), pa.array(own.ids, schema.field(1).type), pa.array(own.s)], schema=schema)

        rows = _dealt(vectors.where(F.col(vec_id).isNotNull()).select(vec_id, embedding, *filters), vec_id).mapInArrow(run, _ddl(kinds))
        found = rows if found is None else found.unionByName(rows)
    return best(found.withColumn("score", F.round("score", 12)), k)


def _ddl(kinds: dict) -> str:
    return ", ".join([*(f"{name} {kind.simpleString()}" for name, kind in kinds.items()), "score double"])


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def similar_pairs(rows: DataFrame, others: DataFrame, least: float, key: str, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``key, id, other, score``: pairs of one ``key`` with a cosine of at least ``least`` (soft matching of answers with
    what was found). ``rows`` are the caller's stated set; they are read to the driver and sent out block by block, to
    meet the others of their key in matrix products."""
    asked = _to_driver(rows.where(F.col(key).isNotNull()).select(key, vec_id, embedding))
    kinds = {"key": rows.schema[key].dataType, "id": rows.schema[vec_id].dataType, "other": others.schema[vec_id].dataType}
    schema = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kinds.items()), ("score", pa.float64())])
    sizes = pc.list_value_length(asked.column(2))
    dims = sorted({n for n in sizes.to_pylist() if n})
    step, found = max(1, BLOCK_BYTES // max(1, 8 * max(dims, default=1))), None
    for at in range(0, max(1, asked.num_rows), step):
        part, groups = asked.slice(at, step), {}
        for dim in dims:
            x, norm, which = _vectors(part.column(2), dim)
            own = part.column(0).take(pa.array(which)).to_pylist()
            places: dict = {}
            for i, value in enumerate(own):
                places.setdefault(value, []).append(i)
            groups[dim] = {value: (x[i], norm[i], part.column(1).take(pa.array(which[i]))) for value, i in places.items()}

        def run(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_pylist()
                for dim, by_key in groups.items():
                    x, norm, which = _vectors(b.column(2), dim)
                    places: dict = {}
                    for i, row in enumerate(which):
                        if keys[row] in by_key:
                            places.setdefault(keys[row], []).append(i)
                    for value, all_i in places.items():
                        q, q_norm, ids = by_key[value]
                        for a in range(0, len(all_i), PIECE):
                            i = np.array(all_i[a : a + PIECE])
                            unit = (x[i] / norm[i, None]).T
                            for a_q in range(0, len(q), BLOCK):
                                n, c = np.nonzero((q[a_q : a_q + BLOCK] / q_norm[a_q : a_q + BLOCK, None]) @ unit >= least - SLACK)
                                n, c = n + a_q, i[c]
                                score = np.einsum("nd,nd->n", q[n], x[c]) / (q_norm[n] * norm[c])
                                n, c, score = (v[score >= least] for v in (n, c, score))
                                if len(n):
                                    yield pa.RecordBatch.from_arrays([pa.array([value] * len(n), schema.field(0).type), ids.take(pa.array(n)), b.column(1).take(pa.array(which[c])), pa.array(score)], schema=schema)

        met = _dealt(others.where(F.col(key).isNotNull()).select(key, vec_id, embedding), vec_id).mapInArrow(run, _ddl(kinds))
        found = met if found is None else found.unionByName(met)
    return found


def codes(df: DataFrame, vec_id: str, embedding: str, planes: np.ndarray) -> DataFrame:
    """``id, t, code, v`` for each usable vector and each of the tables: on which sides of the table's planes it lies."""
    kind = df.schema[vec_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = _unit(b.column(1), planes.shape[2])
            bits = np.einsum("nd,tbd->ntb", x, planes) > 0
            code = (bits * (1 << np.arange(planes.shape[1]))).sum(axis=2)
            ids, n = b.column(0).take(pa.array(rows)), planes.shape[0]
            at = np.repeat(np.arange(len(rows)), n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))), pa.array(code.reshape(-1).astype(np.int64)), pa.array(x.tolist(), pa.list_(pa.float64())).take(pa.array(at))], names=["id", "t", "code", "v"])

    return df.select(vec_id, embedding).mapInArrow(run, f"id {kind}, t int, code long, v array<double>")


def approximate(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 16, bits: int = 4, seed: int = 17, vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """Top-k among the vectors that lie in the query's cell in one of ``tables`` sets of ``bits`` random planes.

    More bits make cells smaller, more tables find more. Cells meet in a join, a candidate of a query is scored once.
    """
    first = queries.where(F.size(embedding) > 0).select(F.size(embedding).alias("n")).first()
    if first is None:
        return search(vectors, queries, k, vec_id, embedding, query_id)
    planes = np.random.default_rng(seed).normal(size=(tables, bits, first.n))
    asked = codes(queries, query_id, embedding, planes).select(F.col("id").alias("query_id"), "t", "code", F.col("v").alias("q"))
    met = codes(vectors, vec_id, embedding, planes).join(asked, ["t", "code"]).groupBy("query_id", "id").agg(F.first("v").alias("v"), F.first("q").alias("q"))
    return best(met.select("query_id", "id", F.round(cosine(F.col("v"), F.col("q")), 12).alias("score")), k)


def _unit_rows(tokens) -> np.ndarray:
    x = np.array([np.asarray(t, float) for t in tokens])
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def search_tokens(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "id", tokens: str = "tokens", query_id: str = "query_id") -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` documents of the highest late-interaction score (``max_similarity``).

    The queries' token vectors, the caller's stated set, go to the documents block by block; a block meets a document
    in one matrix product, and a task keeps ``k`` rows a query. Rows without tokens, as queries or documents, are not
    found; all token vectors are of one length.
    """
    asked = [(r[0], r[1]) for r in queries.select(query_id, tokens).collect() if r[1]]
    kind, q_kind = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    dim = len(asked[0][1][0]) if asked else 0
    step, found = max(1, min(BLOCK, BLOCK_BYTES // max(1, 8 * dim * max((len(t) for _, t in asked), default=1)))), None
    for at in range(0, max(1, len(asked)), step):
        part = asked[at : at + step]
        names = [name for name, _ in part]
        q = np.concatenate([_unit_rows(t) for _, t in part]) if part else np.empty((0, dim))
        starts = np.cumsum([0, *(len(t) for _, t in part)])[:-1]

        def run(batches: Iterator[pa.RecordBatch], q=q, names=names, starts=starts) -> Iterator[pa.RecordBatch]:
            held: list[list[tuple]] = [[] for _ in names]
            for b in batches:
                ids = b.column(0).to_pylist()
                full = [(i, t.as_py()) for i, t in enumerate(b.column(1)) if names and t.is_valid and len(t.as_py())]
                if not full:
                    continue
                s = np.array([np.add.reduceat((q @ _unit_rows(t).T).max(axis=1), starts) for _, t in full])
                for n, column in enumerate(np.round(s, 12).T):
                    own = held[n] + [(-float(x), ids[i]) for (i, _), x in zip(full, column, strict=True)]
                    own.sort()
                    held[n] = own[:k]
            flat = [(name, i, -s) for name, own in zip(names, held, strict=True) for s, i in own]
            if flat:
                yield pa.RecordBatch.from_pylist([{"query_id": a, "id": i, "score": s} for a, i, s in flat], schema=pa.schema([("query_id", _arrow(q_kind)), ("id", _arrow(kind)), ("score", pa.float64())]))

        rows = docs.where(F.col(doc_id).isNotNull()).select(doc_id, tokens).mapInArrow(run, f"query_id {q_kind}, id {kind}, score double")
        found = rows if found is None else found.unionByName(rows)
    return best(found, k)


def max_similarity(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: for each token vector of the query the best cosine among the document's, summed up; 0 without
    tokens on either side. One matrix product a row, where nested expressions would be interpreted for each number."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, docs in batches:
            full = [q is not None and d is not None and len(q) > 0 and len(d) > 0 for q, d in zip(queries, docs, strict=True)]
            yield pd.Series([float((_unit_rows(q) @ _unit_rows(d).T).max(axis=1).sum()) if ok else 0.0 for q, d, ok in zip(queries, docs, full, strict=True)], dtype="float64")

    return run(query_tokens, doc_tokens)
