import numpy as np
import pytest

from tessera.llm import common, covertree


def brute(rows, cosine):
    """Links and smallest reachable id by comparing all pairs."""
    good = {}
    for i, e, label in rows:
        x = np.array([np.nan if v is None else v for v in e] if e else [], float)
        if i is not None and label is not None and x.size and np.isfinite(x).all() and x.any():
            good[i] = (label, x)
    links = {i: set() for i, *_ in rows}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and x.size == y.size and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                links[i].add(j)
    comp = {}
    for i in sorted(k for k in links if k is not None):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += links[k]
    return {i: (len(links[i]), comp.get(i)) for i in links}


def vectors(seed):
    r = np.random.default_rng(seed)
    rows, n = [(0, None, 1), (1, [], 1), (2, [0.0] * 8, 1), (3, [1.0] * 7 + [float("nan")], 1), (4, [1.0] * 7 + [float("inf")], 1), (5, [1.0] * 8, None), (6, [1.0] * 8, 2), (7, [2.0] * 8, 2), (8, [1.0] * 7, 2), (9, [1.0] * 7 + [None], 2), (None, [1.0] * 8, 2)], 10
    for _ in range(30):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 14)):
            x = (base + r.normal(size=8) * r.choice([0, 0.02, 0.1, 0.3])) * r.choice([1, 3])
            rows.append((n, [float(v) for v in x.astype(np.float32)], int(r.choice([1, 1, 1, 2, 3]))))
            n += 1
    base = r.normal(size=8)
    rows += [(n + k, [float(v) for v in (base + r.normal(size=8) * 1e-3).astype(np.float32)], 1) for k in range(90)]
    return rows


#: One cell; levels of few pivots; small cells and broadcasts, with joins by shuffle; all cells in blocks.
LIMITS = [{}, {"CELL": 40, "FAN": 4}, {"CELL": 20, "FAN": 3, "PIVOT_BYTES": 400, "BROADCAST_BYTES": -1}, {"CELL": 30, "CROWDED": 0}]


@pytest.mark.parametrize(("seed", "limits"), enumerate(LIMITS))
def test_links_and_components_equal_brute_force(spark, monkeypatch, seed, limits):
    for name, value in limits.items():
        monkeypatch.setattr(common if name == "BROADCAST_BYTES" else covertree, name, value)
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(df, 0.98).collect()}
    assert got == brute(rows, 0.98)
    assert sum(v[0] > 0 for v in got.values()) > 100


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in covertree.near_duplicates(df).collect()) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)]
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_dense_nodes_are_counted_whole():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=16) + r.normal(size=(400, 16)) * s for s in (1e-4, 1e-2, 0.2)])
    sizes = r.integers(1, 4, len(x))
    for own in (len(x), 700):
        c = covertree.Cell(x, sizes, own, 0.98)
        norm = np.sqrt((x * x).sum(axis=1))
        linked = (x @ x.T) / np.outer(norm, norm) >= 0.98
        np.fill_diagonal(linked, False)
        assert np.array_equal(c.counts[:own], (linked[:own] @ sizes))
