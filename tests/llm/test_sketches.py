import random
import re

import numpy as np
import pytest

from tessera.llm import sketches
from tessera.llm.shingles import shingles


def brute(rows, num, den):
    """Component of each id by comparing all pairs of word tuples."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets[i] = frozenset(s)
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and comp[a] != comp[b]:
                inter = len(sets[a] & sets[b])
                if den * inter >= num * len(sets[a] | sets[b]):
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows, n = [(0, None), (1, ""), (2, "one two"), (3, "ONE\ttwo"), (4, " \n "), (5, "a b c d e"), (6, "a b c d e f g h i"), (7, "a b c d e f g h")], 8
    passage = [word() for _ in range(60)]
    for _ in range(14):
        base = [word() for _ in range(r.choice([9, 30, 120, 600]))]
        if r.random() < 0.4:
            base[3:3] = passage
        for _ in range(r.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, max(1, len(w) // 30)])):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(x.upper() if r.random() < 0.05 else x for x in w)))
            n += 1
    return rows


@pytest.mark.parametrize(("seed", "num", "limit"), [(1, 85, None), (2, 80, None), (3, 85, 900)])
def test_components_equal_brute_force(spark, monkeypatch, seed, num, limit):
    if limit:
        monkeypatch.setattr(sketches, "GROUP_SHINGLES", limit)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketches.near_duplicates(df, num, 100).collect()}
    assert got == brute(rows, num, 100)
    assert sum(v[1] != k for k, v in got.items()) > 10


def test_link_group_joins_what_pairs_join():
    r = random.Random(5)
    for _ in range(60):
        base = [r.getrandbits(63) for _ in range(r.choice([6, 40, 200]))]
        sets = [np.unique(np.array([x for x in base if r.random() > 0.06] + [r.getrandbits(63) for _ in range(r.randint(0, 6))], np.uint64)) for _ in range(r.randint(2, 14))]
        comp = list(range(len(sets)))
        want = list(comp)
        for i, j in sketches.link_group(sets, 85, 100):
            comp = [comp[i] if c == comp[j] else c for c in comp]
        for i in range(len(sets)):
            for j in range(i):
                inter = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * inter >= 85 * (sets[i].size + sets[j].size - inter):
                    want = [want[i] if c == want[j] else c for c in want]
        assert len(set(zip(comp, want, strict=True))) == len(set(comp)) == len(set(want))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in sketches.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)
    assert sketches.near_duplicates(df.limit(0)).count() == 0


def test_long_texts_hash_as_short_ones(monkeypatch):
    from tessera.llm import shingles as module

    text = " ".join(f"w{i % 97}é" for i in range(3000))
    whole = shingles(text)
    monkeypatch.setattr(module, "CHUNK", 1000)
    assert np.array_equal(shingles(text), whole)


def test_space_around_words_does_not_count():
    assert np.array_equal(shingles("  one two\tthree four five six \n"), shingles("one two three  four five six"))
    assert shingles(" \n").size == 0
