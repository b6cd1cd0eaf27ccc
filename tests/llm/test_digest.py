"""The digest against plain Python, triplet by triplet, over whole rows; ties, nulls, long texts and odd columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import pytest

from tessera.llm import digest


def mixed(x):
    for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> a)) * m % 2**64
    return x ^ (x >> 31)


TABLES = [[[mixed((100 + 10 * i + j + (k + 1) * 0x9E3779B97F4A7C15) % 2**64) % 512 for k in range(256)] for j in range(3)] for i in range(3)]


def plain(text):
    """Length code, ratios and quartiles of a text."""
    data, counts = text.encode(), [0] * 512
    for at in range(len(data) - 4):
        for t, shape in zip(TABLES, ((0, 1, 4), (0, 2, 4), (0, 3, 4))):
            counts[t[0][data[at + shape[0]]] ^ t[1][data[at + shape[1]]] ^ t[2][data[at + shape[2]]]] += 1
    q = [sorted(counts)[k * 128 - 1] for k in (1, 2, 3)]
    return min(255, round(math.log1p(len(data)) / math.log(1.12))), [15 * q[k] // max(q[2], 1) for k in (0, 1)], [sum(c > x for x in q) for c in counts]


def printed(text):
    length, ratios, quartiles = plain(text)
    body = bytes(64 * quartiles[k] + 16 * quartiles[k + 1] + 4 * quartiles[k + 2] + quartiles[k + 3] for k in range(0, 512, 4))
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{base64.b64encode(body).decode()}"


def alike(a, b):
    (m, r, x), (n, s, y) = plain(a), plain(b)
    apart = min(24, abs(m - n)) + sum(abs(i - j) for i, j in zip(r, s)) + sum(abs(i - j) for i, j in zip(x, y))
    return max(0.0, 1 - apart / 640)


def test_rows_are_those_of_a_plain_search(spark):
    r = random.Random(1)
    texts = [(i * 3, " ".join(r.choice(["the", "of", "Straße", "12", "日本"]) for _ in range(r.choice([1, 30, 300])))) for i in range(25)]
    texts += [(1, None), (2, ""), (4, "ab"), (5, "x" * 20_000), (6, texts[0][1]), (7, texts[0][1]), (7, "second"), (None, "null id")]
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in texts], "doc_id long, text string, part string, follower int")
    got = sorted(digest.compare_with_next(df).collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0, x.edited_sha256))
    rows = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    want = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), printed(text), printed(new), alike(text, new), alike(text, following)))
    want.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    assert [tuple(x)[:5] for x in got] == [x[:5] for x in want]
    assert [v for x in got for v in tuple(x)[5:]] == pytest.approx([v for x in want for v in x[5:]])
