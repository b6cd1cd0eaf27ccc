import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import encoding, packing, tokenfile
from tessera.llm.encoding import Encoder
from tessera.llm.queries import vocabulary

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


#: A library object of its own for each file, made without any of our code.
PLAIN = {name: Tokenizer.from_file(vocabulary(name)) for name in FILES}
MADE = {name: Encoder(vocabulary(name), 1) for name in FILES}
PARTS = st.lists(st.sampled_from([*"abcTHE's'LLßéÉñçÄ  \t\n\r\n09²½.,!$~–’дЖ的カひªK\x85\xa0İΣς́\x1c", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "<|EndOfText|>"]), max_size=60)


def plain(name, text):
    return PLAIN[name].encode(text, add_special_tokens=False).ids if text else []


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=250, deadline=None)
@given(st.one_of(PARTS.map("".join), st.text(max_size=40)))
def test_ids_are_those_of_the_library(name, text):
    assert MADE[name].find is not None
    assert np.frombuffer(MADE[name](text), "<u4").tolist() == [*plain(name, text), 1]


@pytest.mark.parametrize("name", FILES)
def test_full_caches_change_no_ids(name, monkeypatch):
    monkeypatch.setattr(encoding, "MOST_KEPT", 1)
    small = Encoder(vocabulary(name), 1)
    for text in ("the house, the garden and the house", "12 it's 12 it's"):
        assert np.frombuffer(small(text), "<u4").tolist() == [*plain(name, text), 1]


def test_added_tokens_have_ids_of_their_own():
    assert [plain(name, "one <|endoftext|> two") for name in FILES] == [[637, 49407, 1237], [505, 220, 50256, 734]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.data())
def test_blocks_round_trip(ids, data):
    x = np.array(ids, np.uint32)
    coded = tokenfile.encode_ids(x)
    assert np.array_equal(tokenfile.decode_ids(coded), x)
    first = data.draw(st.integers(0, len(ids)))
    last = data.draw(st.integers(first, len(ids)))
    assert np.array_equal(tokenfile.decode_ids(coded, first, last), x[first:last])


def texts():
    r = random.Random(3)
    rows = [(7, None), (3, ""), (9, "x"), (None, "last of all"), (4, "same"), (4, "same")]
    return rows + [(100 - i, " ".join(r.choice(["the", "of", "Straße", "12", "it's", "\n"]) for _ in range(r.choice([3, 50, 4000])))) for i in range(40)]


@pytest.mark.parametrize("limit", [1 << 20, 1500])
def test_token_file_reads_back(spark, monkeypatch, tmp_path, limit):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", limit)
    path = vocabulary(FILES[0])
    df = spark.createDataFrame([(i, t, 5) for i, t in texts()], "doc_id long, text string, start int")
    got = tokenfile.read_tokens(tokenfile.write_tokens(df, path, 1, str(tmp_path / "ids"))).orderBy("start").collect()
    at, want = 0, []
    for i, t in sorted(texts(), key=lambda x: (x[0] is None, x[0] or 0)):
        ids = [*plain(FILES[0], t), 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokenfile.read_tokens(tokenfile.write_tokens(df.limit(0), path, 1)).count() == 0


def test_packing_places_every_piece(spark):
    path = vocabulary(FILES[1])
    df = spark.createDataFrame([(i, t, 5) for i, t in texts()], "doc_id long, text string, length int")
    got = packing.pack(df, path, 2, 256).collect()
    want = []
    for i, t in texts():
        ids = np.array([*plain(FILES[1], t), 2], "<u4").tobytes()
        n = len(ids) // 4
        cuts = [0, *range(n % 256 or 256, n + 1, 256)]
        want += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 3
    assert packing.pack(df.limit(0), path, 2).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 50)))
def test_plan_holds_all_and_at_most_two_large(histogram):
    plan = packing.plan_bins(histogram, 60)
    held = {}
    for lengths, count in plan:
        assert count > 0
        assert sum(lengths) <= 60
        assert sum(3 * n > 60 for n in lengths) <= 2
        for n in lengths:
            held[n] = held.get(n, 0) + count
    assert held == {n: c for n, c in histogram.items() if c}
