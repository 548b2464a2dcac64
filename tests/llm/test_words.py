import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import base
from tidewell.llm.base import in_bitmap, sized_bitmap
from tidewell.llm.words import Words, blocks, shingles

TEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbé \n\t\x0b\x1c .,日"), max_size=30))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(0, 3))
def test_words_and_hashes(texts, skip):
    array = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    w = Words(array)
    want = [(t or "").encode().split() for t in array.to_pylist()]
    assert [[w.word(i) for i in range(w.of[k], w.of[k + 1])] for k in range(len(w))] == want
    flat = [x for t in want for x in t]
    for lower in (False, True):
        h, seen = w.hashes(lower), {}
        for x, v in zip(flat, h.tolist()):
            assert seen.setdefault(x.lower() if lower else x, v) == v
        assert len(set(seen.values())) == len(seen)


def test_long_words_and_blocks():
    a = "w" * 600_000
    assert Words(pa.array([a])).hashes()[0] != Words(pa.array([a + "w"])).hashes()[0]
    assert Words(pa.array([a])).hashes()[0] == Words(pa.array(["q", "z " + a])).hashes()[2]
    got = list(blocks(pa.array(["a" * 10, None, "b" * 30, "c"]), 12))
    assert [(i, b.to_pylist()) for i, b in got] == [(0, ["a" * 10, None]), (2, ["b" * 30]), (3, ["c"])]


def test_shingles_tell_order():
    h = Words(pa.array(["a b a b c"])).hashes()
    s = shingles(h, 2)
    assert s.size == 4 and s[0] == s[2] and s[0] != s[1] and shingles(h, 6).size == 0


def test_bitmap(spark):
    from tidewell.llm.base import as_bitmap

    keys = [3, -5, 1 << 40]
    bits = np.frombuffer(as_bitmap(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 12), np.uint64)
    assert in_bitmap(bits, np.array([*keys, 4], np.int64).view(np.uint64)).tolist() == [True, True, True, False]


def test_bitmaps_grow_with_their_keys(spark, monkeypatch):
    few = spark.range(10).selectExpr("id as k")
    assert len(sized_bitmap(few, "k", 12)) == 1 << 9 and len(sized_bitmap(spark.range(1000).selectExpr("id as k"), "k", 12)) == 1 << 13
    monkeypatch.setattr(base, "MOST_BITS", 14)
    assert len(sized_bitmap(spark.range(1000).selectExpr("id as k"), "k", 12)) == 1 << 11
