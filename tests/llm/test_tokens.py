import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import token_counts as tc
from tidewell.llm.bpe import codec, decoder, encoder, round_trip
from tidewell.llm.token_files import pack, token_files, unpack, word_encoder

BPE, PATTERN, WORDS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("word_bpe_49k.json")
PIECES = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\n\n", "'", "'re", "'s", "12", "!", "é", "日本", "\xa0", "\x1c", " ", "x" * 9, "\t", "."]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 20), st.integers(1, 8))
def test_joined_pieces_are_the_whole(text, leaf, window):
    c = codec(BPE, PATTERN)
    ids = c.encode(text, leaf, window)
    assert ids.tolist() == c.library.encode_ordinary(text)
    assert c.decode(ids, 3) == text.encode()


def test_round_trip(docs, pairs, empty):
    c = codec(BPE, PATTERN)
    want = sorted((str(i), c.library.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs)
    got = sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in round_trip(docs, BPE, PATTERN).collect())
    assert got == want
    assert round_trip(empty, BPE, PATTERN).count() == 0


def test_round_trip_is_one_python_step(docs):
    """Each Python step of a stage is a process a task, and the processes stay."""
    got = round_trip(docs, BPE, PATTERN)
    got = got.select("doc_id", F.size("ids"), F.sha2(F.array_join("ids", " "), 256), F.sha2("decoded", 256))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_encoder_and_decoder(docs, pairs):
    got = docs.select("doc_id", encoder(BPE, PATTERN)("text").alias("ids")).select("doc_id", decoder(BPE, PATTERN)("ids").alias("text"))
    assert sorted((str(r["doc_id"]), bytes(r["text"])) for r in got.collect()) == sorted((str(i), (t or "").encode()) for i, t in pairs)


def test_histogram(docs, pairs, empty):
    c = codec(BPE, PATTERN)
    n = [len(c.library.encode_ordinary(t or "")) for _, t in pairs]
    sums = tc.suffix_sums(tc.length_histogram(docs, BPE, PATTERN)).cache()
    for r in sums.collect():
        x = r["n_tokens"]
        assert r["n_docs"] == n.count(x) and r["docs_at_least"] == sum(v >= x for v in n)
        assert r["tokens_at_least"] == sum(v for v in n if v >= x) and r["truncated_tokens"] == sum(min(v, x) for v in n)
    for r in tc.at_limits(sums, [0, 5, 100, 10**6]).collect():
        assert (r["docs_over"], r["truncated_tokens"]) == (sum(v > r["context_limit"] for v in n), sum(min(v, r["context_limit"]) for v in n))
    longest = sorted(n)
    for r in tc.with_quantiles(sums, [1, 50, 90, 100]).collect():
        at = {p for p in (1, 50, 90, 100) if longest[max(0, -(-len(n) * p // 100) - 1)] == r["n_tokens"]}
        assert set(r["quantile_of"]) == at and r["context_share"] == round(sum(v <= r["n_tokens"] for v in n) / len(n), 6)
    for r in tc.length_quantiles(sums, [0, 50, 90, 100]).collect():
        assert r["n_tokens"] == sorted(n)[max(0, -(-len(n) * r["percent"] // 100) - 1)]
    assert tc.suffix_sums(tc.length_histogram(empty, BPE, PATTERN)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes(n, bits):
    r = random.Random(n)
    ids = np.array([r.randrange(1 << 16) for _ in range(n)], np.uint32)
    assert (unpack(pack(ids, 2, bits, block=64)) == ids).all()
    wide = ids * np.uint32(65537)
    assert (unpack(pack(wide, 4, bits, block=64)) == wide).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "The", " ", "\n", "'", "'re", "1", "!", "É", "é", "日", "\x1c", " ", ".", ",", "<|endoftext|>", "<|", "İ", "ß", "Σ", "́"]), max_size=15).map("".join), min_size=1, max_size=5))
def test_words_give_the_library_s_ids(texts):
    e = word_encoder(WORDS)
    assert e.by_word
    ids, bounds = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("how", [{}, {"bits": True, "chunk_ids": 50, "range_bytes": 2000}])
def test_files(docs, pairs, empty, how):
    e = word_encoder(WORDS)
    got = token_files(docs, WORDS, end_id=2, **how).orderBy("start").collect()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.array([*e.library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, ids.size, zlib.crc32(ids.tobytes()))
        at += ids.size
    assert token_files(empty, WORDS, end_id=2).count() == 0


def test_files_deal_a_hot_key_over_ranges(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text number {i % 50}") for i in range(900)]
    out = str(tmp_path / "files")
    token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, end_id=2, out=out, range_bytes=1000)
    parts = spark.read.parquet(f"{out}/ids").select("part", F.explode("doc_ids").alias("id")).where("id is null").groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 600 and len(parts) > 3
