import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, max_run):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets, max_run, min_words, percent, seed):
    """(doc_id, n_words, n_features, weight, score) of each row, and the keys of the drawn in order."""
    count = lambda texts: Counter(f % buckets for t in texts for f in features(t, max_run))
    s, t = count(x for _, x in rows), count(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        f = features(text, max_run)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % buckets] for x in f) // len(f) if f else 0
        out.append((key, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("how", [dict(buckets=10_000, max_run=1, min_words=20, percent=10), dict(buckets=97, max_run=3, min_words=1, percent=60)])
def test_against_brute_force(spark, docs, pairs, texts, how):
    target = [texts[5], None, "ka lo Mi", ""]
    got = im.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), seed=7, **how).collect()
    want, drawn = brute(pairs, target, seed=7, **how)
    plain = lambda rows: sorted(map(str, rows))
    assert plain(tuple(r)[:5] for r in got) == plain(want)
    ranks = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranks] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranks] == [(r[4], r[0]) for r in drawn]


def test_edges(spark, docs, empty):
    target = spark.createDataFrame([("a b",)], "text string")
    got = im.importance_resample(empty, target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and got.count() == 0
    ranks = im.importance_resample(docs, target.limit(0), percent=50)
    assert ranks.count() == docs.count()
    drawn = im.drawn_documents(docs, ranks)
    assert drawn.columns == docs.columns
    keys = {r["doc_id"] for r in ranks.where("rank is not null").collect()}
    assert {r["doc_id"] for r in drawn.collect()} == keys - {None}


def test_a_hot_key_gets_all_its_ranks(spark):
    """A key of a third of all rows is dealt over several ranges, and its equal rows get ranks without gaps."""
    rows = [(i if i % 3 else 0, "word " * 25) for i in range(3000)]
    got = im.importance_resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("word",)], "text string"), percent=100)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))


def test_target_words_are_drawn_more(spark):
    rows = [(i, ("near " if i % 2 else "far ") * 30) for i in range(400)]
    got = im.importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("near " * 50,)], "text string"), percent=25)
    drawn = [r["doc_id"] for r in got.where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 60


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", " ", "  ", "é", "-", "9", "\n", "\x7f", "É", "zz"]), max_size=60).map("".join), st.integers(1, 4), st.integers(1, 9))
def test_pieces_are_the_whole(text, max_run, piece):
    was, im.PIECE = im.PIECE, piece
    try:
        got = list(im.feature_buckets(text.encode(), 1000, max_run))
    finally:
        im.PIECE = was
    assert sum(n for n, _ in got) == len(words(text))
    assert sorted(np.concatenate([np.zeros(0, np.int64), *(b for _, b in got)]).tolist()) == sorted(f % 1000 for f in features(text, max_run))
