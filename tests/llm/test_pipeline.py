"""The pipeline and the queries with contracts, on the smallest tables."""

import hashlib
import os
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import queries
from tidewell.llm.bpe import codec
from tidewell.llm.quality_classifier import features, train

from .conftest import prose
from .test_dedup import brute, lower, shingle_set

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        got, exp = queries.QUERIES[name](spark, SF), con.execute(sql)
        names = [d[0] for d in exp.description]
        assert sorted(names) == sorted(got.columns)
        order = sorted(names)
        assert sorted(tuple(str(r[c]) for c in order) for r in got.collect()) == sorted(tuple(str(r[names.index(c)]) for c in order) for r in exp.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) <= set(before)
        if name != "byte_bpe":
            assert out.columns == columns
        if name == "quality_classifier":
            good = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
            assert sum(i in rows for i in good) >= 0.9 * len(good)
        if name == "ngram_join":
            sets = {i: shingle_set(r["text"], 4) for i, r in rows.items()}
            ids = sorted(sets)
            for k, i in enumerate(ids):
                for j in ids[:k]:
                    both = len(sets[i] & sets[j])
                    assert not both or 100 * both < 85 * (len(sets[i]) + len(sets[j]) - both)
        if name == "byte_bpe":
            c = codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
            assert all(list(r["ids"]) == c.library.encode_ordinary(before[i]) for i, r in rows.items())
            return
        before = {i: r["text"] for i, r in rows.items()}
        docs = spark.createDataFrame([tuple(r) for r in rows.values()], out.schema)


def test_near_copies_of_five_words(spark):
    """Near copies by 0.8 of five-word shingles, though not by 0.85 of four-word ones, and a pair below both."""

    def edited(words, places):
        return " ".join(f"edit{i}" if i in places else w for i, w in enumerate(words))

    one, two, three = (prose(seed, 1000).split() for seed in (40, 41, 42))
    rows = [(0, " ".join(one)), (1, edited(one, range(400, 500))), (2, " ".join(two)), (3, edited(two, range(20, 964, 43))), (4, " ".join(three)), (5, edited(three, range(300, 460)))]
    sets = {k: [shingle_set(t, k) for _, t in rows] for k in (4, 5)}
    share = {k: [len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) for i in (0, 2, 4)] for k, s in sets.items()}
    assert max(share[4]) < 0.85 and min(share[5][:2]) >= 0.8 > share[5][2]
    out = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r["doc_id"] for r in out.collect()} == {0, 2, 4, 5}


def test_near_copies_stage_leaves_no_five_word_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = [shingle_set(r["text"], 5) for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()]
    for k, a in enumerate(sets):
        for b in sets[:k]:
            both = len(a & b)
            assert not both or 100 * both < 80 * (len(a) + len(b) - both)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert {"op8_token_counts": "n_tokens", "op12_chat_formatting": "conv_id", "op13_filter_audit": "part"}.get(name, "doc_id") in got.columns


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("pipeline", *sorted(queries.QUERIES)):
        run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
        # The chats have a conversation of the query's own.
        assert run(spark, str(tmp_path)).count() == (name == "op12_chat_formatting"), name


def test_pipeline_without_labels_or_items(spark, tmp_path):
    """Without labels all documents stay as graded, without items none is contaminated: what goes are copies and passages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()}
    assert got <= set(kept) and len(got) > 0.5 * len(kept)


def words_of(text):
    """As decontamination takes them."""
    return re.findall(r"[0-9a-z\x80-\xff]+", lower((text or "").encode()).decode("latin-1"))


def overlaps(text, item, least=13, percent=80):
    """Whether some diagonal has an overlap: the rule itself, on the diagonals with enough equal words."""
    w, v = words_of(text), words_of(item)
    places = {}
    for j, x in enumerate(v):
        places.setdefault(x, []).append(j)
    on = {}
    for i, x in enumerate(w):
        for j in places.get(x, ()):
            on.setdefault(i - j, []).append(i)
    need = min(least, len(v))
    for d, at in on.items():
        if len(v) < 5 or 100 * len(at) < percent * need:
            continue
        if len(v) < least:
            if 0 <= d <= len(w) - len(v) and 100 * len(at) >= percent * len(v):
                return True
        elif any(at[b] - at[a] + 1 >= least and 100 * (b - a + 1) >= percent * (at[b] - at[a] + 1) for a in range(len(at)) for b in range(a, len(at))):
            return True
    return False


def test_run_against_plain_python(spark):
    """run() row by row: grades summed text by text, all pairs, windows counted in a dictionary, all diagonals, tiktoken."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = train(docs, queries.grades(spark, SF), n_grades=3)
    above = [1 / (1 + np.exp(model.thresholds[1] - sum(model.weights[x].sum() for x in features(pa.array([t], pa.string()))))) for _, t in rows]
    rows = [r for r, p in zip(rows, above) if p >= 0.5]
    rows = [r for r, (i, _, least) in zip(rows, brute(rows, 5, 80)) if i == least]
    where = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 34):
            where.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {}
    for at in where.values():
        for i, k in at if len(at) > 1 else ():
            gone.setdefault(i, set()).update(range(k, k + 35))
    cut = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(gone.get(i, ())) < len(w) or i not in gone:
            cut.append((i, " ".join(x for k, x in enumerate(w) if k not in gone[i]) if i in gone else t))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in cut if not any(overlaps(t, x) for x in items)}
    c = codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(clean) < len(cut) and set(got) == set(clean)
    for i, t in clean.items():
        assert list(got[i]["ids"]) == c.library.encode_ordinary(t or "") and got[i]["n_tokens"] == len(got[i]["ids"])
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_on_odd_rows(spark, docs, pairs, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, a shared and a null id, clashing columns."""
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 60)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "byte_bpe" or out.columns == docs.columns, name
        got[name] = out
    every = texts(docs)
    # All labels are good, so all rows stay; the rest is what each stage's docstring says.
    assert texts(got["quality_classifier"]) == every
    near = texts(got["ngram_join"])
    assert ("0", "None") in near and ("1", "") in near and len(near) < len(every) and set(near) <= set(every)
    cut = got["substring_dedup"].collect()
    assert all(r["n_chars"] is None or r["text"] is None or r["n_chars"] in (len(r["text"]), 1) for r in cut)
    assert ("0", "None") in texts(got["substring_dedup"]) and 11 not in {r["doc_id"] for r in cut}
    left = {r["doc_id"] for r in got["decontamination"].collect()}
    assert left == {i for i, _ in pairs} - {9, 10, 11}
    ids = got["byte_bpe"].collect()
    assert sorted(str(r["doc_id"]) for r in ids) == sorted(i for i, _ in every) and {r["n_tokens"] for r in ids if r["doc_id"] == 0} == {0}
