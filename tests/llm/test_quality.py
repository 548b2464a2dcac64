import re

import numpy as np
import pyarrow as pa

from tidewell.llm import quality_classifier as qc
from tidewell.llm.quality_rules import quality_rules, quantiles, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {t for t in threes if threes.count(t) > 1} if len(threes) < 400 else {t for t, n in __import__("collections").Counter(threes).items() if n > 1}
    covered = {j for i, t in enumerate(threes) if t in again for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rules(docs, pairs, empty):
    got = quality_rules(docs).collect()
    key = lambda r: (str(r[0]), r[1:])
    mine = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=key)
    assert mine == sorted(((i, *base(t)) for i, t in pairs), key=key)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules(empty).count() == 0


def test_limits_follow_the_group(spark):
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(60)), "en", "s") for i in range(80)]
    odd = [(1000, " ".join(f"w{j}#%#%" for j in range(60)), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert got.pop(1000) is False and all(got.values())


def test_sketch_holds_quantiles(spark):
    v = [int(x) for x in np.random.default_rng(1).lognormal(6, 2, 3000)]
    df = spark.createDataFrame([("g", x) for x in v], "g string, v long")
    q = quantiles(sketches(df, ["g"], ["v"]), ["g"], a=25, b=75).first()
    for p, x in ((25, q["a"]), (75, q["b"])):
        true = sorted(v)[-(-len(v) * p // 100) - 1]
        assert x <= true <= x * (1 + 1 / 64) + 1


def graded(n, seed=3):
    r = np.random.default_rng(seed)
    common = [f"common{i}" for i in range(300)]
    out = []
    for i in range(n):
        g = i % 3
        words = list(r.choice(common, 40)) + [f"rare{i}"]
        words += ["awful"] * (g == 1) + ["good"] * (g == 2)
        out.append((i, " ".join(w + ("##" if g == 0 else "") for w in words), g))
    return out


def test_classifier_on_held_out_rows(spark):
    rows = graded(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, graded string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i < 600], "doc_id long, grade int")
    model = qc.train(docs, labels, 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r["graded"] for r in qc.classify(docs, model, wanted=2).collect()}
    held = [(got[i]["kept"], g == 2) for i, _, g in rows if i >= 600]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= x["expected_grade"] <= 2 for x in got.values())
    few = qc.train(docs, labels, 3, max_rows=30)
    assert few.weights.shape == model.weights.shape


def plain_fit(rows, grades, n_grades, n_features, l1, steps=30_000):
    """The same objective by plain proximal gradient steps on dense rows: negative mean log likelihood plus L1."""
    x = np.zeros((len(rows), n_features))
    for i, r in enumerate(rows):
        x[i, r] = 1
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)])
    w, t, step = np.zeros(n_features), np.log((1 - share) / share), 0.05

    def probabilities(w, t):
        upper = 1 / (1 + np.exp(t[None, :] - (x @ w)[:, None]))
        upper = np.concatenate([np.ones((len(x), 1)), upper, np.zeros((len(x), 1))], axis=1)
        return upper, upper[np.arange(len(x)), grades] - upper[np.arange(len(x)), grades + 1]

    for _ in range(steps):
        upper, mass = probabilities(w, t)
        low, high = upper[np.arange(len(x)), grades], upper[np.arange(len(x)), grades + 1]
        w = w - step * (x.T @ (low + high - 1)) / len(x)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        slope = upper * (1 - upper)
        t = np.sort(t - step * np.array([(slope[:, k + 1] * ((grades == k + 1) / mass - (grades == k) / mass)).mean() for k in range(n_grades - 1)]))
    return w, t, lambda w, t: -np.log(probabilities(w, t)[1]).mean() + l1 * np.abs(w).sum()


def test_fit_against_a_plain_optimiser():
    r = np.random.default_rng(8)
    rows = [np.flatnonzero(r.random(12) < 0.3) for _ in range(150)]
    true = r.normal(0, 1.5, 12) * (r.random(12) < 0.6)
    scores = np.array([true[x].sum() for x in rows]) + r.logistic(0, 1, len(rows))
    grades = (scores > -0.5).astype(int) + (scores > 1)
    for l1 in (1e-3, 2e-2):
        model = qc.fit(np.concatenate(rows), np.array([x.size for x in rows]), grades, 3, bits=4, l1=l1)
        w, t, loss = plain_fit(rows, grades, 3, 12, l1)
        assert loss(model.weights[:12], model.thresholds) <= loss(w, t) + 1e-4
        assert np.abs(model.weights[:12] - w).max() < 0.05 and np.abs(model.thresholds - t).max() < 0.05


def test_training_rows_are_spread_and_bounded(spark):
    """Repeated documents beyond max_rows: equal rows count once, and the labelled rows' features lie in many files."""
    rows = graded(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [rows[5][:2]] * 2000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    model = qc.train(docs, labels, 3, max_rows=300)
    again = qc.train(docs.dropDuplicates(), labels, 3, max_rows=300)
    assert np.allclose(model.weights, again.weights) and model.weights.any()
    less = qc.train(docs, labels, 3, max_rows=100)
    assert less.thresholds.size == 2


def test_classifier_on_odd_texts(spark):
    """One very long word, and 20,000 distinct words, in training and in grading."""
    rows = graded(120) + [(500, "w" * 300_000, 0), (501, " ".join(f"u{i}" for i in range(20_000)), 2)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = qc.train(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), 3)
    got = {r["doc_id"]: r["graded"] for r in qc.classify(docs, model, wanted=2).collect()}
    assert len(got) == len(rows) and all(np.isfinite(g["score"]) for g in got.values())


def test_classifier_edges(spark, docs, empty, pairs):
    model = qc.train(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert not model.weights.any() and model.thresholds.size == 2
    got = qc.classify(docs, model, wanted=2)
    assert got.count() == len(pairs) and got.columns == docs.drop("graded").columns + ["graded"]
    assert got.where("graded.kept").count() == len(pairs)
    assert qc.classify(empty, model, wanted=2).count() == 0
    one = qc.fit(np.array([1, 2] * 20, np.int32), np.full(20, 2), np.zeros(20, np.int64), 3)
    assert not one.weights.any() and one.thresholds.size == 2
    x = list(qc.features(pa.array([None, "", "A b"])))
    assert (x[0] == x[1]).all() and len(x[2]) > len(x[0])


def test_labels_without_a_grade(spark):
    rows = graded(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [rows[4][:2]], "doc_id long, text string")
    label = lambda keep: spark.createDataFrame([(i, g) for i, _, g in rows if g in keep] + [(None, 0), (5, None), (77777, 1), (6, 9)], "doc_id long, grade int")
    for keep, most in (((0,), 0), ((0, 1), 0), ((2,), 301), ((0, 2), None)):
        model = qc.train(docs, label(keep), 3)
        kept = qc.classify(docs, model, wanted=2).where("graded.kept").count()
        assert model.thresholds.size == 2 and list(model.thresholds) == sorted(model.thresholds)
        assert kept == most if most is not None else 100 <= kept < 301


def test_features_that_tell_are_counted_whole(spark):
    """The spread-out sums choose the features that one pass over all rows would."""
    rows = graded(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    model = qc.train(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), 3, l1=0.0, steps=3)
    x = list(qc.features(pa.array([t for _, t, _ in rows])))
    g = np.array([g for _, _, g in rows])
    docs_, total = np.zeros(1 << qc.BITS, np.int64), np.zeros(1 << qc.BITS)
    for f, v in zip(x, g):
        docs_[f] += 1
        total[f] += v
    assert (np.flatnonzero(model.weights) == np.flatnonzero(qc.telling(docs_, total, 300, g.mean(), g.std()))).all()
