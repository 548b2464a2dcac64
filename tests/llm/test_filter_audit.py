import re
from itertools import permutations

import pytest

from tidewell.llm import filter_audit as fa


def mask(text, same):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), same]
    return sum(f << i for i, f in enumerate(fails))


def brute(rows, labels):
    """Every filter order applied to every document, one step after another."""
    docs = []
    for key, text, part in rows:
        same = key is not None and any(k is not None and k < key and (t or "") == (text or "") for k, t, _ in rows)
        docs.append((part or "", mask(text, same), any(k == key and q == 1 for k, q, _ in labels if key is not None), any(k == key and x == 1 for k, _, x in labels if key is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        own, taken = [d[1:] for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [d for d in left if d[0] & bit]
                failing = sum(1 for d in own if d[0] & bit)
                left = [d for d in left if not d[0] & bit]
                taken[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[0] == bit for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(taken[f])
    return out


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 16)] + [(5, 0, 1), (5, None, None), (None, 1, 1), (99, 1, 1), (3, None, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_brute_force(docs, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = fa.filter_audit(docs, labels[1]).collect()
    want = brute(rows, labels[0])
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        assert [r[m] for m in fa.METRICS] == want[r["part"], r["filter_order"], r["step"]]
        assert r["filter_order"][r["step"] - 1] == r["filter"]


def test_copies_of_one_text(spark, labels):
    """Copies of many ids, two languages, null and repeated ids: all but the rows of the smallest id and of none fail E."""
    rows = [(i, "same", "en" if i % 2 else "de") for i in range(50, 90)] + [(50, "same", "fr"), (None, "same", "en"), (None, None, "en"), (3, "", "en"), (4, None, "en")]
    cells = fa.mask_cells(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), labels[1]).collect()
    assert sum(r["n"] for r in cells) == len(rows)
    passing = {}
    for r in cells:
        if not r["mask"] & 16:
            passing[r["part"]] = passing.get(r["part"], 0) + r["n"]
    assert passing == {"de": 1, "fr": 1, "en": 3}


def test_empty(empty, docs, labels):
    assert fa.filter_audit(empty, labels[1]).count() == 0
    got = fa.filter_audit(docs, labels[1].limit(0))
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() > 0


def test_no_document_leaves_its_shuffle_whole(docs, labels):
    """What is shuffled are counts: the plan has no exchange with the text."""
    plan = fa.filter_audit(docs, labels[1])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
