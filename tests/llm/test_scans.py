import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from tidewell.llm import decontamination as dc
from tidewell.llm.licenses import LEAST, TEMPLATES, Scanner, bigrams, dice, license_scan, normalised, statements
from tidewell.llm.licenses import pairs as pairs_of

from .conftest import prose


def test_masks_meet_two_substitutions_in_thirteen_words():
    for a in range(13):
        for b in range(a, 13):
            assert any(not {a, b} & {s + i for i in m} for m in dc.MASKS for s in range(13 - m[-1]))


def test_short_masks_meet_every_allowed_substitution():
    """Of each short item one mask at least is whole, whatever words are replaced; all lengths together need few masks."""
    for percent in (60, 80, 90, 100):
        for n in range(1, 13):
            most = n - max(1, -(-percent * n // 100))
            for gone in combinations(range(n), most):
                assert any(not set(gone) & set(m) for m in dc.short_masks(n, percent)), (n, percent, gone)
    masks, own = dc._masks(list(range(5, 13)), 80)
    assert len(masks) <= 44 and all(len(m) >= 4 for m in masks) and set(own) == set(range(5, 13))


def test_run_hashes_depend_on_the_picked_words_alone():
    h = np.arange(1, 41, dtype=np.uint64) ** np.uint64(7)
    masks, _ = dc._masks([5, 8, 10, 12], 80)
    before = list(dc._hashed(h, masks))
    h[20] += np.uint64(1)
    for m, x, y in zip(masks, before, dc._hashed(h, masks)):
        assert x.size == 40 - m[-1]
        assert [i for i in range(x.size) if x[i] != y[i]] == [20 - k for k in reversed(m)]


def test_planted_passages(spark):
    items = [(i, prose(500 + i, 15 + 3 * i)) for i in range(10)] + [(90, prose(500, 15)), (91, "too short"), (92, None), (None, ""), (93, "one two three four five six")]
    r, rows, want = random.Random(1), [], set()
    for i in range(10):
        words = prose(500 + i, 15 + 3 * i).split()
        rows.append((i, prose(900 + i, 40) + " " + " ".join(words) + ". " + prose(950 + i, 20)))
        swapped = list(words)
        for k in r.sample(range(2, len(words) - 2), 2):
            swapped[k] = "zzz"
        rows.append((100 + i, prose(800 + i, 30) + "\n" + " ".join(swapped).upper().replace("É", "é")))
        rows.append((200 + i, prose(700 + i, 60)))
        want |= {(i, i), (100 + i, i)}
    rows += [(300, "x one, two three FOUR five six y"), (301, "one two zzz four five"), (302, None), (303, ""), (0, rows[0][1])]
    want.add((300, 93))
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_ids"][0]) for r in got} == want and len(got) == len(want)
    assert next(r["item_ids"] for r in got if r["doc_id"] == 0) == [0, 90]


def test_decontaminate_edges(spark, docs, empty, pairs):
    items = spark.createDataFrame([(1, prose(2, 60)), (2, None)], "item_id long, text string")
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert not {9, 10, 11} & left and len(left) == len({i for i, _ in pairs}) - 3
    assert dc.decontaminate(docs, items.limit(0)).count() == len(pairs)
    assert dc.decontaminate(empty, items).count() == 0


def test_best_overlap():
    item = np.arange(20, dtype=np.uint64)
    text = np.concatenate([np.full(5, 99, np.uint64), item])
    text[10] = 77
    assert dc.best_overlap(text, item, 5, 80) == (5, 20, 19)
    assert dc.best_overlap(text, item, 30, 80) == (30, 0, 0)


def test_best_overlap_by_brute_force():
    r = random.Random(5)
    for _ in range(400):
        item = np.arange(r.randrange(1, 45), dtype=np.uint64)
        text = np.concatenate([np.full(r.randrange(4), 99, np.uint64), item, np.full(r.randrange(4), 99, np.uint64)])
        for _ in range(r.randrange(5)):
            a = r.randrange(text.size)
            text[a : a + r.randrange(1, 6)] = 77
        d, percent = r.randrange(-2, 6), r.choice([60, 75, 80, 90])
        equal = [0 <= p - d < item.size and text[p] == item[p - d] for p in range(text.size)]
        fits = [(b - a, sum(equal[a:b]), -a) for a in range(text.size) for b in range(a + 1, text.size + 1) if equal[a] and equal[b - 1] and 100 * sum(equal[a:b]) >= percent * (b - a)]
        got = dc.best_overlap(text, item, d, percent)
        assert (got[1], got[2], -got[0]) == max(fits) if fits else got[1:] == (0, 0)


def test_clustered_substitutions(spark):
    patterns = ["=" * 8 + "x" * 3 + "=" * 9, "=" * 12 + "x" * 4 + "=====x" * 2 + "=" * 5]
    items, rows = [], []
    for i, pattern in enumerate(patterns):
        words = prose(520 + i, len(pattern)).split()
        items.append((i, " ".join(words)))
        rows.append((i, prose(620 + i, 30) + " " + " ".join("zzz" if c == "x" else w for w, c in zip(words, pattern)) + " " + prose(720 + i, 30)))
    # Twelve words at one place are too few; they must not hide eleven of thirteen at another.
    words = prose(530, 30).split()
    items.append((2, " ".join(words)))
    near = [*words[17:22], "zzz", "zzz", *words[24:30]]
    rows.append((2, " ".join([*words[:12], *prose(730, 40).split(), *near])))
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_ids"][0], r["n_overlap"], r["n_equal"]) for r in got} == {(0, 0, 20, 17), (1, 1, 33, 27), (2, 2, 13, 11)}


def test_short_items_with_every_substitution(spark):
    items, rows, want = [], [], set()
    for n in range(5, 13):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for most in (n // 5, n // 5 + 1):
            for places in combinations(range(n), most):
                text = " ".join("zzz" if i in places else w for i, w in enumerate(words))
                rows.append((len(rows), f"before it {text} after it"))
                want |= {(len(rows) - 1, n)} if most == n // 5 else set()
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_ids"][0]) for r in got} == want
    assert all((r["start"], r["n_overlap"]) == (2, r["n_item_words"]) for r in got)


ALL = TEMPLATES | statements()


def test_licences(spark, docs, empty, pairs):
    s = Scanner(ALL, LEAST)
    for name, t in ALL.items():
        for text in (t, prose(3, 30) + "\n" + t.upper() + "\n" + prose(4, 50), prose(5, 10) + " " + t + " " + prose(6, 400)):
            got = s.scan(text)
            assert [(f.license, f.dice) for f in got] == [(name.split("#")[0], 1.0)], name
            assert " ".join(normalised(text)[got[0].first :][: got[0].words]) == " ".join(normalised(t))
    near = TEMPLATES["MIT"].replace("obtaining", "getting").replace("limitation", "limits")
    assert s.scan(near)[0].license == "MIT" and LEAST <= s.scan(near)[0].dice < 1
    assert s.scan(prose(6, 300)) == []
    both = TEMPLATES["MIT"] + "\n\n" + prose(8, 20) + "\n" + TEMPLATES["Apache-2.0"] + " SPDX-License-Identifier: ISC"
    assert {f.license for f in s.scan(both)} == {"MIT", "Apache-2.0", "ISC"} and s.scan(both)[0].license == "MIT"
    assert [f.license for f in s.scan("// licensed under GPLv2\nLicense: MIT")] == ["GPL-2.0", "MIT"]
    assert license_scan(docs).count() == len(pairs) and license_scan(docs).where("license is not null").count() == 0
    assert license_scan(empty).count() == 0
    rows = [(1, both), (2, None), (3, "\u0130 \u212a"), (4, "LICENSE: MIT."), (None, "License: ISC")]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [f["license"] for f in got[1]["found"]] == [f.license for f in s.scan(both)]
    assert (got[2]["license"], got[2]["dice"], got[3]["license"], got[4]["license"], got[None]["license"]) == (None, 0.0, None, "MIT", "ISC")


def slow_scan(text, templates):
    """All templates against the whole text, its paragraphs and lines, and every run of a template's size that begins in it."""
    words, found, at = normalised(text), set(), 0
    parts = [(0, words)]
    for paragraph in text.split("\n\n"):
        parts.append((at, normalised(paragraph)))
        for line in paragraph.split("\n"):
            parts.append((at, normalised(line)))
            at += len(normalised(line))
    grams = pairs_of(words)
    for name, t in templates.items():
        own = bigrams(normalised(t))
        runs = [(bigrams(w), a, len(w)) for a, w in parts]
        runs += [(type(own)(grams[i : i + own.total()]), i, min(own.total(), len(grams) - i) + (len(words) > 1)) for i in range(len(grams)) if grams[i] in own]
        found |= {(-(g & own).total(), -dice(g, own), name, a, n) for g, a, n in runs if dice(g, own) >= LEAST}
    out = []
    for _, d, name, a, n in sorted(found):
        if all(a + n <= b or b + m <= a for _, _, b, m in out):
            out.append((name.split("#")[0], -d, a, n))
    return out


def test_licences_against_all_stretches():
    s, r, hits, several, kept, edited = Scanner(ALL, LEAST), random.Random(12), 0, 0, 0, 0
    for trial in range(60):
        text = prose(60 + trial, r.randrange(30))
        for _ in range(r.randrange(1, 4)):
            name = r.choice([*TEMPLATES, *r.sample(list(ALL), 5)])
            words = ALL[name].split()
            for _ in range(r.randrange(1 + len(words) // 6)):
                k = r.randrange(len(words))
                words[k : k + r.randrange(2)] = [r.choice(["this", "new", "the", "licence"])]
            text += r.choice([" ", "\n", "\n\n"]) + " ".join(words) + r.choice([" ", "\n"]) + prose(160 + trial, r.randrange(30))
        got = s.scan(text)
        assert [(f.license, round(f.dice, 9), f.first, f.words) for f in got] == [(n, round(d, 9), a, m) for n, d, a, m in slow_scan(text, ALL)], text
        hits += bool(got)
        several += len({f.license for f in got}) > 1
        assert not got or s.worth_scanning(pa.array([text]))[0]
    assert 40 < hits and 10 < several


def test_edited_notices_are_found():
    """One word in twenty replaced, dropped or added: nine of ten notices are still found."""
    s, r, found, n = Scanner(ALL, LEAST), random.Random(30), 0, 0
    for name, t in TEMPLATES.items():
        for _ in range(10 if len(t.split()) > 25 else 0):
            words = t.split()
            for _ in range(len(words) // 20):
                k = r.randrange(len(words))
                words[k : k + r.randrange(2)] = r.choice([["thing"], [], ["other", words[k]]])
            n += 1
            found += name.split("#")[0] in {f.license for f in s.scan(prose(n, 40) + " " + " ".join(words) + " " + prose(n + 1, 40))}
    assert n >= 100 and found >= 0.9 * n


def test_size_bounds_lose_nothing():
    s = Scanner(TEMPLATES, LEAST)
    for n in range(1, 400):
        for size, name in s.by_size:
            if 2 * min(n, size) / (n + size) >= LEAST:
                assert name in s.candidates(n)


def slow_contaminated(rows, items):
    """Every item against every text on every diagonal: the rule itself, on words."""
    word = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "")]
    out = set()
    for i, text in rows:
        w = word(text)
        for j, item in items:
            v = word(item)
            for d in range(-len(v), len(w)):
                same = [0 <= p - d < len(v) and w[p] == v[p - d] for p in range(len(w))]
                if len(v) < 5:
                    continue
                if len(v) < 13:
                    if 0 <= d <= len(w) - len(v) and sum(same[d : d + len(v)]) * 100 >= 80 * len(v):
                        out.add((i, j))
                    continue
                sums = [0]
                for x in same:
                    sums.append(sums[-1] + x)
                if any(same[a] and same[b - 1] and (sums[b] - sums[a]) * 100 >= 80 * (b - a) for a in range(len(w)) for b in range(a + 13, len(w) + 1)):
                    out.add((i, j))
    return out


def test_contaminated_against_all_diagonals(spark):
    r = random.Random(21)
    items = [(n, prose(2000 + n, n)) for n in (4, 5, 6, 8, 10, 12, 13, 15, 18, 21, 26)]
    rows = []
    for n, item in items:
        for most in range(n // 5 + 2):
            for _ in range(3):
                words = item.split()
                for k in r.sample(range(n), most):
                    words[k] = "Zzz"
                low = r.randrange(3) if n > 12 else 0
                rows.append((len(rows), f"{prose(3000 + len(rows), r.randrange(20))} {' '.join(words[low:])}. {prose(4000 + len(rows), r.randrange(20))}"))
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    mine, all_ = {(x["doc_id"], i) for x in got for i in x["item_ids"]}, slow_contaminated(rows, items)
    # Three substitutions or more in stretches of 15 words and more may leave no mask a place; nothing else is lost.
    assert mine <= all_ and len(all_ - mine) <= len(all_) // 50 and len(all_) > 60


def test_short_items_and_whole_texts_on_request(spark):
    item = prose(71, 700)
    words = item.split()
    for k in range(300, 440, 3):
        words[k] = "zzz"
    rows = [(0, " ".join(words)), (1, "just two words"), (2, prose(72, 40))]
    items = [(0, item), (1, "two words"), (2, "two other")]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_ids"][0]): r["n_overlap"] for r in dc.contaminated(*frames, min_item_words=1, reach=None).collect()}
    assert got == {(0, 0): 700, (1, 1): 2}
    assert {r["doc_id"] for r in dc.contaminated(*frames).collect()} == {0}
