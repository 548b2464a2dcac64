import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import ngram_join as nj
from tidewell.llm import substring_dedup as sd
from tidewell.llm.components import components
from tidewell.llm.decontamination import decontaminate
from tidewell.llm.sharding import shard_documents

from .conftest import prose


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def shingle_set(text, k):
    w = lower((text or "").encode()).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """component id by row."""
    sets = [shingle_set(t, k) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    out = []
    for r, p in zip(rows, part):
        ids = [x[0] for x, q in zip(rows, part) if q == p and x[0] is not None]
        out.append((r[0], len(sets[rows.index(r)]), (min(ids) if ids else None) if sets[rows.index(r)] else r[0]))
    return out


def key(x):
    return tuple(map(str, x))


def edited(seed):
    """Families of texts with few and many edits, chains, shared passages, and repeated phrases."""
    r, rows = random.Random(seed), []
    for f in range(6):
        words = prose(100 + f, r.choice([12, 40, 90])).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"e{r.randrange(30)}"
            rows.append((len(rows), " ".join(w)))
    shared = prose(55, 30)
    rows += [(len(rows) + i, shared + " " + prose(300 + i, r.choice([2, 4, 30]))) for i in range(20)]
    return rows


@pytest.mark.parametrize("frequent", [2, 40])
def test_join_against_brute_force(spark, monkeypatch, frequent):
    rows = edited(4)
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    monkeypatch.setattr(nj, "BLOCK_ROWS", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.ngram_join(df).collect()), key=key) == sorted(brute(rows, 4, 85), key=key)


def test_join_edges(docs, pairs, empty):
    got = sorted((tuple(r) for r in nj.ngram_join(docs).collect()), key=key)
    assert got == sorted(brute(pairs, 4, 85), key=key)
    assert nj.ngram_join(empty).count() == 0


def test_prefixes_meet():
    r = np.random.default_rng(5)
    for trial in range(300):
        n = int(r.integers(2, 120))
        x = np.unique(r.integers(1, 1 << 62, n).astype(np.uint64))
        lost = int(r.integers(0, max(1, x.size // 6)))
        y = np.unique(np.concatenate([r.permutation(x)[lost:], r.integers(1, 1 << 62, int(r.integers(0, max(1, x.size // 8)))).astype(np.uint64)]))
        both = np.intersect1d(x, y).size
        if x.size < 2 or 100 * both < 85 * (x.size + y.size - both):
            continue
        often = lambda s: (s >> np.uint64(5) & np.uint64(7)) < int(trial % 9)  # noqa: E731, B023
        assert np.intersect1d(nj.signatures(x, often(x), 85), nj.signatures(y, often(y), 85)).size


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(6)
    for n in (3, 400, 700, 3000):
        x = np.unique(r.integers(1, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 8 :], r.integers(1, 1 << 62, n // 3).astype(np.uint64)]))
        a, b = (np.frombuffer(nj.parity_bitmap(s), np.uint64) for s in (x, y))
        assert nj.parity_distance(a, b) <= np.setxor1d(x, y).size


def all_near(n, part, side, parity, group, percent):
    """Every pair that sizes and bitmaps allow, one at a time."""
    out = set()
    for x in range(len(n)):
        for y in range(x):
            if group[x] != group[y] or part[x] == part[y] or (side[x] != 2 and side[x] == side[y]):
                continue
            small, large = sorted((int(n[x]), int(n[y])))
            a, b = (np.frombuffer(parity[k], np.uint64) for k in (x, y))
            both = (small + large - nj.parity_distance(a, b)) // 2
            if small * 100 >= large * percent and 100 * both >= percent * (small + large - both):
                out.add((y, x))
    return out


@pytest.mark.parametrize("rows", [7, 1 << 17])
def test_near_pairs_against_all_pairs(monkeypatch, rows):
    monkeypatch.setattr(nj, "PAIR_ROWS", rows)
    r = np.random.default_rng(8)
    base = r.integers(1, 1 << 62, 1200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: r.choice([90, 480, 560, 1000])], r.integers(1, 1 << 62, r.integers(1, 90)).astype(np.uint64)])) for _ in range(160)]
    n, parity = np.array([s.size for s in sets]), [nj.parity_bitmap(s) for s in sets]
    group, part = np.sort(r.integers(0, 4, 160)), r.integers(0, 60, 160)
    side = np.where(group == 0, r.integers(0, 2, 160), 2)
    class_ = r.permutation(160)
    pairs = lambda: nj.near_pairs(group, class_, n, part, side, parity, 85)
    want = all_near(n, part, side, parity, group, 85)
    got = [tuple(sorted(p)) for x, y, _ in nj.chosen_pairs(pairs(), group, part, None) for p in zip(x.tolist(), y.tolist())]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    near = {tuple(sorted((int(x), int(y)))): v for a, b, c in pairs() for x, y, v in zip(a, b, c)}
    (x, y, cut), = nj.chosen_pairs(pairs(), group, part, 1)
    some = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    for g in range(4):
        own = {p for p in want if group[p[0]] == g}
        if len(own) <= nj.FEW * int((group == g).sum()):
            assert own <= some and g not in cut
        else:
            assert g in cut
            for q in {part[k] for p in own for k in p}:
                best = max(near[p] for p in own if q in (part[p[0]], part[p[1]]))
                assert any(near[p] == best for p in some & own if q in (part[p[0]], part[p[1]]))


@pytest.mark.parametrize("few", [0, 4])
def test_join_with_nearest_pairs_only_first(spark, monkeypatch, few):
    rows = edited(11)
    monkeypatch.setattr(nj, "FEW", few)
    monkeypatch.setattr(nj, "NEAREST", (1,))
    monkeypatch.setattr(nj, "FREQUENT", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.ngram_join(df).collect()), key=key) == sorted(brute(rows, 4, 85), key=key)


def test_near_copies_removed(docs, pairs, empty):
    got = nj.near_copies_removed(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    ids = [i for i, _ in kept]
    assert 5 in ids and ids.count(5) == 1 and not {6, 7} & set(ids) and {0, 1, 2, 8} <= set(ids) and ids.count(3) == 2
    assert None not in ids
    assert nj.near_copies_removed(empty).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(-50, 50), r.randrange(-50, 50)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(60)]
    part = {n: n for e in edges for n in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: p for n, p in part.items() if n in got} and set(part) - set(got) <= {a for a, b in edges if a == b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(rows, window):
    seen = {}
    words = [(t or "").encode().split() for _, t in rows]
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for j in range(p, p + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window,gram", [(35, 8), (12, 4)])
def test_passages(docs, pairs, empty, window, gram):
    got = sd.substring_dedup(docs, window, gram)
    assert got.columns == [c for c in docs.columns if c != "dedup"] + ["dedup"]
    mine = [(r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], hashlib.sha256(r["dedup"]["kept"].encode()).hexdigest()) for r in got.collect()]
    assert sorted(mine, key=key) == cut(pairs, window)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["dedup"]["spans"]) == r["dedup"]["n_removed"]
    assert sd.substring_dedup(empty).count() == 0


def test_helper_names_stay(spark):
    names = ["_d", "_t", "_k", "_h", "_s", "_p", "_D_"]
    base = prose(1, 120)
    rows = [(i, t, *range(7)) for i, t in enumerate([base, base, prose(3, 50) + " " + base, None, prose(9, 60)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    for out in (nj.near_copies_removed(df), decontaminate(df, spark.createDataFrame([(1, prose(9, 20))], "item_id long, text string")), sd.substring_dedup(df).drop("dedup")):
        assert out.columns == df.columns
        assert all(tuple(r)[2:] == tuple(range(7)) for r in out.collect())
        assert out.count() > 0


def removed(spark, rows, window, gram):
    got = sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window, gram).collect()
    return sorted(((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], hashlib.sha256(r["dedup"]["kept"].encode()).hexdigest()) for r in got), key=key)


@pytest.mark.parametrize("small", [{"ANCHOR_BITS": 8, "HOME_BITS": 8}, {"PASSAGES": 2, "STRETCHES": 3, "SHARED": 0}, {"PASSAGES": 5, "SHARED": 1}])
def test_passages_whatever_the_sizes(spark, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(sd, name, value)
    rows = edited(7)
    assert removed(spark, rows, 10, 3) == cut(rows, 10)


def test_passages_of_few_words(spark):
    """Repeats at every distance, and passages that share their middles with many others."""
    r = random.Random(3)
    middle = prose(77, 14)
    rows = [(i, " ".join(r.choice("ab") for _ in range(60))) for i in range(4)] + [(10, "ha " * 90), (11, "ho hum " * 40)]
    rows += [(100 + 2 * i + k, f"{prose(400 + i, 6)} {middle} {prose(500 + i, 6)}") for i in range(25) for k in (0, 1)]
    assert removed(spark, rows, 12, 4) == cut(rows, 12)


def test_anchor_places():
    r = np.random.default_rng(2)
    g = r.integers(0, 50, 200).astype(np.uint64)
    assert (sd.anchor_places(g, 28) == np.array([i + int(np.argmin(g[i : i + 28])) for i in range(173)])).all()
    assert sd.anchor_places(g[:5], 28).size == 0


def stretch_rows(text, window, gram):
    s = sd.Stretches(pa.array([text]), window, gram)
    return s, s.texts()


def test_only_the_automaton_finds_occurrences():
    """Occurrences come from the compiled phrases: without them, or with others, nothing is found."""
    passage, window, gram = prose(31, 40), 12, 4
    home, words = stretch_rows(passage, window, gram)
    masks = np.array([(1 << int(c)) - 1 for c in home.count])
    phrases = sd.Phrases(words, masks, window)
    text = f"{prose(32, 30)} {passage} {prose(33, 30)}"
    found, others = stretch_rows(text, window, gram)
    laid, start, _ = sd._hashes(others, window, 1)
    covered = lambda p: {int(found.first[k]) + int(i - start[k]) for i in np.flatnonzero(p.covered(laid)) for k in [int(np.searchsorted(start, i, "right")) - 1]}
    assert covered(phrases) == set(range(30, 70))
    assert covered(sd.Phrases(words.slice(0, 0), masks[:0], window)) == set()
    unlike, far = stretch_rows(prose(34, 40), window, gram)
    assert covered(sd.Phrases(far, np.array([(1 << int(c)) - 1 for c in unlike.count]), window)) == set()
    import ahocorasick

    none = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    none.add_word("none", 0)
    none.make_automaton()
    phrases.automaton = none
    assert covered(phrases) == set()


def test_shards(spark, docs, pairs, empty):
    import zlib

    got = shard_documents(docs, shards=4).collect()
    assert len(got) == len(pairs)
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    raw = lambda t: (t or "").encode()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in pairs)
    assert shard_documents(empty, shards=4).count() == 0


def test_shards_keep_groups_together(spark):
    rows = [(i, f"group {i // 4}") for i in range(120)] + [(1000 + i, f"alone {i}") for i in range(200)] + [(5000 + i, "huge") for i in range(160)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    text = dict(rows)
    where = {}
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    groups = [v for k, v in where.items() if k.startswith("group")]
    assert sum(len(v) == 1 for v in groups) >= 27 and len(where["huge"]) <= 4


def test_pairs_leave_full_shards(spark):
    """Two copies in a full shard and a free one come together in the free one, and no group's cut edges grow."""
    from tidewell.llm.sharding import propagate

    state = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("b", 0, 3), ("c", 1, 2), ("c", 0, 1)], "g string, shard int, n long")
    got, moved = propagate(state, [5, 9], 1)
    assert {(r["g"], r["shard"], r["n"]) for r in got.collect()} == {("a", 1, 2), ("b", 0, 3), ("c", 1, 3)} and moved == 2
    assert propagate(got, [5, 9], 1)[1] == 0


def plain_propagation(sizes, shards, quotas, rounds, seed):
    """Groups one after the other move to the shard that holds most of them and has room; the counts by group and shard."""
    r = random.Random(seed)
    state = []
    for n in sizes:
        held = [0] * shards
        for _ in range(n):
            held[r.randrange(shards)] += 1
        state.append(held)
    for _ in range(rounds):
        for held in state:
            room = [q - sum(h[s] for h in state) for s, q in enumerate(quotas)]
            home = max(range(shards), key=lambda s: (held[s] + max(0, room[s]) >= sum(held), held[s], -s))
            for s in range(shards):
                if s != home:
                    moved = min(held[s], max(0, room[home]))
                    held[s] -= moved
                    held[home] += moved
                    room[home] -= moved
    return state


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_cut_no_more_than_a_plain_propagation(spark, seed):
    """Links of equal texts that lie in different shards: as few as a plain propagation leaves, and evenly filled shards."""
    r = random.Random(seed)
    sizes = [130, *(r.randrange(2, 20) for _ in range(30))]
    rows = [(g, f"text of group {g}") for g, n in enumerate(sizes) for _ in range(n)]
    rows += [(1000 + i, f"alone {i}") for i in range(200)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    shards = 8
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards).collect()
    text = dict(rows)
    held, filled = {}, [0] * shards
    for x in got:
        filled[x["shard"]] += 1
        held.setdefault(text[x["doc_id"]], [0] * shards)[x["shard"]] += 1
    assert sum(filled) == len(rows) and max(filled) - min(filled) <= 1
    cut = lambda state: sum((sum(h) ** 2 - sum(n * n for n in h)) // 2 for h in state)
    quotas = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    plain = [cut(plain_propagation(sizes, shards, quotas, 8, k)) for k in range(3)]
    assert cut(held.values()) <= sum(plain) / len(plain) * 1.1, (cut(held.values()), plain)
