"""Benchmark decontamination by spaced seeds.

A mask picks some of the words of a stretch and ignores the others, so a passage whose words were replaced at ignored
places still gives the same hash. Hashes of all masks at all places of the training texts are joined with those of the
test items; around every hit the two texts are compared word by word on the hit's diagonal, and the best stretch with few
enough substitutions decides. Words are runs of ASCII letters and digits and of other code points, A-Z lower-cased.

Training hashes first pass a filter that holds the test hashes; it only spares rows, the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits, broadcast_if_small, in_bitmap, sized_bitmap, unused, written
from .words import PLAIN, Words, _mix, blocks, shingles

#: Six of up to ten words each. Together they meet every stretch of 13 words with two substitutions anywhere.
MASKS = ((0, 4, 5, 6, 7, 8), (0, 1, 4, 7, 8, 9), (0, 1, 2, 4, 5, 7), (0, 1, 3, 5, 6, 7))
#: An overlap counts from so many words (or a whole shorter item), with so many percent of them equal.
MIN_WORDS, MIN_ITEM_WORDS, MIN_EQUAL, REACH, FILTER_BITS, BROADCAST_ROWS = 13, 5, 80, 256, 24, 500_000
SEED = "seed long, item long, item_place int"


def _hashed(h: np.ndarray, masks: list[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """For each mask a hash for every place where it fits. A mask is a few runs of neighbouring words; the hashes of all
    runs of a length are made once and shared by the masks."""
    cut = [[0, *(i for i in range(1, len(m)) if m[i] != m[i - 1] + 1), len(m)] for m in masks]
    runs = [h, h]  # by length, from 1
    with np.errstate(over="ignore"):
        for size in range(2, 1 + max((j - i for c in cut for i, j in zip(c, c[1:])), default=1)):
            runs.append(runs[-1][: max(0, runs[-1].size - 1)] * np.uint64(0x9E3779B97F4A7C15) + h[size - 1 :])
    for salt, (mask, cuts) in enumerate(zip(masks, cut)):
        n = h.size - mask[-1]
        if n <= 0:
            yield np.zeros(0, np.uint64)
            continue
        with np.errstate(over="ignore"):
            out = np.full(n, (salt + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1, np.uint64)
            for i, j in zip(cuts, cuts[1:]):
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + runs[j - i][mask[i] : mask[i] + n]
            yield _mix(out)


def short_masks(n: int, percent: int) -> list[tuple[int, ...]]:
    """Choices of an item's n words of which one is whole in every copy with the share of equal words.

    With s substitutions allowed, s of 2 s blocks are whole at least; of items too short for blocks, one choice of the
    words that must be equal is.
    """
    need = max(1, -(-percent * n // 100))
    s = n - need
    if s and n >= 8 and n // (2 * s) >= 2:
        edges = [k * n // (2 * s) for k in range(2 * s + 1)]
        return [tuple(i for k in some for i in range(edges[k], edges[k + 1])) for some in combinations(range(2 * s), s)]
    return list(combinations(range(n), need))


def _masks(short: list[int], percent: int) -> tuple[list[tuple[int, ...]], dict[int, list[tuple[int, int]]]]:
    """All masks, each beginning at 0, and for each short length its (mask number, place in the item)."""
    masks, own = list(MASKS), {}
    for n in short:
        for m in short_masks(n, percent):
            moved = tuple(i - m[0] for i in m)
            if moved not in masks:
                masks.append(moved)
            own.setdefault(n, []).append((masks.index(moved), m[0]))
    return masks, own


SHORTEST = 1 + max(m[-1] for m in MASKS)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, sizes, kinds = batch.column(0).to_pylist(), [], [], []
        for first, block in blocks(batch.column(1)):
            w = Words(block, PLAIN)
            h = w.hashes(lower=True)
            for k in range(len(w)):
                own = h[w.of[k] : w.of[k + 1]]
                out.append(own.tobytes())
                sizes.append(own.size)
                kinds.append(int(shingles(own, own.size).view(np.int64)[0]) if own.size else 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(sizes, pa.int64()), pa.array(kinds, pa.int64())], names=["item_id", "words", "n_words", "kind"])


def _item_seeds(short: list[int], percent: int):
    masks, own = _masks(short, percent)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                got = list(_hashed(h, masks))
                found = [(x, np.arange(x.size)) for x in got[: len(MASKS)]] + [(got[m][p : p + 1], np.array([p])) for m, p in own.get(h.size, [])]
                values = np.concatenate([x for x, _ in found])
                at = np.concatenate([p for _, p in found])
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(values.size, kind, np.int64)), pa.array(at.astype(np.int32))], names=["seed", "item", "item_place"])

    return seeds


STRETCH = "doc_id long, text_key long, first int, words binary, hits array<struct<seed:bigint,place:int>>"


def _stretches(short: list[int], percent: int, low: bytes, high: bytes, reach: int):
    masks, _ = _masks(short, percent)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.frombuffer(low, np.uint64), np.frombuffer(high, np.uint64)
        for batch in batches:
            for first, block in blocks(batch.column(2)):
                w = Words(block, PLAIN)
                h = w.hashes(lower=True)
                values, at = [], []
                for m, v in zip(masks, _hashed(h, masks)):
                    p = np.flatnonzero(in_bitmap(a, v))
                    p = p[in_bitmap(b, v[p] >> np.uint64(32))]
                    doc = np.searchsorted(w.of, p, "right") - 1
                    p = p[p + m[-1] < w.of[doc + 1]]
                    values.append(v[p])
                    at.append(p)
                values, at = np.concatenate(values), np.concatenate(at)
                order = np.argsort(at, kind="stable")
                values, at = values[order], at[order]
                doc = np.searchsorted(w.of, at, "right") - 1
                cuts = np.concatenate([[0], np.flatnonzero((np.diff(doc) > 0) | (np.diff(at) > reach)) + 1, [at.size]]) if at.size else np.zeros(1, np.int64)
                low_hit, high_hit, own = cuts[:-1], cuts[1:] - 1, doc[cuts[:-1]] if at.size else np.zeros(0, np.int64)
                start = np.maximum(w.of[own], at[low_hit] - reach)
                end = np.minimum(w.of[own + 1], at[high_hit] + SHORTEST + reach)
                places = (at - np.repeat(start, np.diff(cuts))).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(values.view(np.int64)), pa.array(places)], names=["seed", "place"]))
                rows = pa.array(own + first)
                words = pa.array([h[x:y].tobytes() for x, y in zip(start, end)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start - w.of[own]).astype(np.int32)), words, hits], names=["doc_id", "text_key", "first", "words", "hits"])

    return find


def best_overlap(text: np.ndarray, item: np.ndarray, diagonal: int, percent: int) -> tuple[int, int, int]:
    """Place in text, length and equal words of the best stretch on a diagonal (text place less item place).

    Best: the longest stretch that begins and ends on equal words and has the share of equal words (an equal word counts
    100 - percent, another -percent, and the sum is 0 or more); of the longest the one with most equal words, then the
    first.
    """
    start, end = max(0, diagonal), min(text.size, diagonal + item.size)
    if end <= start:
        return start, 0, 0
    same = text[start:end] == item[start - diagonal : end - diagonal]
    at = np.flatnonzero(same)
    if not at.size:
        return start, 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    # From the back, the highest sum at an end so far: the first that isn't below a begin's sum is its furthest end.
    ends = np.maximum.accumulate(sums[at + 1][::-1])
    last = at.size - 1 - np.searchsorted(ends, sums[at], "left")
    length, equal = at[last] + 1 - at, last - np.arange(at.size) + 1
    k = int(np.argmax(length * (at.size + 1) + equal))
    return start + int(at[k]), int(length[k]), int(equal[k])


def whole_item(text: np.ndarray, item: np.ndarray, diagonal: int, percent: int) -> tuple[int, int, int]:
    """As best_overlap, for an item that counts as a whole only; length 0 if it isn't all there or too few words are equal."""
    if diagonal < 0 or diagonal + item.size > text.size:
        return max(0, diagonal), 0, 0
    equal = int((text[diagonal : diagonal + item.size] == item).sum())
    return (diagonal, item.size, equal) if 100 * equal >= percent * item.size else (diagonal, 0, 0)


def _verifier(percent: int, min_words: int):
    def verify(texts: pa.Array, items: pa.Array, diagonals: pa.Array, firsts: pa.Array) -> pa.Array:
        out = []
        for raw_text, raw_item, ds, first in zip(texts, items, diagonals.to_pylist(), firsts.to_pylist()):
            t, i = np.frombuffer(raw_text.as_buffer(), np.uint64), np.frombuffer(raw_item.as_buffer(), np.uint64)
            least, overlap = min(i.size, min_words), whole_item if i.size < min_words else best_overlap
            # A diagonal that is long enough goes before one that isn't, whatever their equal words.
            place, length, equal = max((overlap(t, i, d, percent) for d in sorted(ds)), key=lambda x: (x[1] >= least, x[2], x[1], -x[0]))
            out.append({"start": first + place, "n_overlap": length, "n_equal": equal})
        return pa.array(out, pa.struct([("start", pa.int64()), ("n_overlap", pa.int64()), ("n_equal", pa.int64())]))

    return F.arrow_udf(verify, "struct<start:bigint,n_overlap:bigint,n_equal:bigint>")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", percent: int = MIN_EQUAL, min_words: int = MIN_WORDS, min_item_words: int = MIN_ITEM_WORDS, reach: int | None = REACH) -> DataFrame:
    """doc_id, text_key, item_ids, n_item_words, start, n_overlap, n_equal: one row per contaminated text and test text.

    Contaminated: on one diagonal, min_words words or a whole shorter item, ``percent`` percent of them equal. item_ids:
    the items of that text, ascending, null ids last; equal items are searched once. Items of fewer than
    ``min_item_words`` words are too short to tell and match nothing (1: all items with words are searched); null texts match nothing. Rows with a null key are told apart by text_key, the
    hash of the whole text; repeated rows give one row. Empty inputs: no rows. Further columns aren't read. An overlap is
    measured over ``reach`` words on both sides of its hits; None: over whole texts.
    """
    arrow_limits(docs.sparkSession)
    reach = 1 << 40 if reach is None else reach
    wordy = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_words, "item_id long, words binary, n_words long, kind long")
    tests = wordy.where(F.col("n_words") >= max(1, min_item_words)).groupBy("kind", "words", "n_words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    tests = written(tests, "test-items")
    short = sorted(r["n_words"] for r in tests.where(F.col("n_words") < min_words).select("n_words").distinct().collect())
    seeds = written(tests.select("kind", "words").mapInArrow(_item_seeds(short, percent), SEED).distinct(), "test-seeds")
    low, high = sized_bitmap(seeds, "seed", FILTER_BITS), sized_bitmap(seeds.select(F.shiftrightunsigned("seed", 32).alias("seed")), "seed", FILTER_BITS)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    stretches = written(rows.mapInArrow(_stretches(short, percent, low, high, reach), STRETCH), "stretches")
    where = ["doc_id", "text_key", "first"]
    hits = stretches.select(*where, F.inline("hits")).join(broadcast_if_small(seeds, BROADCAST_ROWS), "seed")
    hits = hits.groupBy(*where, "item").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("diagonals"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in where]
    joined = hits.alias("h").join(stretches.select(*where, "words").alias("s"), same).select("h.*", F.col("s.words").alias("text_words"))
    joined = joined.join(broadcast_if_small(tests, BROADCAST_ROWS // 50), F.col("item") == F.col("kind"))
    found = joined.withColumn("o", _verifier(percent, min_words)("text_words", "words", "diagonals", "first")).select("doc_id", "text_key", "kind", "item_ids", F.col("n_words").alias("n_item_words"), "o.*")
    found = found.where((F.col("n_overlap") >= F.least("n_item_words", F.lit(min_words))) & (F.col("n_equal") * 100 >= F.col("n_overlap") * percent))
    best = F.max_by(F.struct("item_ids", "n_item_words", "start", "n_overlap", "n_equal"), F.struct("n_equal", "n_overlap", -F.col("start"))).alias("b")
    return found.groupBy("doc_id", "text_key", "kind").agg(best).select("doc_id", "text_key", "b.*")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all their columns, that contaminated() doesn't name."""
    d, t = unused(docs, "d", "t")
    bad = written(contaminated(docs, items, text, key, **how).select("doc_id", "text_key").distinct(), "contaminated")
    bad = broadcast_if_small(bad.select(F.col("doc_id").alias(d), F.col("text_key").alias(t)), BROADCAST_ROWS)
    return docs.join(bad, F.col(key).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left_anti")
