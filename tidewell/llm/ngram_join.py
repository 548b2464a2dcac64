"""Jaccard join on word n-grams by prefixes of token combinations.

A document is its set of k-word shingles, hashed to 64 bits. Equal sets form a class, and classes are joined. The tokens
of a set are put in one order for all sets: tokens that few documents have, then frequent ones. With n tokens and at most
t = n - ceil(similarity * n) of them missing from a partner, a prefix is cut off when it has t + 1 units: a rare token is
one unit; frequent tokens are dealt into small classes, and c of one class are c - 1 units. Whatever t tokens a partner
lacks, a rare token or two tokens of one class are left, and both lie in the prefixes of both sets (take the set whose
prefix ends first). So rare tokens are indexed singly and frequent ones as pairs within their class, and every similar
pair meets. Classes have a size that suits sets of one size range; a set uses those of its own and of the next range,
and similar sets share one at least.

Sets that meet are not all paired. Each index entry first pairs its members with its smallest member; pairs are bounded
by a parity bitmap of the sets (the overlap is at most half of what the sizes exceed the Hamming distance by), the rest
are verified on whole sets, and connected. Only entries whose members are in several components are then gone through
again, each set of members once and in blocks of bounded size: bitmaps of members of different components are compared in
place, and only pairs that they allow become rows. An entry with more of these than a few for each component gives the
nearest ones first and comes again once those are linked, at last with all that are left. So a thousand near copies cost
a thousand verifications, and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import arrow_limits, as_bitmap, broadcast_if_small, in_bitmap, sized_bitmap, unused, written
from .components import components
from .words import Words, _mix, blocks, shingles

SHINGLE, PERCENT = 4, 85
#: A token is frequent from so many documents in all, counted where a task has it twice; more of them where the filter would be over an eighth full.
FREQUENT, FILTER_BITS, ENTRY_BITS, LEAST_PARITY, BROADCAST_ROWS = 40, 23, 26, 1024, 500_000
#: Tokens that a task counts before it hands the repeated ones on.
COUNTED = 1 << 19
#: Members of an index entry that are compared at a time, and bytes of their bitmaps.
BLOCK_ROWS, BLOCK_BYTES = 4000, 8 << 20
#: Pairs of each part in the rounds before all pairs are taken; pairs for each member that need no such rounds; pairs compared at a time.
NEAREST, FEW, PAIR_ROWS = (4, 16), 4, 1 << 17
_SEED = np.uint64(0x9FB21C651E98DF25)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle; no words: none."""
    for _, block in blocks(texts):
        w = Words(block)
        h = w.hashes(lower=True)
        all_k = shingles(h, k)
        for a, b in zip(w.of[:-1], w.of[1:]):
            yield np.unique(all_k[a : b - k + 1]) if b - a >= k else shingles(h[a:b], int(b - a)) if b > a else all_k[:0]


def class_of(s: np.ndarray) -> int:
    """A class id from the set, as a signed 64-bit integer."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bits, twice the set's size or more and a power of two, each the parity of the number of tokens that fall on it."""
    size = LEAST_PARITY
    while size < 2 * s.size:
        size *= 2
    bits = np.bincount((s >> np.uint64(17) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: np.ndarray, b: np.ndarray) -> int:
    """The Hamming distance of two bitmaps (uint64), the larger one folded: no more than the tokens that only one set has."""
    while a.size > b.size:
        a = a[: a.size // 2] ^ a[a.size // 2 :]
    while b.size > a.size:
        b = b[: b.size // 2] ^ b[b.size // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def allowed_missing(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def size_range(n: int, percent: int) -> int:
    """A number that similar sets share or have next to each other: ranges whose ends differ by more than 1/similarity."""
    r, low = 0, 1
    while low <= n:
        low, r = low * 100 // percent + 1, r + 1
    return r


def classes_of_range(r: int, percent: int) -> int:
    """Classes of frequent tokens for sets of range r, about three tokens of a full prefix to each."""
    low = 1
    for _ in range(r - 1):
        low = low * 100 // percent + 1
    return max(1, allowed_missing(low, percent) // 2)


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int, range_of=size_range, classes=classes_of_range) -> np.ndarray:
    """The index entries of a set: rare tokens of its prefix, and hashed pairs of frequent tokens of one class."""
    need = allowed_missing(s.size, percent) + 1
    rare, often = s[~frequent], s[frequent]
    if rare.size >= need or s.size == 1:
        return rare[:need]
    out, need, own = [rare], need - rare.size, range_of(s.size, percent)
    for r in (own, own + 1):
        m = classes(r, percent)
        kind = (_mix(often ^ _SEED) % np.uint64(m)).astype(np.int64)
        first = np.zeros(often.size, bool)
        first[np.unique(kind, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~first), need, "left")) + 1
        kind, tokens = kind[:end], often[:end]
        order = np.argsort(kind, kind="stable")
        kind, tokens = kind[order], tokens[order]
        step = 1
        while step < tokens.size:
            same = kind[step:] == kind[:-step]
            if not same.any():
                break
            out.append(_mix((tokens[:-step][same] * np.uint64(0x9E3779B97F4A7C15) ^ tokens[step:][same]) + np.uint64((r + 1) * int(_SEED) % (1 << 64))))
            step += 1
    return np.unique(np.concatenate(out))


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SCAN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.LongType()), T.StructField("parity", T.BinaryType()), T.StructField("token", T.LongType()), T.StructField("n_docs", T.LongType())])


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their counts, from several such."""
    tokens, counts = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if tokens.size else np.zeros(0, np.int64)
    return tokens[first], np.add.reduceat(counts, first) if first.size else counts


def _scan(k: int):
    def counts(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, n = _added([(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *held])
        tokens, n = tokens[n > 1], n[n > 1]
        nothing = pa.nulls(tokens.size, pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(tokens.size, pa.binary()), _int64(tokens), pa.array(n)], names=SCAN.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, and rows (token, n_docs) for tokens that the task has in several documents."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            sets = list(_sets(batch.column(2), k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.size for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([parity_bitmap(s) for s in sets], pa.binary()), *(pa.nulls(len(sets), pa.int64()),) * 2], names=SCAN.names)
            if sets:
                held.append(np.unique(np.concatenate(sets), return_counts=True))
            if sum(x[0].size for x in held) > COUNTED:
                yield counts(held)
                held = []
        yield counts(held)

    return scan


def _index(k: int, percent: int, bitmap: bytes, wanted: bytes | None = None):
    """wanted: only entries that pass this filter."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from functools import lru_cache

        often, some, seen = np.frombuffer(bitmap, np.uint64), wanted and np.frombuffer(wanted, np.uint64), set()
        range_of, classes = lru_cache(1 << 16)(size_range), lru_cache(1 << 16)(classes_of_range)
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                sigs, ids, sizes = [np.zeros(0, np.uint64)], [], []
                for s in _sets(block, k):
                    if s.size and (c := class_of(s)) not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(c)
                        own = signatures(s, in_bitmap(often, s), percent, range_of, classes)
                        sigs.append(own if some is None else own[in_bitmap(some, own)])
                        ids.append(c)
                        sizes.append(s.size)
                times = [x.size for x in sigs[1:]]
                yield pa.RecordBatch.from_arrays([_int64(np.concatenate(sigs)), pa.array(np.repeat(np.array(ids, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int64), times))], names=["sig", "class", "n"])

    return index


def _whole(k: int, bitmap: bytes):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.frombuffer(bitmap, np.uint64), set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            some = []
            for i in np.flatnonzero(in_bitmap(wanted, keys.view(np.uint64))).tolist():
                if keys[i] not in seen:
                    some.append(i)
                    if len(seen) < 1 << 20:
                        seen.add(keys[i])
            for _, block in blocks(batch.column(1).take(pa.array(some, pa.int64()))):
                sets = [s for s in _sets(block, k) if s.size]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "tokens"])

    return whole


def _similar(percent: int):
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            a, b = (a, b) if a.size < b.size else (b, a)
            both = int((b[np.minimum(np.searchsorted(b, a), b.size - 1)] == a).sum())
            out.append(100 * both >= percent * (a.size + b.size - both))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(similar, "boolean")


def _bound(percent: int):
    """Whether the parity bitmaps allow the similarity: overlap <= (n_a + n_b - distance) / 2."""

    def bound(pa_: pa.Array, pb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, y, n in zip(pa_, pb, (na.to_numpy() + nb.to_numpy()).tolist()):
            overlap = (n - parity_distance(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))) // 2
            out.append(100 * overlap >= percent * (n - overlap))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(bound, "boolean")


def near_pairs(group: np.ndarray, class_: np.ndarray, n: np.ndarray, part: np.ndarray, side: np.ndarray, parity: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs of one group and different parts whose sizes and parity bitmaps allow the similarity, and that similarity.

    side: 0 and 1 where only pairs of one 0 and one 1 count, else all 2. Members are sorted by group and size, so that a
    member's partners are a run of those after it. Pairs are made and compared some ``PAIR_ROWS`` at a time.
    """
    order = np.lexsort((class_, n, group))
    g, n, part, side = group[order].astype(np.int64), n[order], part[order], side[order]
    width = np.array([len(parity[k]) // 8 for k in order], np.int64)
    tables, row = {}, np.zeros((2, g.size), np.int64)
    for w in np.unique(width).tolist():
        # Bitmaps of this width, and those of twice the width folded to it: similar sets' widths differ by no more.
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        twice = np.frombuffer(b"".join(parity[k] for k in order[wider]), np.uint64).reshape(-1, 2, w)
        tables[w] = np.concatenate([np.frombuffer(b"".join(parity[k] for k in order[own]), np.uint64).reshape(-1, w), twice[:, 0] ^ twice[:, 1]])
        row[0, own], row[1, wider] = np.arange(own.size), own.size + np.arange(wider.size)
    sized = g << 40 | n
    upto = np.searchsorted(sized, g << 40 | n * 100 // percent, "right")
    before = np.concatenate([[0], np.cumsum(upto - np.arange(1, g.size + 1))])
    at = 0
    while at < g.size:
        end = max(at + 1, int(np.searchsorted(before, before[at] + PAIR_ROWS, "right")) - 1)
        x = np.repeat(np.arange(at, end), np.diff(before[at : end + 1]))
        y = np.arange(before[at], before[end]) - before[x] + x + 1
        some = (part[x] != part[y]) & ((side[x] != side[y]) | (side[x] == 2))
        x, y, at = x[some], y[some], end
        low = np.minimum(width[x], width[y])
        for w in np.unique(low).tolist():
            some = np.flatnonzero((low == w) & (np.maximum(width[x], width[y]) <= 2 * w))
            for z in np.array_split(some, 1 + (some.size * w >> 21)):
                p, q = x[z], y[z]
                p_row, q_row = (row[(width[v] > w).astype(np.int64), v] for v in (p, q))
                both = n[p] + n[q]
                overlap = (both - np.bitwise_count(tables[w][p_row] ^ tables[w][q_row]).sum(axis=1, dtype=np.int64)) // 2
                fits = 100 * overlap >= percent * (both - overlap)
                yield order[p[fits]], order[q[fits]], overlap[fits] / (both - overlap)[fits]


def nearest(owners: list[tuple[np.ndarray, np.ndarray]], near: np.ndarray, each: int) -> np.ndarray:
    """Which pairs are among the ``each`` nearest ones of one of their two owners, each a (group, part)."""
    group, part = (np.concatenate([o[k] for o in owners]) for k in (0, 1))
    pair = np.tile(np.arange(near.size), 2)
    order = np.lexsort((pair, -near[pair], part, group))
    group, part = group[order], part[order]
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])])) if pair.size else np.zeros(0, np.int64)
    place = np.arange(pair.size) - np.repeat(first, np.diff(np.append(first, pair.size)))
    out = np.zeros(near.size, bool)
    out[pair[order[place < each]]] = True
    return out


def chosen_pairs(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], group: np.ndarray, part: np.ndarray, each: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places x, y of the pairs in pieces, and the groups of which pairs were left out.

    each None: all pairs. Else all of a group that has no more than ``FEW`` for each member, and of others the nearest of
    each part. Only the nearest of what is held can be the nearest of all, so others are let go piece by piece.
    """
    n_groups = int(group.max(initial=-1)) + 1
    most, seen, none = FEW * np.bincount(group, minlength=n_groups), np.zeros(n_groups, np.int64), np.zeros(0, np.int64)
    held, size, base = [], 0, 0

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, near = (np.concatenate([h[k] for h in held]) for k in range(3))
        keep = (seen <= most)[group[x]]
        if not keep.all():
            keep |= nearest([(group[x], part[x]), (group[x], part[y])], near, each)
        return x[keep], y[keep], near[keep]

    for piece in pairs:
        if each is None:
            yield piece[0], piece[1], none
            continue
        held.append(piece)
        size += piece[0].size
        seen += np.bincount(group[piece[0]], minlength=n_groups)
        if size > 2 * base + PAIR_ROWS:
            held = [reduced()]
            size = base = held[0][0].size
    if held:
        x, y, _ = reduced()
        yield x, y, np.flatnonzero(np.bincount(group[x], minlength=n_groups) < seen)


PAIRS = "a long, na long, b long, nb long, more long"


def _pairs(percent: int, each: int | None):
    """each: only so many nearest pairs of every part; None: all. more: an entry that has further pairs."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in the order of (sig, i, j); a group may go on in the next batch."""

        def of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = pa.Table.from_batches(held)
            class_, n, part, block, sig, i, j = (groups.column(c).to_numpy() for c in ("class", "n", "part", "block", "sig", "i", "j"))
            first = np.concatenate([[True], (np.diff(sig) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
            group, sigs = np.cumsum(first) - 1, sig[first]
            side = np.where(i == j, 2, (block == j).astype(np.int64))
            found = near_pairs(group, class_, n, part, side, groups.column("parity").to_pylist(), percent)
            for x, y, cut in chosen_pairs(found, group, part, each):
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (class_[x], n[x], class_[y], n[y])), pa.nulls(x.size, pa.int64())], names=["a", "na", "b", "nb", "more"])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(cut.size, pa.int64()),) * 4, pa.array(sigs[cut])], names=["a", "na", "b", "nb", "more"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, i, j = (batch.column(c).to_numpy() for c in ("sig", "i", "j"))
            last = [held[-1].column(c)[-1].as_py() for c in ("sig", "i", "j")] if held else None
            starts = np.flatnonzero(np.concatenate([[last != [sig[0], i[0], j[0]]], (np.diff(sig) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            # Groups that end before the last start are whole.
            if starts.size:
                cut = int(starts[-1])
                if held or cut:
                    yield from of([*held, batch.slice(0, cut)])
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield from of(held)

    return pairs


class _Join:
    def __init__(self, docs: DataFrame, text: str, key: str, k: int, percent: int):
        self.texts, self.k, self.percent = docs.select(F.xxhash64(text).alias("text_key"), F.col(text).alias("text")), k, percent
        scanned = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")).mapInArrow(_scan(k), SCAN), "ngram-scan")
        self.rows = scanned.where("class is not null").select("doc_id", "text_key", "n", "class", "parity")
        self.classes = written(self.rows.where("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.min_by("parity", "class").alias("parity")), "ngram-classes")
        often = as_bitmap(self.frequent(scanned), "token", FILTER_BITS)
        index = lambda wanted=None: self.texts.select("text").mapInArrow(_index(k, percent, often, wanted), "sig long, class long, n long")
        heads = index().groupBy("sig").agg(F.min("class").alias("head"), F.max("class").alias("last")).where("head < last").select("sig", "head")
        heads = written(heads, "ngram-heads")
        # Only entries with two classes at least. Most entries have one: made again, few of them are shuffled a second time.
        self.entries = written(index(sized_bitmap(heads, "sig", ENTRY_BITS)).join(heads, "sig").select("sig", "class", "n", "head").distinct(), "ngram-entries")

    @staticmethod
    def frequent(scanned: DataFrame) -> DataFrame:
        """The frequent tokens. Which ones they are changes the work, not the result."""
        counted = written(scanned.where("token is not null").groupBy("token").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= FREQUENT), "ngram-frequent")
        level = F.floor(F.log2(F.col("n") / FREQUENT)).cast("int")
        least, room = 0, 1 << (FILTER_BITS - 3)
        for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # one row for each power of two
            if r["count"] > room:
                least = r["level"] + 1
                break
            room -= r["count"]
        return counted.where(level >= least)

    def fits(self, a: str, b: str) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def allowed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, na, b, nb) that the bitmaps allow."""
        bits = self.classes.select("class", "parity")
        near = pairs.join(bits.select(F.col("class").alias("a"), F.col("parity").alias("pa")), "a").join(bits.select(F.col("class").alias("b"), F.col("parity").alias("pb")), "b")
        return near.where(_bound(self.percent)("pa", "pb", "na", "nb")).select("a", "b")

    def links(self, near: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar. Only texts of their classes become sets again."""
        wanted = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        wanted = written(wanted.join(self.classes.select("class", "text_key"), "class"), "ngram-wanted")
        sets = self.texts.mapInArrow(_whole(self.k, as_bitmap(wanted, "text_key", FILTER_BITS)), "class long, tokens binary")
        sets = written(sets.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("tokens").alias("tokens")), "ngram-sets")
        both = near.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
        return written(both.where(_similar(self.percent)("ta", "tb")).select("a", "b"), "ngram-links")

    def across(self, entries: DataFrame, parts: DataFrame, each: int | None) -> DataFrame:
        """Pairs (a, na, b, nb) of different parts that share an entry and that sizes and bitmaps allow, and entries with more."""
        part = F.coalesce("component", "class")
        placed = entries.join(parts.withColumnRenamed("node", "class"), "class", "left").select("sig", "class", "n", part.alias("part"))
        # Entries with the same members would give the same pairs: one of them stands for all.
        mixed = placed.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("members"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"))
        # A bitmap has at most half a byte, or the least size, for each token.
        bytes_ = F.col("members") * F.greatest(F.col("most") / 2, F.lit(LEAST_PARITY // 8))
        blocks_ = F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, bytes_ / BLOCK_BYTES)).cast("int")
        mixed = mixed.where("low < high").groupBy("members", "x", "y").agg(F.min("sig").alias("sig"), F.max("most").alias("most")).select("sig", blocks_.alias("blocks"))
        members = placed.join(mixed, "sig").join(self.classes.select("class", "parity"), "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        dealt = members.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")})
        dealt = dealt.select("sig", "i", "j", "block", "class", "n", "part", "parity").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        return dealt.mapInArrow(_pairs(self.percent, each), PAIRS).distinct()

    def run(self) -> DataFrame:
        stars = self.entries.where(F.col("class") != F.col("head")).select(F.col("head").alias("a"), F.col("class").alias("b"), F.col("n").alias("nb")).distinct()
        stars = stars.join(self.classes.select(F.col("class").alias("a"), F.col("n").alias("na")), "a")
        stars = written(self.allowed(stars.where(self.fits("na", "nb"))), "ngram-stars")
        parts = written(components(self.links(stars)), "ngram-parts")
        sides = lambda pairs: pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried, entries = sides(stars), self.entries
        # Parts are first joined by their nearest pairs; entries that have more come again when fewer parts are left.
        for each in (*NEAREST, None):
            found = written(self.across(entries, parts, each), "ngram-found")
            pairs = written(found.where("more is null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
            if not pairs.isEmpty():
                tried = tried.unionByName(sides(pairs))
                parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(self.links(pairs))), "ngram-parts")
            more = found.where("more is not null").select(F.col("more").alias("sig")).distinct()
            if more.isEmpty():
                break
            entries = written(entries.join(more, "sig", "left_semi"), "ngram-more")
        part = F.coalesce("component", "class")
        whole = self.classes.join(parts.withColumnRenamed("node", "class"), "class", "left").select("class", "n", "doc_id", part.alias("part"))
        lowest = whole.groupBy("part").agg(F.min("doc_id").alias("component_id"))
        ids = written(whole.join(lowest, "part").select("class", "n", "part", "component_id"), "ngram-ids")
        out = self.rows.select("doc_id", "text_key", "n", "class").join(ids, ["class", "n"], "left")
        return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "part")


def ngram_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Words are lower-cased in A-Z only. Two rows are linked when 100 * shared >= percent * distinct shingles of both, rows
    with equal sets always. component_id: the smallest doc_id that links reach. A text of fewer than k words is one
    shingle; a null text or one without words has none and is linked with nothing. Null keys: such rows link, and don't
    count for the smallest id; if a component has no other, it is null. Repeated rows are rows of their own. Empty input:
    no rows. Further columns aren't read. Shingles and sets are compared by 64-bit hashes.
    """
    arrow_limits(docs.sparkSession)
    return _Join(docs, text, key, k, percent).run().select("doc_id", "n_shingles", "component_id")


def near_copies_removed(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all their columns, less those that links connect with another row that stays.

    Each group keeps the row of its smallest key, of rows that share it the one whose text has the smallest hash, and of
    rows that share both one. A null key counts as larger than any other. Texts without words are linked with nothing
    and stay.
    """
    arrow_limits(docs.sparkSession)
    d, t, h = unused(docs, "d", "t", "h")
    rows = written(_Join(docs, text, key, k, percent).run().where("n_shingles > 0").select("doc_id", "text_key", "part"), "ngram-groups")
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"))
    ranked = rows.join(first, "part").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    named = written(ranked.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1").select(F.col("doc_id").alias(d), F.col("text_key").alias(t), "stays"), "ngram-named")
    keyed = docs.withColumn(h, F.xxhash64(text))
    same = F.col(key).cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t))
    out = keyed.join(broadcast_if_small(named.select(d, t), BROADCAST_ROWS), same, "left_anti")
    repeated = named.where("stays").select(d, t)
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(broadcast_if_small(repeated, BROADCAST_ROWS), same, "left_semi").dropDuplicates([key, h]))
    return out.select(*docs.columns)
