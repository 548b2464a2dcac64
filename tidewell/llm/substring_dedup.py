"""Removal of word passages that occur more than once, by repeated-phrase automata.

1. Anchors. Of the word 8-grams in a window, the leftmost one with the smallest hash is its anchor. The windows of one
   anchor place are a stretch. Equal windows have equal anchors, so a window can only recur if its anchor has two places.
2. Confirmation. Windows whose anchor may recur are counted by hash over all documents, already added up where they are
   read; each keeps one place as its home, a stretch and an offset. A passage is a run of windows of a stretch that recur
   and have their home there: every recurring window lies in one passage.
3. Automata. Passages are dealt to shards by anchor. Any window holds a whole tile of half its length, at places that are
   multiples of that length in its passage; a shard's tiles make up one Aho-Corasick automaton. A tile that many passages
   have is spelt out as the whole windows around it.
4. Occurrences. The stretches of all documents whose anchor has passages are streamed through the automaton of their
   shard. A tile that is found is extended to both sides along its passage, and counts if a whole window is equal. A shard
   with many passages is dealt to several automata, one with many stretches to several tasks.

Filters sized by their keys keep other stretches out of the shuffles; they let some more through, the automata decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits, in_bitmap, sized_bitmap, unused, written
from .words import Words, _mix, blocks, shingles

WINDOW, GRAM = 35, 8
#: Least bits of the filters, as powers of two.
ANCHOR_BITS, HOME_BITS = 26, 26
#: Passages of an automaton, stretches of a task that streams them, and passages with a tile that is still extended.
PASSAGES, STRETCHES, SHARED = 2048, 32_768, 8
#: Values that a task gathers before it counts them and hands them on.
GATHERED = 1 << 18
RESULT = "struct<n_words:bigint,n_removed:bigint,kept:string,spans:array<struct<start:int,end:int>>>"
#: Bytes of a word hash that stretches carry, and characters of a word in the automaton.
WORD_BYTES, SYMBOLS = 6, 3


def anchor_places(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of every ``width`` consecutive values."""

    def pick(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] < grams[a], b, a)

    at, step = np.arange(grams.size), 1
    if grams.size < width:
        return at[:0]
    while step * 2 <= width:
        at, step = pick(at[:-step], at[step:]), step * 2
    return pick(at[: at.size - (width - step)], at[width - step :]) if step < width else at


@lru_cache(1)
def _factors(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Stretches:
    """The stretches of a block of texts whose anchors pass a filter.

    doc: index of the text; first, count: place of the first window in the block's words, and windows; anchor: hash of
    the anchor. A stretch has count + window - 1 words.
    """

    def __init__(self, block: pa.Array, window: int, gram: int, often: np.ndarray | None = None):
        self.words, self.window = Words(block), window
        self.h = self.words.hashes()
        of = self.words.of
        g = shingles(self.h, gram)
        at = anchor_places(g, window - gram + 1)
        doc = np.repeat(np.arange(of.size - 1), np.diff(of))[: at.size]
        whole = np.flatnonzero(of[doc + 1] - np.arange(at.size) >= window)
        at = at[whole]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(whole) != 1)])) if at.size else np.zeros(0, np.int64)
        self.first, self.count, self.anchor = whole[cut], np.diff(np.append(cut, whole.size)), g[at[cut]]
        if often is not None:
            self.keep(in_bitmap(often, self.anchor))

    def keep(self, some: np.ndarray) -> None:
        self.first, self.count, self.anchor = self.first[some], self.count[some], self.anchor[some]

    @property
    def doc(self) -> np.ndarray:
        return np.searchsorted(self.words.of, self.first, "right") - 1

    def _hash(self, places: np.ndarray) -> np.ndarray:
        """A hash of the window at each place."""
        if not places.size:
            return np.zeros(0, np.uint64)
        up, down = _factors(1 << max(18, int(self.h.size).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * up[: self.h.size])])
            return _mix((sums[places + self.window] - sums[places]) * down[places])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every window, and its home if it is at this place: the stretch's id and the offset in it."""
        offset = np.arange(int(self.count.sum())) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        values = self._hash(np.repeat(self.first, self.count) + offset)
        return values, np.repeat(self.ids(), self.count) | offset.astype(np.uint64)

    def ids(self) -> np.ndarray:
        """A hash of each stretch's words with the low bits clear: its first and last window hold all its words."""
        low = np.uint64((1 << self.window.bit_length()) - 1)
        with np.errstate(over="ignore"):
            ends = self._hash(self.first) ^ _mix(self._hash(self.first + self.count - 1) + self.count.astype(np.uint64))
            return _mix(ends) & ~low

    def texts(self) -> pa.Array:
        """The words' hashes of each stretch, ``WORD_BYTES`` bytes each."""
        size = self.count + self.window - 1
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first, size)
        raw = np.ascontiguousarray(self.h[at].view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
        offsets = np.concatenate([[0], np.cumsum(size * WORD_BYTES)]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), size.size, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts put together, ``GATHERED`` values or a few more at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sum(x[0].size for x in held) >= GATHERED:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _anchor_counts(window: int, gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (anchors,) in _gathered((Stretches(block, window, gram).anchor,) for batch in batches for _, block in blocks(batch.column(0))):
            values, counts = np.unique(anchors, return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(values), pa.array(counts.astype(np.int64))], names=["anchor", "n"])

    return count


def _window_counts(window: int, gram: int, often: bytes):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(often, np.uint64)
        for values, homes in _gathered(Stretches(block, window, gram, bitmap).windows() for batch in batches for _, block in blocks(batch.column(0))):
            values, at, counts = np.unique(values, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(values), pa.array(counts.astype(np.int64)), _longs(homes[at])], names=["value", "n", "home"])

    return count


def _home_texts(window: int, gram: int, often: bytes, homes: bytes):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, wanted, seen = np.frombuffer(often, np.uint64), np.frombuffer(homes, np.uint64), set()
        for batch in batches:
            for _, block in blocks(batch.column(0)):
                s = Stretches(block, window, gram, bitmap)
                ids = s.ids()
                some = np.flatnonzero(in_bitmap(wanted, ids >> np.uint64(window.bit_length())))
                some = some[np.unique(ids[some], return_index=True)[1]]
                some = some[[x not in seen for x in ids[some].tolist()]] if some.size else some
                if len(seen) < 1 << 20:
                    seen.update(ids[some].tolist())
                s.keep(some)
                yield pa.RecordBatch.from_arrays([_longs(ids[some]), _longs(s.anchor), s.texts()], names=["stretch", "anchor", "words"])

    return texts


PLACES = "anchor long, doc_id long, text_key long, start int, words binary"


def _places(window: int, gram: int, confirmed: bytes):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(confirmed, np.uint64)
        for batch in batches:
            for first, block in blocks(batch.column(2)):
                s = Stretches(block, window, gram, bitmap)
                doc = s.doc
                rows = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays([_longs(s.anchor), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((s.first - s.words.of[doc]).astype(np.int32)), s.texts()], names=["anchor", "doc_id", "text_key", "start", "words"])

    return places


def _hashes(raw: pa.Array, pad: int, between: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of stretches one after another, with ``pad`` words ``between`` around each; where each starts, and sizes."""
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    size = np.diff(offsets) // WORD_BYTES
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    wide = np.zeros((data.size // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = data.reshape(-1, WORD_BYTES)
    start = pad + np.cumsum(size + pad) - size - pad
    out = np.full(int(size.sum()) + pad * (len(raw) + 1), between, np.uint64)
    out[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = (wide.view(np.uint64).ravel() << np.uint64(1)) + np.uint64(2)
    return out, start, size


def _letters(text: np.ndarray) -> str:
    """Padded hashes as text for the automaton: some bits of each word in ``SYMBOLS`` characters of four bits, padding as
    another character. So a node has few children, which the automaton goes through one by one; equal letters of other
    words are told apart when a tile is extended."""
    out = np.empty((text.size, SYMBOLS), np.uint8)
    for k in range(SYMBOLS):
        out[:, k] = (text >> np.uint64(8 + 4 * k)).astype(np.uint8) & 15
    out[text <= 1] = 16
    return out.tobytes().decode("latin-1")


class Phrases:
    """The Aho-Corasick automaton over the tiles of passages."""

    def __init__(self, words: pa.Array, masks: np.ndarray, window: int, shared: int = SHARED):
        """words: the stretches; masks: which windows of each make up passages (bit i: the window at its i-th word)."""
        import ahocorasick

        self.window, tile = window, (window + 1) // 2
        self.text, start, _ = _hashes(words, window, 0)
        letters, keys = _letters(self.text), {}
        key_of = lambda at, size: letters[SYMBOLS * at : SYMBOLS * (at + size)]
        for at, mask in zip(start.tolist(), masks.tolist()):
            low = 0
            while mask >> low:
                if not mask >> low & 1:
                    low += 1
                    continue
                high = low
                while mask >> high & 1:
                    high += 1
                for t in range(at + low, at + high - 1 + window - tile + 1, tile):
                    keys.setdefault(key_of(t, tile), []).append((t, at + low, at + high - 1))
                low = high
        # Each key has its places in text, with the passage's first word and the start of its last window.
        for key, at in list(keys.items()):
            if len(at) > shared:
                del keys[key]
                for t, low, high in at:
                    for p in range(max(low, t + tile - window), min(high, t) + 1):
                        keys.setdefault(key_of(p, window), []).append((p, low, high))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, key in enumerate(keys):
            self.automaton.add_word(key, i)
        if keys:
            self.automaton.make_automaton()
        self.size = np.array([len(k) // SYMBOLS for k in keys], np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(v) for v in keys.values()])]).astype(np.int64)
        flat = np.array([x for v in keys.values() for x in v], np.int64).reshape(-1, 3)
        self.place, self.low, self.high = flat[:, 0], flat[:, 1], flat[:, 2] + window

    def covered(self, text: np.ndarray) -> np.ndarray:
        """For each word of text (padded hashes) whether a recurring window that is found covers it."""
        depth = np.zeros(text.size + 1, np.int64)
        if self.size.size:
            # One word of padding is enough to keep the stretches apart here.
            at = np.flatnonzero((text > 1) | np.concatenate([[False], text[:-1] > 1]))
            hits = np.fromiter((x for hit in self.automaton.iter(_letters(text[at])) for x in hit), np.int64).reshape(-1, 2)
            hits = hits[hits[:, 0] % SYMBOLS == SYMBOLS - 1]
            for i in range(0, len(hits), 1 << 16):
                end, key = hits[i : i + (1 << 16)].T
                end = at[end // SYMBOLS]
                times = self.at[key + 1] - self.at[key]
                own = np.repeat(self.at[key], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                key, p = np.repeat(key, times), np.repeat(end, times) - np.repeat(self.size[key], times) + 1
                self._extend(text, p, self.place[own], self.size[key], self.low[own], self.high[own], depth)
        return np.cumsum(depth)[:-1] > 0

    def _extend(self, text: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
        same = np.ones(p.size, bool)
        for d in range(int(size.max(initial=0))):
            same &= (d >= size) | (text[p + np.minimum(d, size - 1)] == self.text[q + np.minimum(d, size - 1)])
        p, q, size, low, high = p[same], q[same], size[same], low[same], high[same]
        left, right = np.zeros(p.size, np.int64), np.zeros(p.size, np.int64)
        for d in range(1, self.window - int(size.min(initial=self.window)) + 1):
            left += (left == d - 1) & (q - d >= low) & (text[p - d] == self.text[q - d])
            e = size + d - 1
            right += (right == d - 1) & (q + e < high) & (text[p + e] == self.text[q + e])
        some = left + size + right >= self.window
        np.add.at(depth, (p - left)[some], 1)
        np.add.at(depth, (p + size + right)[some], -1)


SPANS = "doc_id long, text_key long, start int, end int"


def _occurrences(window: int, shared: int):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in the order of (shard, slot, salt, kind): passages (mask not null), then the stretches to stream."""
        group, held, phrases = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "slot", "salt", "kind")]).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                *now, kind = keys[:, a].tolist()
                rows = batch.slice(a, b - a)
                if now != group:
                    group, held, phrases = now, [], None
                if kind == 0:
                    held.append(rows)
                    continue
                if phrases is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    phrases, held = Phrases(table.column("words").chunk(0), table.column("mask").to_numpy(), window, shared), []
                if phrases is not None:
                    yield from spans(phrases, rows)

    def spans(phrases: Phrases, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, start, _ = _hashes(rows.column("words"), window, 1)
        gone = phrases.covered(text)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        low, high = edges[::2], edges[1::2]
        row = np.searchsorted(start, low, "right") - 1
        base = rows.column("start").to_numpy().astype(np.int64)[row] - start[row]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(take), rows.column("text_key").take(take), pa.array((base + low).astype(np.int32)), pa.array((base + high).astype(np.int32))], names=["doc_id", "text_key", "start", "end"])

    return locate


def recurring_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_key, start, end: word ranges that recurring windows cover, as the automata find them; they may overlap."""
    texts = docs.select(F.col(text).alias("text"))
    anchors = texts.mapInArrow(_anchor_counts(window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    anchors = written(anchors, "recurring-anchors")
    often = sized_bitmap(anchors, "anchor", ANCHOR_BITS)
    windows = texts.mapInArrow(_window_counts(window, gram, often), "value long, n long, home long").groupBy("value").agg(F.sum("n").alias("n"), F.min("home").alias("home")).where("n > 1")
    low = (1 << window.bit_length()) - 1
    masks = windows.groupBy(F.col("home").bitwiseAND(F.lit(~low)).alias("stretch")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(home & {low}L as int))")).alias("mask"))
    masks = written(masks, "recurring-windows")
    homes = texts.mapInArrow(_home_texts(window, gram, often, sized_bitmap(masks.select(F.shiftrightunsigned("stretch", window.bit_length()).alias("stretch")), "stretch", HOME_BITS)), "stretch long, anchor long, words binary")
    passages = written(homes.join(masks, "stretch").groupBy("stretch", "anchor", "mask").agg(F.first("words").alias("words")), "passages")

    shards = max(1, -(-passages.count() // PASSAGES))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = passages.groupBy(shard).agg(F.count("*").alias("p")).join(anchors.join(passages.select("anchor").distinct(), "anchor", "left_semi").groupBy(shard).agg(F.sum("n").alias("q")), "shard")
    plan = written(sizes.select("shard", parts("p", PASSAGES).alias("slots"), parts("q", STRETCHES).alias("salts")), "shards")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["shard", "slot", "salt", "kind", "doc_id", "text_key", "start", "words", "mask"]
    nothing = {c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("text_key", "long"), ("start", "int"))}
    phrases = passages.withColumn("shard", shard).join(plan, "shard").withColumn("slot", F.pmod(F.xxhash64("stretch"), F.col("slots")).cast("int")).withColumn("salt", every("salts"))
    phrases = phrases.withColumns({**nothing, "kind": F.lit(0)}).select(*columns)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    places = rows.mapInArrow(_places(window, gram, sized_bitmap(passages, "anchor", ANCHOR_BITS)), PLACES).withColumn("shard", shard)
    places = places.join(plan, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.col("salts")).cast("int")).withColumn("slot", every("slots"))
    places = places.withColumns({"kind": F.lit(1), "mask": F.lit(None).cast("long")}).select(*columns)
    dealt = phrases.unionByName(places).repartition("shard", "slot", "salt").sortWithinPartitions("shard", "slot", "salt", "kind")
    return dealt.mapInArrow(_occurrences(window, SHARED), SPANS)


def _may_have(bitmap: bytes):
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(np.frombuffer(bitmap, np.uint64), keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return F.arrow_udf(may, "boolean").asNondeterministic()  # else the join hands the filter on to its other side


def _once(remove):
    """A UDF that is evaluated once for a row: filters on its result aren't pushed below it, where they would need it again."""
    return F.arrow_udf(remove, RESULT).asNondeterministic()


def _remover():
    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _blockwise(texts, spans)

    return _once(remove)


def _without_spans(bitmap: bytes):
    """The result of texts that the filter says have no spans, null for the others."""

    def remove(keys: pa.Array, texts: pa.Array) -> pa.Array:
        none = ~in_bitmap(np.frombuffer(bitmap, np.uint64), keys.to_numpy(zero_copy_only=False).view(np.uint64))
        some = texts.filter(pa.array(none))
        done = _blockwise(some, pa.nulls(len(some), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        return done.take(pa.array(np.cumsum(none) - 1, mask=~none))

    return _once(remove)


def _blockwise(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.concat_arrays([_removed(texts.slice(0, 0), spans.slice(0, 0)), *(_removed(block, spans.slice(first, len(block))) for first, block in blocks(texts))])


def _removed(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The result of each text; spans: lists of (start, end) of words that go, in any order, overlapping or null."""
    w = Words(texts)
    flat = spans.flatten()
    owner = np.repeat(np.arange(len(w)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    depth = np.zeros(w.start.size + 1, np.int64)
    np.add.at(depth, w.of[owner] + flat.field("start").to_numpy(), 1)
    np.add.at(depth, w.of[owner] + flat.field("end").to_numpy(), -1)
    gone = np.cumsum(depth)[:-1] > 0
    # Runs of words that go, cut where a text ends.
    cut = np.zeros(gone.size + 1, bool)
    cut[w.of] = True
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    low = np.flatnonzero(gone & (~before | cut[:-1]))
    high = np.flatnonzero(gone & (~after | cut[1:])) + 1
    doc = np.searchsorted(w.of, low, "right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(w)))]).astype(np.int32)
    ranges = pa.StructArray.from_arrays([pa.array((x - w.of[doc]).astype(np.int32)) for x in (low, high)], names=["start", "end"])
    # The bytes of words that stay, and one space behind each but the text's last.
    stays = np.flatnonzero(~gone)
    inside = np.zeros(w.data.size + 1, np.int8)
    np.add.at(inside, w.start[stays], 1)
    np.add.at(inside, w.end[stays], -1)
    keep, data = np.cumsum(inside[:-1], dtype=np.int8) > 0, w.data.copy()
    owner = np.searchsorted(w.of, stays, "right") - 1
    spaced = stays[:-1][owner[:-1] == owner[1:]]
    keep[w.end[spaced]], data[w.end[spaced]] = True, 0x20
    ends = np.concatenate([[0], np.cumsum(keep)])[w.texts].astype(np.int32)
    kept = pa.StringArray.from_buffers(len(w), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[keep])))
    n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.of])
    return pa.StructArray.from_arrays([pa.array(np.diff(w.of).astype(np.int64)), pa.array(n_removed.astype(np.int64)), kept, pa.ListArray.from_arrays(pa.array(offsets), ranges)], names=["n_words", "n_removed", "kept", "spans"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs and a struct ``dedup`` (n_words, n_removed, kept, spans): one row per input row.

    A word goes if a window of ``window`` words covers it whose words also start at any other place of any document, its
    own included; all occurrences go, the first too. kept: the other words, joined by one space; spans: the word ranges
    that went. Null text: no words. Repeated rows are documents of their own, so they recur. Rows with a null key are
    told apart by their text. A column of docs named ``dedup`` is replaced. Empty input: no rows. window: 62 words at
    most, gram fewer. Windows are counted by 64-bit hashes, words compared by 48 bits of theirs.
    """
    if not gram < window <= 62:
        raise ValueError("gram < window <= 62")
    arrow_limits(docs.sparkSession)
    docs = docs.drop("dedup")
    d, t, h, s = unused(docs, "d", "t", "h", "s")
    spans = recurring_spans(docs, window, gram, text, key).groupBy(F.col("doc_id").alias(d), F.col("text_key").alias(t)).agg(F.collect_set(F.struct("start", "end")).alias(s))
    spans = written(spans, "recurring-spans")
    # Only texts that may have spans are shuffled to meet them. No stage has two Python steps: each is a process a task.
    bitmap, rows = sized_bitmap(spans, t, HOME_BITS), docs.withColumn(h, F.xxhash64(text))
    met = rows.where(_may_have(bitmap)(F.col(h))).join(spans, F.col(key).cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    met = met.withColumn("dedup", _remover()(F.col(text), F.col(s))).drop(d, t, h, s)
    return met.unionByName(rows.withColumn("dedup", _without_spans(bitmap)(F.col(h), F.col(text))).where("dedup is not null").drop(h))
