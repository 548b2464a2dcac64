"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until its pieces are short, the pieces are encoded, and neighbours are joined. The join re-encodes only
a window over the seam. It may stop at a *firm cut*: a position before a space or line feed with characters other than
white space on both sides. The splitting pattern always starts a match there, and no match before it reads past that
white space, so the tokens of both sides are the same whatever stands beyond: a window between a firm cut on the left and
one on the right leaves all tokens outside it as they are. The window doubles until it has both cuts, or reaches the ends
of the two pieces, which is then a plain encoding of both. Joining is associative, and its result is the encoding of the
whole text. Decoding concatenates the bytes of id ranges up the same tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_limits

LEAF_CHARS, WINDOW_CHARS = 8192, 64
_FIRM = re.compile(r"(?<=\S)[ \n](?=\S)")


class Codec:
    """The ranks of one vocabulary file and the pattern that splits texts before merging."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), np.int32)

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> np.ndarray:
        return self._encode(text, 0, len(text), max(1, leaf_chars), window)

    def _encode(self, text: str, start: int, end: int, leaf: int, window: int) -> np.ndarray:
        if end - start <= leaf:
            return self.leaf(text[start:end])
        mid = (start + end) // 2
        return self.join(text, start, mid, end, self._encode(text, start, mid, leaf, window), self._encode(text, mid, end, leaf, window), window)

    def join(self, text: str, start: int, mid: int, end: int, left: np.ndarray, right: np.ndarray, window: int = WINDOW_CHARS) -> np.ndarray:
        """The ids of text[start:end] from those of text[start:mid] and text[mid:end]."""
        a, b, size = None, None, max(2, window)
        while a is None or b is None:
            low, high = max(start, mid - size), min(end, mid + size)
            if a is None:
                cuts = [m.start() for m in _FIRM.finditer(text, low, mid)]
                a = cuts[-1] if cuts else start if low == start else None
            if b is None:
                m = _FIRM.search(text, mid + 1, high) if mid + 1 < high else None
                b = m.start() if m else end if high == end else None
            size *= 2
        drop_left, drop_right = (len(text[x:y].encode()) for x, y in ((a, mid), (mid, b)))
        return np.concatenate([left[: self._keep(left, drop_left)], self.leaf(text[a:b]), right[right.size - self._keep(right[::-1], drop_right) :]])

    def _keep(self, ids: np.ndarray, drop: int) -> int:
        """How many ids are left once those that make up the last ``drop`` bytes are gone."""
        n, step = ids.size, 64
        while drop and n:
            took = np.cumsum(self.sizes[ids[max(0, n - step) : n]][::-1])
            k = int(np.searchsorted(took, drop, "left"))
            if k < took.size:
                return n - k - 1
            n, drop, step = n - took.size, drop - int(took[-1]), step * 2
        return n

    def decode(self, ids: np.ndarray, leaf: int = 1 << 14) -> bytes:
        if len(ids) <= leaf:
            return self.library.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


def _encoded(texts: pa.Array, c: Codec) -> pa.Array:
    ids = [c.encode(t) if t else np.zeros(0, np.int32) for t in texts.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([x.size for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def _decoded(lists: pa.Array, c: Codec) -> pa.Array:
    flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return pa.array([c.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def encoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """Text column -> array of ids. Null text: no ids, as for an empty text. path: the same on every executor."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _encoded(texts, codec(path, pattern))

    return F.arrow_udf(encode, "array<int>")


def decoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """Array of ids -> bytes; null: none."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield _decoded(lists, codec(path, pattern))

    return F.arrow_udf(decode, "binary")


def both_ways(path: str, pattern: str) -> Callable[[Column], Column]:
    """Text column -> struct of its ids and the bytes that they decode to: encoder and decoder as one Python step, since
    two in a stage are two processes a task, and both stay for the stages that follow."""

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids = _encoded(texts, codec(path, pattern))
            yield pa.StructArray.from_arrays([ids, _decoded(ids, codec(path, pattern))], names=["ids", "decoded"])

    return F.arrow_udf(both, "struct<ids:array<int>,decoded:binary>")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids, decoded: one row per input row, whole texts.

    Null text: as an empty one. Null keys and repeated rows stay rows of their own. Empty input: no rows. Further columns
    are neither read nor returned. decoded is made from the ids alone.
    """
    arrow_limits(docs.sparkSession)
    got = docs.select(F.col(key).alias("doc_id"), both_ways(path, pattern)(F.col(text)).alias("both"))
    return got.select("doc_id", "both.ids", "both.decoded")
