"""Words of Arrow string batches as numpy arrays: positions and 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the pattern ``[^\\x20\\x09-\\x0D]+`` on the
text's code points. Texts are taken whole. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and all bytes of other code points: words without ASCII punctuation.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_OF_LOWER = _OF_BYTE[_LOWER]
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


class Words:
    """The words of a block of texts.

    data: the bytes; texts: n + 1 byte offsets; start, end: each word's bytes; of: n + 1 word offsets of the texts.
    """

    def __init__(self, block: pa.Array, inside: np.ndarray | None = None):
        """inside: a table of the bytes that make up words, if others than those of the pattern."""
        if pa.types.is_large_string(block.type) or not pa.types.is_string(block.type):
            block = block.cast(pa.string())
        block = block.fill_null("")
        n = len(block)
        bounds = np.frombuffer(block.buffers()[1], np.int32)[block.offset : block.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        whole = block.buffers()[2]
        self.data = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None else np.zeros(0, np.uint8)
        self.texts = bounds - bounds[0]
        inside = (_IS_WORD if inside is None else inside)[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = self.texts[self.texts < inside.size]
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.start, self.texts)

    def __len__(self) -> int:
        return len(self.texts) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower: with A-Z lower-cased. Equal words have equal hashes in every block."""
        out = np.zeros(self.start.size, np.uint64)
        table, i = _OF_LOWER if lower else _OF_BYTE, 0
        with np.errstate(over="ignore"):
            while i < out.size:
                at = self.start[i]
                j = max(i + 1, int(np.searchsorted(self.end, at + _STEP, "right")))
                out[i:j] = self._long(i, table) if self.end[i] - at > _STEP else self._run(i, j, at, table)
                i = j
            return _mix(out ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _run(self, i: int, j: int, at: int, table: np.ndarray) -> np.ndarray:
        part = self.data[at : self.end[j - 1]]
        sums = np.zeros(part.size + 1, np.uint64)
        np.cumsum(table[part] * _UP[: part.size], out=sums[1:])
        first = self.start[i:j] - at
        return (sums[self.end[i:j] - at] - sums[first]) * _DOWN[first]

    def _long(self, i: int, table: np.ndarray) -> np.ndarray:
        """A single word of over _STEP bytes, piece by piece."""
        total, factor = 0, 1
        for at in range(int(self.start[i]), int(self.end[i]), _STEP):
            part = table[self.data[at : min(at + _STEP, int(self.end[i]))]]
            total = (total + factor * int(np.sum(part * _UP[: part.size], dtype=np.uint64))) & _MASK
            factor = factor * int(_UP[_STEP]) & _MASK
        return np.array([total], np.uint64)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def blocks(array: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices (first index, texts) of about most_bytes at most, one text at least; every text stays whole."""
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.string())
    n = len(array)
    if not n:
        return
    bounds = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + n + 1]
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + most_bytes, "right")) - 1))
        yield i, array.slice(i, j - i)
        i = j


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
        return _mix(out)
