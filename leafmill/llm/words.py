"""Words of whole Arrow text columns as numpy arrays, without a Python string each.

A word is a run of bytes other than the space and 9 to 13; hashes are 64-bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.where(SPACE, np.uint64(0), stream(7, 256) | np.uint64(1))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_BLOCK = 1 << 14
_POW = _powers(_BASE, _BLOCK)
_STEP = np.uint64(int(_POW[-1]) * int(_BASE) % 2**64)


@dataclass
class Words:
    """``data``: all texts' bytes; ``text``: where each text begins, and the end.

    ``starts`` and ``ends`` are the words' bytes in ``data``; text i has the
    words from ``first[i]`` to before ``first[i + 1]``.
    """

    data: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    gapless: bool = True  # no gap byte but white space, which hashes as nothing

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash of each word's bytes; ``lower`` takes A-Z as a-z."""
        return self.prefix_hashes([None], lower)[0]

    def prefix_hashes(self, sizes: list[int | None], lower: bool = False) -> list[np.ndarray]:
        """For each size a hash of each word's first so many bytes (None: all).

        A word shorter than the size has the hash of the whole word.
        """
        if not len(self.starts):
            return [np.zeros(0, np.uint64)] * len(sizes)
        begin = np.zeros(len(self.data), np.int64)
        begin[self.starts] = self.starts
        at = np.arange(len(self.data), dtype=np.int64) - np.maximum.accumulate(begin)
        values = (_LOWER if lower else _BYTE)[self.data]
        with np.errstate(over="ignore"):
            if (top := int((self.ends - self.starts).max())) > _BLOCK:
                values *= _powers(_STEP, top // _BLOCK + 1)[np.minimum(at // _BLOCK, top // _BLOCK)]
            values *= _POW[at % _BLOCK]
            if len(self.data) and not self.gapless:
                values[~self._inside()] = 0
            lengths = (self.ends - self.starts).astype(np.uint64)
            out = []
            for size in sizes:
                part = values if size is None else np.where(at < size, values, np.uint64(0))
                out.append(mix(np.add.reduceat(part, self.starts) + (lengths if size is None else np.minimum(lengths, np.uint64(size)))))
            return out

    def _inside(self) -> np.ndarray:
        marks = np.zeros(len(self.data) + 1, np.int8)
        marks[self.starts] += 1
        marks[self.ends] -= 1
        return np.cumsum(marks[:-1], dtype=np.int8) > 0


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty), and where each text begins."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, gaps: np.ndarray = SPACE) -> Words:
    """``gaps``: the 256 flags of bytes that end a word."""
    data, text = text_bytes(texts)
    inside = ~gaps[data]
    filled = np.flatnonzero(np.diff(text))
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[text[filled]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[text[filled + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, text, starts, ends, np.searchsorted(starts, text), gaps is SPACE)


_PLACE = stream(11, 8) | np.uint64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring words; the last ``size - 1`` begin none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[:n] * _PLACE[0]
        for j in range(1, size):
            total += hashes[j : j + n] * _PLACE[j]
    return mix(total)


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of hashed ``size``-word shingles.

    A text with fewer words has its whole sequence as one; without words, none.
    """
    hashes = words.hashes(lower=True)
    all_windows = windows(hashes, size)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(all_windows[a : b - size + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                sets.append(mix((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
