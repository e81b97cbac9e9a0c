"""Vectorised word shingles: numpy over whole UTF-8 buffers, no Python loop per word.

A word is a run of bytes other than the six ASCII blanks, A-Z read as a-z. Its 64-bit hash is a
polynomial over the bytes (prefix sums, so any span costs O(1)) put through a bit mixer; a shingle's
hash mixes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes hashed at a time: eight-byte work arrays of this length, 2 MB, stay near the cache
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def _words(buf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in buf; first: offsets at which a new text begins."""
    inside = ~_BLANK[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = first[first < len(buf)]
    begins[first] |= inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = first[first > 0] - 1
    ends[cut] |= inside[cut]
    stops = np.flatnonzero(ends) + 1
    up, down = _powers.of(len(buf))
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts]
    return mix(h + (stops - starts).astype(np.uint64)), starts


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of texts buf[offsets[i]:offsets[i+1]]: (i, hashes, bounds) of runs of whole texts, with the words
    of text i + k at hashes[bounds[k]:bounds[k + 1]]. A text longer than CHUNK is cut between words."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= CHUNK:
            h, starts = _words(buf[lo:hi], offsets[i:j] - lo)
            yield i, h, np.searchsorted(starts, offsets[i : j + 1] - lo)
        else:
            parts, at = [], lo
            while at < hi:
                end = min(at + CHUNK, hi)
                while end < hi and not _BLANK[buf[end]]:
                    blank = np.flatnonzero(_BLANK[buf[end : end + CHUNK]])
                    end = end + int(blank[0]) if len(blank) else min(end + CHUNK, hi)
                parts.append(_words(buf[at:end], np.zeros(1, np.int64))[0])
                at = end
            h = np.concatenate(parts)
            yield i, h, np.array([0, len(h)])
        i = j


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j])
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is empty."""
    col = batch.column(name)
    if pa.types.is_large_string(col.type):
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf, offsets


def shingle_sets(batch: pa.RecordBatch, name: str, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct sorted hashes of its n-word shingles) of every row of the batch, in order. With fewer
    words than n the whole sequence is the one shingle; without words there is none."""
    if not len(batch):
        return
    buf, offsets = column(batch, name)
    with np.errstate(over="ignore"):
        for i, words, bounds in word_hashes(buf, offsets):
            rolled = _rolled(words, n) if len(words) >= n else words[:0]
            for k, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                yield i + k, _distinct(rolled[lo : hi - n + 1]) if hi - lo >= n else _rolled(words[lo:hi], hi - lo) if hi > lo else words[:0]
