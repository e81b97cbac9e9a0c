"""The delta stream: control triples (diff length, extra length, seek) with their bytes.

A triple adds `diff` bytes to the base at the cursor, appends `extra` bytes, then moves the cursor by the
diff length and the seek, so a seek is for the triple after it. Offsets are eight bytes, sign and magnitude.
Base bytes outside the image read as zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .layout import CORRUPT, TRUNCATED

GRAM, LEAST_RUN = 8, 16
CONTROL = 24
INT_MAX = (1 << 31) - 1
MAGNITUDE = (1 << 55) - 1


class BadDelta(ValueError):
    def __init__(self, status: int, site: int) -> None:
        super().__init__(f"status {status} at site {site}")
        self.status, self.site = status, site


@dataclass(frozen=True)
class Triple:
    diff: bytes
    extra: bytes
    seek: int


def write_offset(n: int) -> bytes:
    return (abs(n) | (n < 0) << 63).to_bytes(8, "little")


def read_offset(data: bytes, at: int = 0) -> int:
    raw = int.from_bytes(data[at : at + 8], "little")
    return -(raw & MAGNITUDE) if raw >> 63 else raw & MAGNITUDE


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8-byte gram at each place, as an integer."""
    return np.lib.stride_tricks.sliding_window_view(data, GRAM).copy().view("<u8").ravel() if len(data) >= GRAM else np.empty(0, "<u8")


def first_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of data, ascending as integers, and the first place of each."""
    return np.unique(_grams(np.frombuffer(data, np.uint8)), return_index=True)


def _marks(grams: np.ndarray, bits: int) -> np.ndarray:
    """A hash of `bits` bits of each gram."""
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _marked(marks: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes there are."""
    out = np.zeros(1 << bits, bool)
    out[marks] = True
    return out


def _agreement(new: np.ndarray, i: int, old: np.ndarray, j: int) -> int:
    """How many bytes from new[i] and old[j] agree."""
    most, done, step = min(len(new) - i, len(old) - j), 0, 64
    while done < most:
        n = min(step, most - done)
        differ = np.flatnonzero(new[i + done : i + done + n] != old[j + done : j + done + n])
        if len(differ):
            return done + int(differ[0])
        done, step = done + n, step * 2
    return done


def matches(old: bytes, new: bytes) -> list[tuple[int, int, int]]:
    """(start in new, length, start in old) of the greedy runs: at each place the first base position with the
    same 8 bytes is tried, and a run of 16 bytes or more is taken and skipped."""
    base, target = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    old_grams, grams = _grams(base), _grams(target)
    # only grams whose hashes the other image has too are ordered
    bits = min(max(16, (16 * len(old_grams)).bit_length()), 24)
    old_marks, marks = _marks(old_grams, bits), _marks(grams, bits)
    shared = np.flatnonzero(_marked(old_marks, bits)[marks])
    places = np.flatnonzero(_marked(marks[shared], bits)[old_marks])
    if not len(places):
        return []
    keys, first = np.unique(old_grams[places], return_index=True)
    at = np.minimum(np.searchsorted(keys, grams[shared]), len(keys) - 1)
    found = keys[at] == grams[shared]
    known, first = shared[found], places[first[at[found]]]  # the only places where a run can begin, and where its gram is first
    out, free = [], 0
    while free < len(known):
        i = int(known[free])
        j = int(first[free])
        run = _agreement(target, i, base, j)
        if run >= LEAST_RUN:
            out.append((i, run, j))
            free = int(np.searchsorted(known, i + run))
        else:
            free += 1
    return out


def plan(old: bytes, new: bytes) -> list[Triple]:
    """Triples that turn old into new: runs as zero diffs, everything else as extra bytes, and a triple of a
    seek alone where the first run is not at the base's start."""
    pieces: list[tuple[bytes, bytes, int | None]] = []  # diff, extra, base position needed
    end = 0
    for i, run, j in matches(old, new):
        if i > end:
            pieces.append((b"", new[end:i], None))
        pieces.append((bytes(run), b"", j))
        end = i + run
    if end < len(new):
        pieces.append((b"", new[end:], None))
    out, cursor = [], 0
    for k, (diff, extra, place) in enumerate(pieces):
        if place is not None and place != cursor:
            out.append(Triple(b"", b"", place - cursor))
            cursor = place
        after = pieces[k + 1][2] if k + 1 < len(pieces) else None
        seek = 0 if after is None else after - cursor - len(diff)
        out.append(Triple(diff, extra, seek))
        cursor += len(diff) + seek
    return out


def encode(old: bytes, new: bytes) -> bytes:
    return b"".join(write_offset(len(t.diff)) + write_offset(len(t.extra)) + write_offset(t.seek) + t.diff + t.extra for t in plan(old, new))


def triples(delta: bytes, new_size: int, cursor: int = 0) -> list[Triple]:
    """The triples that make new_size bytes; what follows them is ignored. Raises BadDelta with the status and
    site of the first thing that is wrong."""
    out, at, made = [], 0, 0
    while made < new_size:
        if not -INT_MAX - 1 <= cursor <= INT_MAX:  # the seek before is applied only now
            raise BadDelta(CORRUPT, 24)
        if at + CONTROL > len(delta):
            raise BadDelta(TRUNCATED, 19)
        diff, extra, seek = (read_offset(delta, at + k) for k in (0, 8, 16))
        at += CONTROL
        if not 0 <= diff <= INT_MAX or not 0 <= extra <= INT_MAX or not -INT_MAX - 1 <= seek <= INT_MAX:
            raise BadDelta(CORRUPT, 22)
        if made + diff + extra > new_size:
            raise BadDelta(CORRUPT, 23)
        if at + diff > len(delta):
            raise BadDelta(TRUNCATED, 20)
        if at + diff + extra > len(delta):
            raise BadDelta(TRUNCATED, 21)
        out.append(Triple(delta[at : at + diff], delta[at + diff : at + diff + extra], seek))
        at, made, cursor = at + diff + extra, made + diff + extra, cursor + diff + seek
    return out


def _added(diff: bytes, base: np.ndarray, cursor: int) -> bytes:
    """diff added to the base from the cursor on."""
    part = np.frombuffer(diff, np.uint8).copy()
    lo, hi = max(cursor, 0), min(cursor + len(part), len(base))
    if lo < hi:
        part[lo - cursor : hi - cursor] += base[lo:hi]
    return part.tobytes()


def apply(old: bytes, delta: bytes, new_size: int, cursor: int = 0) -> bytes:
    """The new image, or new_size bytes more of it from a base cursor on."""
    base, out = np.frombuffer(old, np.uint8), bytearray()
    for t in triples(delta, new_size, cursor):
        out += _added(t.diff, base, cursor)
        out += t.extra
        cursor += len(t.diff) + t.seek
    return bytes(out)


def resume(old: bytes, rest: bytes, left: int, old_off: int, diff_remaining: int, extra_remaining: int, seek: int) -> bytes:
    """The last `left` bytes of the image: rest is the stream from where a session stopped, in the middle of a triple of
    which so many bytes remain, its seek pending. Between triples nothing remains of the one before but its seek."""
    if diff_remaining < 0 or extra_remaining < 0 or diff_remaining + extra_remaining > left:
        raise BadDelta(CORRUPT, 23)
    if diff_remaining + extra_remaining > len(rest):
        raise BadDelta(TRUNCATED, 20 if diff_remaining > len(rest) else 21)
    part = diff_remaining + extra_remaining
    head = _added(rest[:diff_remaining], np.frombuffer(old, np.uint8), old_off) + rest[diff_remaining:part]
    return head + apply(old, rest[part:], left - part, old_off + diff_remaining + seek)
