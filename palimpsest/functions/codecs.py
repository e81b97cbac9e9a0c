"""Codecs of the delta stream, for use inside Arrow kernels: raw, LZ4 blocks in length-prefixed frames, and
LZMA1 with its parameters in front. A decoder raises BadStream with a status; it never returns short."""

from __future__ import annotations

import lzma
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .layout import AUTO, CODEC_END, CORRUPT, CUSTOM, FORMAT, LZ4, LZMA, RAW, TRUNCATED

LITERALS_ONLY_UNDER = 13
TAIL, MATCH_STOP = 5, 12  # no match begins in the last five bytes or reaches into the last twelve
KEY_BITS, CHAIN, FAR, LONG_ENOUGH, LEAST_MATCH = 14, 8, 1 << 16, 260, 4
LC, LP, PB, DICTIONARY, LEAST_DICTIONARY = 3, 0, 2, 16384, 4096


class BadStream(ValueError):
    def __init__(self, status: int, site: int = 17) -> None:
        super().__init__(f"status {status} at site {site}")
        self.status, self.site = status, site


def _extended(n: int) -> bytes:
    """The extension bytes of a length whose nibble is full: runs of 255 and what is left."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def _sequence(literals: bytes, match: int = 0, offset: int = 0) -> bytes:
    """Token, literals, and a match of `match` bytes if there is one."""
    lead, tail = len(literals), max(match - LEAST_MATCH, 0)
    out = bytes([min(lead, 15) << 4 | min(tail, 15)])
    if lead >= 15:
        out += _extended(lead - 15)
    out += literals
    if match:
        out += offset.to_bytes(2, "little")
        if tail >= 15:
            out += _extended(tail - 15)
    return out


def literal_block(data: bytes) -> bytes:
    """An LZ4 block that holds data as it is."""
    return _sequence(data)


def _common(data: bytes, a: int, b: int, stop: int) -> int:
    """How many bytes from a and from b (a < b) agree, b not passing stop. Doubling slices, compared as numbers: the lowest
    bit that differs lies in the first byte that does."""
    low, high, step = 0, max(stop - b, 0), 16
    while low < high:
        n = min(step, high - low)
        differ = int.from_bytes(data[a + low : a + low + n], "little") ^ int.from_bytes(data[b + low : b + low + n], "little")
        if differ:
            return low + ((differ & -differ).bit_length() - 1 >> 3)
        low, step = low + n, step * 2
    return low


def _chained(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of key and place, whether each has the key of the one before)."""
    ordered = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
    order, ordered = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64), ordered >> np.uint64(32)
    return order, np.concatenate([[False], ordered[1:] == ordered[:-1]])


def compress_block(data: bytes) -> bytes:
    """One LZ4 block. At each place the longest match among the eight latest places with the same low 14 bits
    of their first four bytes, the latest of equals, counts if four bytes long; else one literal.

    Only places whose four bytes have come before are looked at. Places inside matches do not count: `tried` has a byte
    for each place, in order of the low bits, so that those tried between two places are counted at once."""
    n = len(data)
    if n < LITERALS_ONLY_UNDER:
        return literal_block(data)
    fours = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LEAST_MATCH)[: n - TAIL].copy().view("<u4").ravel()
    order, again = _chained(fours)
    before = np.full(n - TAIL, -1)
    before[order[again]] = order[np.flatnonzero(again) - 1]
    known = np.flatnonzero(before >= 0).tolist()
    spots = np.empty(n - TAIL, np.int64)
    spots[_chained(fours & ((1 << KEY_BITS) - 1))[0]] = np.arange(n - TAIL)
    before, spots, tried = before.tolist(), spots.tolist(), bytearray(b"\1") * (n - TAIL)
    out, done, stop = bytearray(), 0, n - MATCH_STOP
    for at in known:
        if at < done:
            continue
        place, spot, longest, back, here = before[at], spots[at], 0, 0, int.from_bytes(data[at : at + 16], "little")
        while place >= 0:
            if tried[own := spots[place]]:
                if spot - own > CHAIN and tried.count(1, own + 1, spot) >= CHAIN or at - place >= FAR or at + longest >= stop:
                    break
                if data[place + longest] == data[at + longest]:
                    differ = here ^ int.from_bytes(data[place : place + 16], "little")
                    size = min((differ & -differ).bit_length() - 1 >> 3, stop - at) if differ else _common(data, place, at, stop)
                    if size > longest:
                        longest, back = size, at - place
                        if size >= LONG_ENOUGH:
                            break
            place = before[place]
        if longest >= LEAST_MATCH:
            lead, tail = at - done, longest - LEAST_MATCH
            if lead < 15 and tail < 15:
                out.append(lead << 4 | tail)
                out += data[done:at]
                out += back.to_bytes(2, "little")
            else:
                out += _sequence(data[done:at], longest, back)
            done = at + longest
            for spot in spots[at + 1 : done]:
                tried[spot] = 0
    return bytes(out + _sequence(data[done:]))


def frames(data: bytes, size: int) -> bytes:
    """data in frames of `size` bytes, each length and block, closed by a zero length."""
    size, out = max(size, 1), bytearray()
    for at in range(0, len(data), size):
        part = data[at : at + size]
        block = compress_block(part)
        if len(block) >= len(part):
            block = literal_block(part)
        out += len(block).to_bytes(4, "little") + block
    return bytes(out + bytes(4))


def decode_block(block: bytes, window: int | None = None) -> bytes:
    """The contents of an LZ4 block of at most window bytes."""
    out, at, end = bytearray(), 0, len(block)

    def longer(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                if at >= end:
                    raise BadStream(CORRUPT)
                n += block[at]
                at += 1
                if block[at - 1] != 255:
                    break
        return n

    while at < end:
        token = block[at]
        at += 1
        lead = longer(token >> 4)
        if at + lead > end or window is not None and len(out) + lead > window:
            raise BadStream(CORRUPT)
        out += block[at : at + lead]
        at += lead
        if at == end:
            break
        if at + 2 > end:
            raise BadStream(CORRUPT)
        back = block[at] | block[at + 1] << 8
        at += 2
        size = longer(token & 15) + LEAST_MATCH
        if not 0 < back <= len(out) or window is not None and len(out) + size > window:
            raise BadStream(CORRUPT)
        start = len(out) - back
        out += out[start : start + size] if size <= back else (out[start:] * (size // back + 1))[:size]
    return bytes(out)


def frame_blocks(stream: bytes) -> list[bytes]:
    """The blocks of a framed stream. The closing zero may be missing; a cut-off frame may not."""
    out, at = [], 0
    while at < len(stream):
        if at + 4 > len(stream):
            raise BadStream(TRUNCATED)
        n = int.from_bytes(stream[at : at + 4], "little")
        at += 4
        if not n:
            break
        if at + n > len(stream):
            raise BadStream(TRUNCATED)
        out.append(stream[at : at + n])
        at += n
    return out


@dataclass(frozen=True)
class Codec:
    """encode(delta, frame size, dictionary) -> (props, stream); decode(props, stream, window) -> delta;
    workspace(props) -> bytes of decoder state, 0 if the properties are unusable."""

    name: str
    encode: Callable[[bytes, int, int], tuple[bytes, bytes]]
    decode: Callable[[bytes, bytes, int | None], bytes]
    workspace: Callable[[bytes], int]


def _lz4_encode(delta: bytes, frame: int, dictionary: int) -> tuple[bytes, bytes]:
    return len(delta).to_bytes(4, "little"), frames(delta, frame)


def _lz4_decode(props: bytes, stream: bytes, window: int | None) -> bytes:
    size = int.from_bytes(props, "little")
    if len(props) < 4 or not size:
        raise BadStream(FORMAT, 16)
    out = b"".join(decode_block(b, window) for b in frame_blocks(stream))
    if len(out) != size:
        raise BadStream(TRUNCATED, 18)
    return out


def lzma_parameters(props: bytes) -> tuple[int, int, int, int, int]:
    """lc, lp, pb, dictionary, content size."""
    if len(props) < 9 or props[0] >= 225:
        raise BadStream(FORMAT, 33)
    rest, lc = divmod(props[0], 9)
    pb, lp = divmod(rest, 5)
    return lc, lp, pb, max(int.from_bytes(props[1:5], "little"), LEAST_DICTIONARY), int.from_bytes(props[5:9], "little")


def _filters(lc: int, lp: int, pb: int, dictionary: int) -> list[dict]:
    return [{"id": lzma.FILTER_LZMA1, "lc": lc, "lp": lp, "pb": pb, "dict_size": dictionary}]


def _lzma_encode(delta: bytes, frame: int, dictionary: int) -> tuple[bytes, bytes]:
    if dictionary < LEAST_DICTIONARY:
        raise ValueError(f"a dictionary has {LEAST_DICTIONARY} bytes at least")
    props = bytes([PB * 45 + LP * 9 + LC]) + dictionary.to_bytes(4, "little") + len(delta).to_bytes(4, "little")
    return props, lzma.compress(delta, lzma.FORMAT_RAW, filters=_filters(LC, LP, PB, dictionary))


def _lzma_decode(props: bytes, stream: bytes, window: int | None) -> bytes:
    lc, lp, pb, dictionary, size = lzma_parameters(props)
    if not size:
        raise BadStream(FORMAT, 33)
    try:
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_filters(lc, lp, pb, dictionary)).decompress(stream, size)
    except (lzma.LZMAError, MemoryError, ValueError) as e:
        raise BadStream(CORRUPT) from e
    if len(out) != size:
        raise BadStream(TRUNCATED, 18)
    return out


def dictionary_buffer(size: int) -> int:
    """What a decoder allocates for a dictionary: rounded up to 4 KiB, 1 MiB from 4 MiB, 4 MiB from 1 GiB."""
    unit = 1 << (22 if size >= 1 << 30 else 20 if size >= 1 << 22 else 12)
    return -(-size // unit) * unit


def lzma_workspace(lc: int, lp: int, dictionary: int) -> int:
    total = -(-(256 + 2 * (1984 + (768 << (lc + lp)))) // 8) * 8 + dictionary_buffer(max(dictionary, LEAST_DICTIONARY))
    return total if total < 1 << 32 else 0


def _lzma_need(props: bytes) -> int:
    try:
        lc, lp, _, dictionary, size = lzma_parameters(props)
    except BadStream:
        return 0
    return lzma_workspace(lc, lp, dictionary) if size else 0


LZ4_STATE, RAW_STATE = 16, 16
BUILT_IN = {
    LZ4: Codec("lz4", _lz4_encode, _lz4_decode, lambda props: LZ4_STATE),
    LZMA: Codec("lzma", _lzma_encode, _lzma_decode, _lzma_need),
    RAW: Codec("raw", lambda delta, frame, dictionary: (b"", delta), lambda props, stream, window: stream, lambda props: RAW_STATE),
}


def find(codec_id: int, custom: dict[int, Codec] | None = None) -> Codec | None:
    """The codec of an id; a caller's own come first and may stand in for the built-in ones."""
    return (custom or {}).get(codec_id) or BUILT_IN.get(codec_id)


def valid_codec(codec_id: int, codec: Codec) -> bool:
    """Whether a codec can be registered: a built-in id or a custom one, a name, and all three functions."""
    return (AUTO < codec_id < CODEC_END or CUSTOM <= codec_id <= 255) and bool(codec.name) and all(map(callable, (codec.encode, codec.decode, codec.workspace)))
