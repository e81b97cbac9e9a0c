"""Codecs, delta coding and cryptography against published vectors, pinned answers and round trips."""

import dataclasses
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import codecs as C
from palimpsest.functions import crypto
from palimpsest.functions import delta as D
from palimpsest.functions import layout as L
from palimpsest.operators import container


def edited(rng, n):
    old = bytes(rng.randrange(256) for _ in range(n))
    new = bytearray(old)
    style = rng.randrange(4)
    if style == 0 and n:
        at = rng.randrange(n)
        new[at : at + 50] = bytes(rng.randrange(256) for _ in range(rng.randrange(90)))
    elif style == 1:
        for _ in range(n // 100):
            new[rng.randrange(n)] ^= 1 + rng.randrange(255)
    elif style == 2:
        new = new[n // 3 :] + new[: n // 3]
    else:
        new = bytearray(rng.randrange(256) for _ in range(rng.randrange(4000)))
    return old, bytes(new)


def test_delta_round_trips_and_its_size_is_exact():
    rng = random.Random(20260215)
    for _ in range(150):
        old, new = edited(rng, rng.randrange(4000))
        delta = D.encode(old, new)
        assert D.apply(old, delta, len(new)) == new
        assert len(delta) == len(new) + 24 * len(D.plan(old, new))


def test_the_encoder_takes_the_first_place_of_a_gram():
    old = b"ABCDEFGHIJKLMNOPQRST" + b"x" * 40 + b"ABCDEFGHIJKLMNOPQRSTUVWX"
    assert D.matches(old, b"ABCDEFGHIJKLMNOPQRSTUVWX") == [(0, 20, 0)]
    assert D.matches(old, b"ABCDEFGHIJKLMNO") == []  # 15 bytes are too short a run


def test_a_seek_is_for_the_next_triple():
    old = bytes(i % 251 for i in range(1500))
    new = old[:256] + old[1024:1280]
    zero = bytes(256)
    offsets = lambda *n: b"".join(map(D.write_offset, n))
    assert D.apply(old, offsets(256, 0, 768) + zero + offsets(256, 0, 0) + zero, 512) == new
    assert new[256:] != old[256:512]  # else the test could not tell


def test_diff_bytes_wrap_and_the_base_is_zero_outside():
    control = b"".join(map(D.write_offset, (4, 0, 0)))
    assert D.apply(b"\xff\x01", control + b"\x02\x02\x02\x02", 4) == b"\x01\x03\x02\x02"
    back = b"".join(map(D.write_offset, (0, 0, -2))) + control
    assert D.apply(b"\xff\x01", back + bytes(4), 4) == b"\0\0\xff\x01"


@pytest.mark.parametrize(
    ("delta", "size", "status", "site"),
    [
        (b"", 1, L.TRUNCATED, 19),
        (b"".join(map(D.write_offset, (-1, 0, 0))), 1, L.CORRUPT, 22),
        (b"".join(map(D.write_offset, (1 << 31, 0, 0))), 1, L.CORRUPT, 22),
        (b"".join(map(D.write_offset, (2, 0, 0))) + b"ab", 1, L.CORRUPT, 23),
        (b"".join(map(D.write_offset, (0, 2, 0))) + b"a", 2, L.TRUNCATED, 21),
        (b"".join(map(D.write_offset, (1, 0, 2**31 - 1))) + b"a" + b"".join(map(D.write_offset, (1, 0, 0))) + b"a", 2, L.CORRUPT, 24),
    ],
)
def test_bad_deltas(delta, size, status, site):
    with pytest.raises(D.BadDelta) as e:
        D.apply(b"base", delta, size)
    assert (e.value.status, e.value.site) == (status, site)


@given(st.integers(-(2**55) + 1, 2**55 - 1))
def test_offsets(n):
    assert D.read_offset(D.write_offset(n)) == n


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text("ab", max_size=3000).map(str.encode)), st.sampled_from([64, 256, 1024]))
def test_lz4_frames(data, size):
    framed = C.frames(data, size)
    blocks = C.frame_blocks(framed)
    assert b"".join(C.decode_block(b, size) for b in blocks) == data
    assert framed.endswith(bytes(4))


def test_lz4_blocks():
    assert C.literal_block(b"") == b"\0"
    assert C.literal_block(b"abc") == b"\x30abc"
    assert C.literal_block(bytes(15))[:2] == b"\xf0\0"
    assert C.literal_block(bytes(300))[:3] == b"\xf0\xff\x1e"
    assert len(C.compress_block(bytes(40_000))) < 400
    assert C.decode_block(b"\x11a\x01\0") == b"a" + b"a" * 5
    for bad in (b"\x10", b"\x11a\x02\0", b"\x11a\0\0", b"\xf0", b"\x11a\x01"):
        with pytest.raises(C.BadStream):
            C.decode_block(bad)
    with pytest.raises(C.BadStream):
        C.decode_block(C.compress_block(bytes(100)), 64)


def test_codecs_round_trip_and_check_their_length():
    data = random.Random(1).randbytes(500) * 4
    for codec in C.BUILT_IN.values():
        props, stream = codec.encode(data, 256, 16384)
        assert codec.decode(props, stream, 256) == data
        assert codec.workspace(props) > 0
    for codec_id in (L.LZ4, L.LZMA):
        props, stream = C.BUILT_IN[codec_id].encode(data, 256, 16384)
        longer = props[:-4] + (len(data) + 1).to_bytes(4, "little")
        with pytest.raises(C.BadStream):
            C.BUILT_IN[codec_id].decode(longer, stream, 256)


def test_lzma_parameter_sweep():
    import lzma

    data = random.Random(2).randbytes(300) * 5
    for lc, lp, pb in [(a, b, c) for a in range(5) for b in range(5 - a) for c in range(5)]:
        stream = lzma.compress(data, lzma.FORMAT_RAW, filters=C._filters(lc, lp, pb, 8192))
        props = bytes([pb * 45 + lp * 9 + lc]) + (8192).to_bytes(4, "little") + len(data).to_bytes(4, "little")
        assert C.BUILT_IN[L.LZMA].decode(props, stream, None) == data


def test_registry():
    mine = C.Codec("mine", lambda d, f, n: (b"", d[::-1]), lambda p, s, w: s[::-1], lambda p: 1)
    assert C.valid_codec(0x80, mine) and not C.valid_codec(0, mine) and not C.valid_codec(4, mine)
    assert C.find(L.LZ4, {L.LZ4: mine}) is mine and C.find(0x90, {}) is None


def test_ed25519_vectors():
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = crypto.public_key(key)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    good = crypto.sign(key, b"")
    assert good.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert crypto.verify(public, good, b"")
    assert not crypto.verify(public, good, b"x")
    high = good[:32] + (int.from_bytes(good[32:], "little") + crypto.ORDER).to_bytes(32, "little")
    assert not crypto.verify(public, high, b"")  # S beyond the group order
    assert not crypto.verify(b"\x02" + bytes(31), good, b"") and not crypto.verify(public[:-1], good, b"")
    key = bytes.fromhex("833fe62409237b9d62ec77587520911e9a759cec1d19755b7da901b96dca3d42")
    assert crypto.sign(key, b"abc", True).hex().startswith("98a70222f0b8121aa9d30f813d683f80")
    assert crypto.verify(crypto.public_key(key), crypto.sign(key, b"abc", True), b"abc", True)
    assert not crypto.verify(crypto.public_key(key), crypto.sign(key, b"abc"), b"abc", True)


def test_xchacha20_poly1305_vector():
    key, nonce = bytes(range(0x80, 0xA0)), bytes(range(0x40, 0x58))
    associated = bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypto.encrypt(key, nonce, plain, associated)
    assert sealed[-16:].hex() == "c0875924c1c7987947deafd8780acf49"
    assert crypto.decrypt(key, nonce, sealed[:-16], sealed[-16:], associated) == plain
    assert crypto.decrypt(key, nonce, sealed[:-16], sealed[-16:], b"") is None
    assert crypto.encrypt(key, nonce, b"", b"")[:-16] == b""


def test_pinned_encrypted_patch():
    """Figures of a patch that the format's own tests pin."""
    old = bytes((7 * i + 3) & 255 for i in range(1500))
    new = bytes((5 * i + 11) & 255 for i in range(1600))
    seed, key_id = bytes(range(32)), bytes(range(16))
    provider = crypto.Provider(seed, crypto.public_key(seed), {key_id: bytes(range(32, 64))})
    blob = container.pack_2(old, new, 0x1234, 1, 2, bytes(range(16, 32)), key_id, provider, 8)
    number = lambda at: int.from_bytes(blob[at : at + 4], "little")
    assert (number(28), number(160), number(40)) == (1870, 10, 2667140683)
    assert (number(32), number(36)) == (3091840966, 3330603793)
    assert blob[56:120].hex() == "49babbd3143e80fef4c0ee132fcf0487d27a20a9a2eb8460d022fa6a86d34e82e25d967e4dc3188281827eff49d7e0538e56a294bc70ca83fb6fca32449a3709"
    delta, status, site = container.open_2(blob, provider)
    assert (status, site) == (0, 0) and D.apply(old, delta, len(new)) == new
    at = 192 + 4
    for name, changed, wanted in (
        ("ciphertext", blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :], (L.AUTH, 46)),
        ("header", blob[:16] + b"\x09" + blob[17:], (L.AUTH, 46)),
        ("key id", blob[:120] + b"\xff" + blob[121:], (L.NOT_FOUND, 41)),
    ):
        assert container.open_2(changed, provider)[1:] == wanted, name


def test_keys_stay_hidden():
    assert "aa" * 4 not in repr(crypto.Provider(b"\xaa" * 32, b"x", {b"k": b"\xaa" * 32}))
    with pytest.raises(ValueError):
        crypto.Provider().signs(b"", False)
    assert not crypto.Provider().verifies(bytes(64), b"", False)


def test_crc_check_values():
    for text, crc in ((b"", 0), (b"123456789", 0xCBF43926), (b"a", 0xE8B7BE43)):
        assert zlib.crc32(text) == crc


def counted(monkeypatch, name):
    """The calls of a function of crypto, as a list that grows."""
    calls, plain = [], getattr(crypto, name)
    monkeypatch.setattr(crypto, name, lambda *a: calls.append(1) or plain(*a))
    return calls


def test_signatures_take_no_doublings_once_a_key_is_known(monkeypatch):
    key = bytes(range(32))
    good = crypto.sign(key, b"first")
    assert crypto.verify(crypto.public_key(key), good, b"first")
    calls = counted(monkeypatch, "_add")
    again = crypto.sign(key, b"second", True)
    assert crypto.verify(crypto.public_key(key), again, b"second", True) and not crypto.verify(crypto.public_key(key), again, b"second")
    assert not calls


def test_key_streams_of_many_patches_are_made_together(monkeypatch):
    rng = random.Random(7)
    provider = dataclasses.replace(crypto.generate(bytes(range(32))), keys={b"k" * 16: bytes(range(32, 64)), b"l" * 16: bytes(range(64, 96))})
    images = [(rng.randbytes(200), rng.randbytes(rng.choice([0, 1, 300, 900, 3000])), 1, 1, 2, rng.randbytes(16)) for _ in range(20)]
    calls = counted(monkeypatch, "_rounds")
    blobs = container.pack_all_2(images, b"k" * 16, provider, 8)
    assert len(calls) == 2 and sum(int.from_bytes(b[160:164], "little") for b in blobs) > 100
    assert blobs == [container.pack_2(*image, b"k" * 16, provider, 8) for image in images]
    blobs.append(container.pack_2(*images[0], b"l" * 16, provider, 8))
    blobs.append(blobs[4][:-30])
    calls.clear()
    streams = container.record_streams([(b, i % 2) for i, b in enumerate(blobs)], provider)
    assert len(calls) == 2
    opened = [container.opened_records(b, provider, i % 2, s) for i, (b, s) in enumerate(zip(blobs, streams, strict=True))]
    assert len(calls) == 2
    assert opened == [container.opened_records(b, provider, i % 2) for i, b in enumerate(blobs)]
    assert opened[-1][1] != 0 and not any(status for _, status, _ in opened[:-1:2])


def test_lz4_matches_are_those_of_a_search_place_by_place():
    def plain(data):
        chains, out, done, at = {}, b"", 0, 0
        while at < len(data) - 5:
            chain = chains.setdefault(int.from_bytes(data[at : at + 4], "little") & 0x3FFF, [])
            sizes = [(next((k for k in range(max(len(data) - 12 - at, 0)) if data[p + k] != data[at + k]), max(len(data) - 12 - at, 0)), p) for p in chain[-8:] if at - p < 1 << 16]
            longest, place = max(sizes, default=(0, 0))
            chain.append(at)
            if longest >= 4:
                out, at = out + C._sequence(data[done:at], longest, at - place), at + longest
                done = at
            else:
                at += 1
        return out + C._sequence(data[done:])

    rng = random.Random(3)
    for alphabet in (b"ab", b"abc", b"aaaaaab", bytes(range(60, 200))):
        for n in (13, 14, 17, 30, 80, 200, 700):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert C.compress_block(data) == plain(data) and C.decode_block(C.compress_block(data)) == data
