"""Layouts, validation, sessions, resume and streams on Spark."""

import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codecs as C
from palimpsest.functions import crypto
from palimpsest.functions import delta as D
from palimpsest.functions import layout as L
from palimpsest.functions import sizing as Z
from palimpsest.operators import container, delta, sessions, validate
from palimpsest.operators import journal as journal_ops
from palimpsest.sources import images, vectors
from palimpsest.streaming.sessions import advance, publish_once

OLD = bytes((7 * i + 3) & 255 for i in range(1500))
NEW = OLD[:700] + b"a change" * 20 + OLD[900:]
SEED, KEY_ID = bytes(range(32)), bytes(range(16))
PROVIDER = crypto.Provider(SEED, crypto.public_key(SEED), {KEY_ID: bytes(range(32, 64))})
PAIRS = "pair_id long, product_id long, old_version long, fw_version long, old binary, new binary"


def pairs(spark, old=OLD, new=NEW):
    return spark.createDataFrame([(1, 7, 1, 2, old, new)], PAIRS)


@pytest.fixture(scope="module")
def blobs(spark):
    """A patch of each kind, made once."""
    p = pairs(spark)
    out = {f"plain{c}": container.make_patches(p, c) for c in (L.LZ4, L.LZMA, L.RAW)} | {"signed": container.make_patches(p, provider=PROVIDER)}
    out["second"] = container.make_patches_2(p.withColumn("nonce_prefix", F.lit(bytes(range(1, 17)))), PROVIDER, KEY_ID, 8, b"\x05\0\0\0\x03\0\0\0abc\0")
    return {k: bytes(df.first().blob) for k, df in out.items()}


def put(blob, at, value, width=4):
    return blob[:at] + value.to_bytes(width, "little") + blob[at + width :]


def outcomes(spark, cases, second=False, provider=PROVIDER, old=OLD, **device):
    """{case: (status, site)} of one device meeting many patches."""
    names = list(cases)
    patches = spark.createDataFrame([(i, cases[n]) for i, n in enumerate(names)], "pair_id long, blob binary")
    base = {"device_id": 1, "product_id": 7, "running_version": 1, "image_id": 1} | device
    devices = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} long" for k in base))
    offers = patches.select(F.lit(1).cast("long").alias("device_id"), "pair_id")
    held = spark.createDataFrame([(1, old)], "image_id long, old binary")
    run = sessions.run_sessions_2 if second else sessions.run_sessions
    got = {names[r.pair_id]: r for r in run(offers, devices, patches, held, provider).collect()}
    return {n: (got[n].status, got[n].site) for n in names}, got


def test_header_build_and_parse_are_inverse(spark):
    for version in (1, 2):
        values = {name: (i * 2654435761 + 17) % (1 << 8 * width) if width <= 4 else bytes((i + j) % 256 for j in range(width)) for i, (name, _, width) in enumerate(L.LAYOUTS[version])}
        made = spark.range(1).select(L.build_header({k: F.lit(v) for k, v in values.items()}, version).alias("blob"))
        row = L.held(made, "h", L.header(F.col("blob"), version)).first()
        assert len(row.blob) == L.LAYOUTS[version][-1][1] + L.LAYOUTS[version][-1][2]
        for name, value in values.items():
            got = row.h[name]
            assert (bytes(got) if isinstance(got, bytearray) else got) == value, name
    short = spark.createDataFrame([(L.MAGIC_1.to_bytes(4, "little"),), (None,)], "blob binary").select(L.header(F.col("blob")).alias("h"), L.sniff(F.col("blob")).alias("s")).collect()
    assert [(r.h.magic, r.h.flags, r.s) for r in short] == [(L.MAGIC_1, None, 1), (None, None, None)]


def test_offsets_and_texts(spark):
    numbers = [0, 1, -1, 2**31, -(2**31), 2**55 - 1, -(2**55) + 1]
    rows = spark.createDataFrame([(n, D.write_offset(n)) for n in numbers], "n long, b binary")
    got = rows.select("n", L.offset_value(F.col("b"), 0).alias("v"), (L.offset_bytes(F.col("n")) == F.col("b")).alias("same")).collect()
    assert all(r.n == r.v and r.same for r in got)
    line = spark.range(1).select(L.log_line(F.lit(-12), F.lit(6)).alias("t"), L.status_text(F.lit(5)).alias("u"), L.codec_name(F.lit(2)).alias("c")).first()
    assert tuple(line) == ("S0006 refusing downgrade", "unknown error", "lzma")
    assert L.packed_version(1, 12, 0) == 0x010C00


def test_sizes(spark):
    row = spark.range(1).select(Z.v2_ctx_size(F.lit(8), F.lit(192)).alias("a"), Z.lzma_workspace(F.lit(3), F.lit(0), F.lit(16384)).alias("b"), Z.lzma_workspace(F.lit(0), F.lit(0), F.lit(5 << 20)).alias("c")).first()
    assert row.a == container.workspace_2(8, 192)
    assert row.b == C.lzma_workspace(3, 0, 16384)
    assert row.c == C.lzma_workspace(0, 0, 5 << 20)
    for size, log2 in ((0, 10), (100, 10), (256, 10), (1000, 10), (1024, 10), (5000, 10), (5000, 8), (70000, 16)):
        got = spark.range(1).select(Z.image_framing(F.lit(log2), F.lit(size)).alias("e")).first().e
        assert got == container.framing(log2, size) and (size < 256 or 1 << got <= size)


@pytest.mark.parametrize("old,new", [(OLD, NEW), (b"", b"x"), (OLD, OLD), (OLD, bytes(3000))])
def test_both_ways_to_apply_agree(spark, old, new):
    p = pairs(spark, old, new)
    deltas = delta.encode_pairs(p)
    triples = delta.cursors(delta.parse_triples(deltas))
    by_join = delta.apply_relational(triples, delta.blocks(p, "pair_id", "old", 128), 128).first().image
    by_kernel = delta.apply_kernel(deltas.join(p.select("pair_id", "old"), "pair_id")).first().image
    assert bytes(by_join) == bytes(by_kernel) == new


def test_relational_apply_adds_real_diffs(spark):
    rows = spark.createDataFrame([(1, 0, 6, 1, 2, b"\x01\xff\x01\x01\x01\x01", b"!"), (1, 1, 3, 0, 0, b"\x01\x01\x01", b"")], "pair_id long, n long, x long, y long, z long, diff binary, extra binary")
    base = bytes(range(10))
    got = delta.apply_relational(delta.cursors(rows), delta.blocks(spark.createDataFrame([(1, base)], "pair_id long, old binary"), "pair_id", "old", 4), 4).first().image
    assert bytes(got) == bytes([1, 0, 3, 4, 5, 6]) + b"!" + bytes([9, 10, 1])


def test_good_patches_apply(spark, blobs):
    seen, rows = outcomes(spark, {k: v for k, v in blobs.items() if k != "second"})
    assert set(seen.values()) == {(0, 0)}
    assert all(bytes(r.image) == NEW and r.erase_ops == 2 and r.log is None for r in rows.values())
    seen, rows = outcomes(spark, {"second": blobs["second"]}, second=True)
    assert seen == {"second": (0, 0)} and bytes(rows["second"].image) == NEW


def test_first_failure_of_version_1(spark, blobs):
    b, signed, lzma = blobs["plain1"], blobs["signed"], blobs["plain2"]
    cases = {
        "none": (None, (L.PARAM, 2)),
        "short": (b[:100], (L.TRUNCATED, 12)),
        "magic": (put(b, 0, 1), (L.FORMAT, 2)),
        "version": (put(b, 6, 0x0900, 2), (L.UNSUPPORTED, 3)),
        "length": (put(b, 4, 119, 2), (L.FORMAT, 4)),
        "product": (put(b, 12, 8), (L.PRODUCT, 5)),
        "rollback": (put(b, 16, 1), (L.ROLLBACK, 6)),
        "old version": (put(b, 48, 9), (L.MISMATCH, 7)),
        "reserved": (put(b, 54, 1, 2), (L.FORMAT, 9)),
        "flags": (put(b, 8, 16), (L.FORMAT, 9)),
        "raw flag": (put(b, 8, 2), (L.FORMAT, 9)),
        "raw id": (put(b, 52, 3, 1), (L.FORMAT, 9)),
        "codec": (put(put(b, 8, 0), 52, 0x7F, 1), (L.UNSUPPORTED, 9)),
        "custom codec": (put(put(b, 8, 0), 52, 0x90, 1), (L.UNSUPPORTED, 9)),
        "no size": (put(b, 24, 0), (L.FORMAT, 8)),
        "payload": (put(b, 28, len(b)), (L.TRUNCATED, 12)),
        "log2": (put(b, 53, 21, 1), (L.FORMAT, 8)),
        "budget": (put(b, 44, 1 << 21), (L.TOO_LARGE, 14)),
        "block": (put(b, 53, 20, 1), (L.TOO_LARGE, 14)),
        "no stream": (put(b, 28, 4), (L.FORMAT, 8)),
        "lzma props": (lzma[:120] + b"\xff" + lzma[121:], (L.FORMAT, 33)),
        "signature": (put(signed, 60, 0), (L.BAD_SIGNATURE, 10)),
        "signed part": (put(signed, 44, 17), (L.BAD_SIGNATURE, 10)),
        "both wrong": (put(signed, len(signed) - 6, 9, 1), (L.BAD_SIGNATURE, 10)),
        "payload crc": (put(b, 40, 0), (L.CORRUPT, 11)),
        "base size": (put(b, 20, 1), (L.MISMATCH, 13)),
        "base crc": (put(b, 32, 1), (L.MISMATCH, 13)),
        "image crc": (put(b, 36, 1), (L.CORRUPT, 30)),
        "trailing": (b + b"more", (0, 0)),
        "content size": (put(b, 120, 5), (L.TRUNCATED, 18)),
    }
    seen, rows = outcomes(spark, {k: v for k, (v, _) in cases.items()})
    assert seen == {k: v for k, (_, v) in cases.items()}
    assert rows["rollback"].log == "S0006 refusing downgrade" and rows["rollback"].image is None and rows["rollback"].erase_ops == 0


def test_first_failure_of_a_device(spark, blobs):
    cases = [  # patch, device, verdict
        ("plain1", {"flash_block": 1000}, (L.PARAM, 15)),
        ("plain1", {"block_size": 1000}, (L.PARAM, 15)),
        ("plain1", {"dst_addr": 8}, (L.PARAM, 15)),
        ("plain1", {"journal_addr": 1 << 20}, (0, 0)),
        ("plain1", {"journal_addr": 1024, "dst_addr": 1024}, (L.PARAM, 1)),
        ("plain1", {"journal_addr": 1000}, (L.PARAM, 15)),
        ("plain1", {"codec": L.RAW}, (L.UNSUPPORTED, 9)),
        ("plain2", {"lzma_max_dict": 4096}, (L.TOO_LARGE, 14)),
        ("plain2", {"lzma_max_lc_plus_lp": 2}, (L.FORMAT, 33)),
        ("plain1", {"ram_budget": 2 * 1024 + 16}, (0, 0)),
        ("plain1", {"ram_budget": 2 * 1024 + 15}, (L.TOO_LARGE, 14)),
        ("signed", {}, (L.BAD_SIGNATURE, 10)),  # no public key to verify with
        ("plain1", {"image_id": 2}, (L.PARAM, 1)),  # no base
    ]
    base = {"device_id": 0, "product_id": 7, "running_version": 1, "image_id": 1} | sessions.DEVICE_DEFAULTS
    rows = [tuple((base | device | {"device_id": i}).values()) for i, (_, device, _) in enumerate(cases)]
    devices = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in base))
    patches = spark.createDataFrame([(i, blobs[kind]) for i, (kind, _, _) in enumerate(cases)], "pair_id long, blob binary")
    offers = devices.select("device_id", F.col("device_id").alias("pair_id"))
    held = spark.createDataFrame([(1, OLD)], "image_id long, old binary")
    got = {r.device_id: (r.status, r.site) for r in sessions.run_sessions(offers, devices, patches, held).collect()}
    assert got == {i: verdict for i, (_, _, verdict) in enumerate(cases)}


def test_first_failure_of_version_2(spark, blobs):
    b = blobs["second"]
    head = int.from_bytes(b[4:6], "little")
    resigned = lambda x: x[:56] + PROVIDER.signs(L.SIGNATURE_DOMAIN + x[:56] + bytes(64) + x[120:], True) + x[120:]
    recrc = lambda x: put(x, 40, zlib.crc32(x[head:]))
    cases = {
        "good": (b, (0, 0)),
        "short": (b[:190], (L.PARAM, 35)),
        "magic": (put(b, 0, L.MAGIC_1), (L.FORMAT, 35)),
        "version": (put(b, 6, 0x0100, 2), (L.UNSUPPORTED, 35)),
        "unknown flag": (put(b, 8, 0x2B), (L.FORMAT, 35)),
        "profile": (put(b, 8, 9), (L.UNSUPPORTED, 35)),
        "reserved": (put(b, 168, 1), (L.FORMAT, 35)),
        "critical tag": (put(b, 194, 1, 2), (L.FORMAT, 35)),
        "tag overrun": (put(b, 196, 99), (L.FORMAT, 35)),
        "tag padding": (put(b, 203, 1, 1), (L.FORMAT, 35)),
        "codec": (put(b, 52, 2, 1), (L.UNSUPPORTED, 35)),
        "log2": (put(b, 53, 14, 1), (L.FORMAT, 35)),
        "no key id": (b[:120] + bytes(16) + b[136:], (L.FORMAT, 35)),
        "nonce tail": (put(b, 152, 1), (L.FORMAT, 35)),
        "no records": (put(b, 160, 0), (L.FORMAT, 35)),
        "many records": (put(b, 160, 1 << 31), (L.FORMAT, 35)),
        "truncated": (b[:-1], (L.TRUNCATED, 35)),
        "trailing": (b + b"x", (L.FORMAT, 35)),
        "product": (put(b, 12, 8), (L.PRODUCT, 36)),
        "rollback": (put(b, 16, 1), (L.ROLLBACK, 37)),
        "mismatch": (put(b, 48, 9), (L.MISMATCH, 38)),
        "payload crc": (put(b, 40, 1), (L.CORRUPT, 39)),
        "workspace": (put(b, 44, 0), (L.TOO_LARGE, 42)),
        "signature": (put(b, 60, 1), (L.BAD_SIGNATURE, 40)),
        "key": (resigned(b[:120] + b"\xff" + b[121:]), (L.NOT_FOUND, 41)),
        "tag": (resigned(recrc(b[:-1] + bytes([b[-1] ^ 1]))), (L.AUTH, 46)),
    }
    seen, _ = outcomes(spark, {k: v for k, (v, _) in cases.items()}, second=True)
    assert seen == {k: v for k, (_, v) in cases.items()}


def test_every_truncation_and_mutation_has_a_verdict(spark, blobs):
    import random

    rng, b = random.Random(5), blobs["second"]
    some = [b[:n] for n in range(0, len(b), 7)] + [rng.randbytes(rng.randrange(512)) for _ in range(100)]
    for _ in range(150):
        x = bytearray(b)
        x[rng.randrange(len(x))] ^= 1 + rng.randrange(255)
        some.append(bytes(x))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "pair_id long, blob binary")
    assert container.structure_2(frame).where("status is null or site is null").count() == 0
    seen, _ = outcomes(spark, dict(enumerate(some[:60])))
    assert all(s < 0 for s, _ in seen.values())


def test_records_and_tags(spark, blobs):
    patches = spark.createDataFrame([(1, blobs["second"])], "pair_id long, blob binary")
    rows = container.record_rows(patches).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows))) and all(len(r.tag) == 16 for r in rows)
    assert [(t.type, t.flags, bytes(t.value)) for t in container.tag_rows(patches).collect()] == [(5, 0, b"abc")]
    area = spark.createDataFrame([(b"",), (bytes(4),), (b"\x01\0\x01\0" + bytes(4),), (b"\x02\0\x01\0" + bytes(4),)], "a binary")
    assert [r.t.sound for r in area.select(validate.tlvs(F.col("a"), F.octet_length("a")).alias("t")).collect()] == [True, False, True, False]


def test_inspect_and_verify(spark, blobs):
    patches = spark.createDataFrame(list(enumerate(blobs.values())), "pair_id long, blob binary")
    seen = container.inspect(patches).orderBy("pair_id").collect()
    assert [r.codec for r in seen] == ["lz4", "lzma", "raw", "lz4", "lz4"] and all(r.payload_ok for r in seen)
    valid = {r.pair_id: (r.signed, r.valid) for r in container.verify_signatures(patches, PROVIDER).collect()}
    assert valid == {0: (False, False), 1: (False, False), 2: (False, False), 3: (True, True), 4: (True, True)}


def test_custom_codec(spark):
    flip = C.Codec("flip", lambda d, f, n: (b"", bytes(255 - x for x in d)), lambda p, s, w: bytes(255 - x for x in s), lambda p: 8)
    patches = container.make_patches(pairs(spark), 0x90, custom={0x90: flip})
    devices = spark.createDataFrame([(1, 7, 1, 1)], "device_id long, product_id long, running_version long, image_id long")
    offers = spark.createDataFrame([(1, 1)], "device_id long, pair_id long")
    held = spark.createDataFrame([(1, OLD)], "image_id long, old binary")
    row = sessions.run_sessions(offers, devices, patches, held, custom={0x90: flip}).first()
    assert (row.status, bytes(row.image)) == (0, NEW)


def test_candidates(spark, blobs):
    devices = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 8, 1)], "device_id long, product_id long, running_version long")
    patches = spark.createDataFrame([(5, blobs["plain1"])], "pair_id long, blob binary")
    assert [tuple(r) for r in sessions.candidates(devices, patches).collect()] == [(1, 5)]
    bases = spark.createDataFrame([(9, OLD), (10, NEW)], "image_id long, bytes binary")
    assert [tuple(r) for r in images.match_base(patches, bases).collect()] == [(5, 9)]


def test_steps_and_checkpoints(spark):
    s = spark.createDataFrame([(1, 1000, 256, 64)], "pair_id long, new_size long, block long, flash_block long")
    assert [r.ends_at for r in sessions.steps(s).orderBy("step").collect()] == [256, 512, 768, 1000]
    assert [r.out_off for r in sessions.checkpoints_2(s, 4).collect()] == [256, 512, 768]
    rows = [(1, n, 128, 0, 0) for n in range(7)] + [(1, 7, 104, 0, 0)]
    triples = delta.cursors(spark.createDataFrame(rows, "pair_id long, n long, x long, y long, z long"))
    got = lambda every: [(r.step, r.newpos) for r in sessions.checkpoints_1(sessions.steps(s), triples, every).orderBy("step").collect()]
    assert got(1) == [(1, 256), (2, 512), (3, 768)] and got(2) == [(2, 512)] and got(9) == []


def test_resume_probes(spark):
    written = bytes(range(256)) * 4
    fields = {"magic": journal_ops.MAGIC[1], "session_id": 77, "newpos": 300, "prefix_crc32": zlib.crc32(written[:300])}
    raw = b"".join(v.to_bytes(4, "little") for v in fields.values()) + bytes(4)
    good = fields | {"record_crc": zlib.crc32(raw)}
    variants = {1: good, 2: good | {"record_crc": 1}, 3: good | {"newpos": 0}, 4: good | {"session_id": 78}}
    journal = spark.createDataFrame([(i, *v.values()) for i, v in variants.items()], "device_id long, " + ", ".join(f"{k} long" for k in good))
    rows = spark.createDataFrame([(i, 77, 1024, 256, written) for i in range(1, 6)], "device_id long, session_id long, new_size long, flash_block long, written binary")
    got = {r.device_id: (r.status, r.rewind) for r in journal_ops.probe_1(journal, rows).collect()}
    assert got == {1: (0, 256), **{i: (L.NOT_FOUND, None) for i in (2, 3, 4, 5)}}

    names = journal_ops.FIELDS[2]
    two = dict.fromkeys(names, 0) | {"magic": journal_ops.MAGIC[2], "session_id": 77, "out_off": 1024, "old_off": -5, "d_off": 5000, "record_index": 2, "prefix_crc32": zlib.crc32(written)}
    crc = zlib.crc32(b"".join((two[n] % (1 << 32)).to_bytes(4, "little") for n in names) + bytes(4))
    journal = spark.createDataFrame([(1, *(two[n] for n in names), crc)], "device_id long, " + ", ".join(f"{n} long" for n in (*names, "record_crc")))
    rows = rows.withColumn("record_count", F.lit(3))
    got = {r.device_id: (r.status, r.resume_at) for r in journal_ops.probe_2(journal, rows).collect()}
    assert got[1] == (0, 1024) and got[2] == (L.NOT_FOUND, None)


def test_resuming_at_a_stop_gives_the_same_image(spark):
    """Decode from the recorded place by hand and compare."""
    d = D.encode(OLD, NEW)
    triples = delta.cursors(delta.parse_triples(spark.createDataFrame([(1, len(NEW), d)], "pair_id long, new_size long, delta binary")))
    stops = spark.createDataFrame([(1, s) for s in (100, 700, 768, 860, 1024)], "pair_id long, out_off long")
    for r in sessions.positions(stops, triples, 256).collect():
        assert r.record_base_d <= r.d_off and r.record_index == r.record_base_d // 256
        rest, at, cursor = bytearray(), r.d_off, r.old_off
        diff, extra, seek = r.diff_remaining, r.extra_remaining, r.seek
        while True:
            rest += bytes((x + OLD[cursor + i]) % 256 for i, x in enumerate(d[at : at + diff]))
            at, cursor = at + diff, cursor + diff
            rest += d[at : at + extra]
            at, cursor = at + extra, cursor + seek
            if r.out_off + len(rest) >= len(NEW):
                break
            diff, extra, seek = (D.read_offset(d, at + k) for k in (0, 8, 16))
            at += 24
        assert NEW[: r.out_off] + bytes(rest) == NEW


def test_sources_and_sinks(spark, tmp_path, blobs):
    rows = spark.createDataFrame([("a.bin", blobs["plain1"]), ("b.bin", blobs["second"]), ("c.bin", None)], "name string, blob binary")
    done = images.write_files(rows, f"file://{tmp_path}/out", "name", "blob").collect()
    assert sorted(r.name for r in done) == ["a.bin", "b.bin", "c.bin"]
    again = images.sniffed(images.read_files(spark, f"file://{tmp_path}/out", "*.bin")).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.version, r.size) for r in again} == {"a.bin": (1, len(blobs["plain1"])), "b.bin": (2, len(blobs["second"])), "c.bin": (None, 0)}
    kept = images.publish(spark.createDataFrame([(1, b"x", zlib.crc32(b"x")), (2, b"y", 0)], "id long, bytes binary, crc long"), f"{tmp_path}/table", "id", "bytes", "crc")
    assert {r.id: r.verified for r in kept.collect()} == {1: True, 2: False}
    journal = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, n long, v string")
    assert sorted(r.v for r in images.latest(journal, "k", "n").collect()) == ["b", "c"]


def test_pairing(spark):
    long = "x" * 64 + "y" * 200
    rows = [(3, long), (1, long + "a"), (2, long), (4, None), (5, "short"), (6, long + "a"), (7, "z" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = sorted((r.pair_id, r.base_id) for r in images.base_pairs(docs).collect())
    assert got == [(2, 1), (3, 1)]
    assert images.base_pairs(docs.where("false")).count() == 0


def test_stream_of_events(spark, tmp_path):
    schema = "device_id long, seq long, kind string, n long, new_size long, block long"
    steps = [
        [(1, 1, "begin", None, 1000, 256), (1, 2, "step", 2, None, None), (2, 1, "step", 1, None, None), (3, 1, "begin", None, 8, 8), (3, 2, "finish", None, None, None), (4, 1, "begin", -7, 8, 8), (4, 2, "step", 1, None, None)],
        [(1, 3, "step", 2, None, None), (1, 4, "finish", None, None, None), (1, 5, "step", 9, None, None), (2, 2, "begin", None, 10, 4), (2, 3, "abort", None, None, None), (2, 4, "step", 1, None, None), (3, 3, "begin", None, 8, 8), (3, 4, "step", 1, None, None), (3, 5, "finish", 1, None, None)],
    ]
    source = str(tmp_path / "in")
    spark.createDataFrame(steps[0], schema).coalesce(1).write.parquet(source)
    states = advance(spark.readStream.schema(schema).parquet(source))
    query = states.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    first = {r.device_id: tuple(r)[1:5] for r in spark.table("states").collect()}
    assert first == {1: ("decode", 512, 0, 0), 2: ("failed", 0, -2, 32), 3: ("failed", 0, -2, 32), 4: ("failed", 0, -7, 0)}
    spark.createDataFrame(steps[1], schema).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    last = sorted(tuple(r) for r in spark.table("states").collect())
    assert (1, "done", 1000, 0, 0, ["apply", "writeback", "verify", "commit", "done"]) in last
    assert (2, "failed", 0, -15, 29, ["header", "validate", "alloc", "decode", "failed"]) in last
    assert (3, "failed", 8, -16, 31, ["header", "validate", "alloc", "decode", "apply", "writeback", "verify", "commit", "failed"]) in last
    assert {state for r in last for state in (*r[5], "idle")} <= set(L.STATES)


def test_records_are_written_verified_and_cleared(spark, tmp_path):
    path = f"file://{tmp_path}/journal"
    rows = spark.createDataFrame([(1, b"a" * 20), (2, b"b" * 64), (3, b""), (4, b"c" * 65), (5, None)], "key long, record binary")
    assert {tuple(r) for r in journal_ops.write_records(rows, path).collect()} == {(1, 0), (2, 0), (3, -1), (4, -1), (5, -1)}
    assert {(r.key, bytes(r.record)) for r in journal_ops.read_records(spark, path).collect()} == {(1, b"a" * 20), (2, b"b" * 64)}
    assert [tuple(r) for r in journal_ops.clear(spark, spark.createDataFrame([(2,)], "key long"), path, 2).collect()] == [(2, 0)]
    left = {r.key: bytes(r.record) for r in journal_ops.read_records(spark, path).collect()}
    assert left == {1: b"a" * 20, 2: bytes(52)}
    assert journal_ops.cleared(1)[:16] == bytes(16) and int.from_bytes(journal_ops.cleared(1)[16:], "little") == zlib.crc32(bytes(20))
    gone = journal_ops.parsed(spark.createDataFrame([(1, journal_ops.cleared(1))], "device_id long, record binary"), 1)
    one = spark.createDataFrame([(1, 0, 100, 16, b"x" * 50)], "device_id long, session_id long, new_size long, flash_block long, written binary")
    assert journal_ops.probe_1(gone, one).first().status == L.NOT_FOUND


def test_vectors_and_key_files(spark, tmp_path):
    import lzma

    filters = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 4096}]
    plain = [b"", b"a", bytes(range(256)) * 9]
    made = [(bytes([93]) + (4096).to_bytes(4, "little") + len(t).to_bytes(4, "little"), lzma.compress(t, lzma.FORMAT_RAW, filters=filters), t) for t in plain]
    blob = vectors.vector_file(made)
    files = spark.createDataFrame([("whole", blob), ("cut", blob[:-1]), ("none", b""), ("null", None)], "path string, blob binary")
    rows = vectors.read_vectors(files).collect()
    assert [(r.n, bytes(r.props), bytes(r.data), bytes(r.plain)) for r in rows if r.path == "whole"] == [(i, *v) for i, v in enumerate(made)]
    assert {(r.path, r.n) for r in rows if not r.sound} == {("cut", 2), ("none", 0), ("null", 0)}
    assert all(C.find(L.LZMA).decode(bytes(r.props), bytes(r.data), None) == bytes(r.plain) for r in rows if r.sound and r.plain)
    keys = crypto.write_keys(str(tmp_path / "seed"), str(tmp_path / "public"))
    assert (tmp_path / "seed").stat().st_mode & 0o777 == 0o600
    assert crypto.verify((tmp_path / "public").read_bytes(), keys.signs(b"m", False), b"m") and crypto.public_key((tmp_path / "seed").read_bytes()) == keys.public
    with pytest.raises(FileExistsError):
        crypto.write_keys(str(tmp_path / "seed"), str(tmp_path / "other"))


def test_host_reasons_of_version_2_and_repeated_nonces(spark, blobs):
    good = blobs["second"]
    cases = {"good": good, "short": good[:100], "magic": b"X" + good[1:], "profile": good[:164] + b"\1" + good[165:], "reserved": good[:168] + b"\1" + good[169:], "null": None}
    rows = container.structure_2(spark.createDataFrame(list(cases.items()), "pair_id string, blob binary"))
    got = {r.pair_id: r.why for r in rows.select("pair_id", validate.host_reason_2(F.col("blob"), F.col("head"), F.col("tags.sound")).alias("why")).collect()}
    assert got == {"good": None, "short": "MFP2 patch is shorter than 192-byte header", "null": "MFP2 patch is shorter than 192-byte header", "magic": "invalid MFP2 header", "profile": "invalid MFP2 record/profile fields", "reserved": "invalid MFP2 reserved/key fields"}
    twice = container.repeated_nonces(spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "nonce_prefix binary")).collect()
    assert [(bytes(r.nonce_prefix), r.uses) for r in twice] == [(b"a", 2)]


def test_publishing_is_idempotent(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    run = lambda rows: rows.withColumn("status", F.when(F.col("session_id") > 0, 0).otherwise(-4))
    publish = publish_once(run, ledger)
    schema = "device_id long, session_id long"
    first, second = spark.createDataFrame([(1, 5), (2, 0), (1, 5)], schema), spark.createDataFrame([(1, 5), (3, 6)], schema)
    for rows, n in ((first, 0), (second, 1), (second, 1)):
        publish(rows, n)
    assert sorted((r.device_id, r.session_id) for r in spark.read.parquet(ledger).collect()) == [(1, 5), (3, 6)]


def test_every_text_has_a_previous_base(spark):
    texts = {k: f"text {k}" for k in (-5, 3, 4, 90, 10**15, 10**15 + 1)} | {5: "", 91: "text 90"}
    docs = spark.createDataFrame([*texts.items(), (6, None), (None, "x")], "doc_id long, text string")
    order = sorted(texts)
    wanted = [(k, order[i - 1], texts[order[i - 1]].encode(), texts[k].encode()) for i, k in enumerate(order)]
    for ranges in (1, 3, 1024):
        assert sorted((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in images.previous_pairs(docs, ranges=ranges).collect()) == wanted
    assert [tuple(r)[:2] for r in images.previous_pairs(docs.where("doc_id = 3")).collect()] == [(3, 3)]
    assert images.previous_pairs(docs.where("false")).count() == 0


def test_candidates_of_one_version_are_dealt_over_parts(spark, blobs):
    blob = blobs["plain1"]
    devices = spark.createDataFrame([(d, 7, 1) for d in range(300)] + [(300, 8, 1), (301, 7, 2), (None, 7, 1)], "device_id long, product_id long, running_version long")
    ids = [None, -3, 0, *range(7 << 16, (7 << 16) + 50), *range(1 << 40, (1 << 40) + (40 << 16), 1 << 16)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        found = sessions.candidates(devices, spark.createDataFrame([(i, blob) for i in ids], "pair_id long, blob binary"))
        rows = found.select("device_id", "pair_id", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len({part for _, _, part in rows}) > 1  # one key, several tasks
    assert sorted((str(d), str(i)) for d, i, _ in rows) == sorted((str(d), str(i)) for d in (*range(300), None) for i in ids)


def test_files_of_candidates_are_small_and_whole(spark, blobs, tmp_path):
    devices = spark.range(30).select(F.col("id").alias("device_id"), F.lit(7).cast("long").alias("product_id"), F.lit(1).cast("long").alias("running_version"))
    patches = spark.range(60_000).select((F.col("id") * 7919 % 1_000_003).alias("pair_id"), F.lit(blobs["plain1"]).alias("blob"))
    sessions.candidates(devices, patches).write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    assert found.count() == found.distinct().count() == 1_800_000
    assert sum(p.stat().st_size for p in (tmp_path / "found").glob("*.parquet")) < 0.5 * 1_800_000  # as pairs in any order: over a byte each
    assert sessions.candidates(devices.where("false"), patches).count() == sessions.candidates(devices, patches.where("false")).count() == 0
