"""Queries of sessions that fail, stop and go on: every kind of failure on every pair of images, journals, resume."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import sizing as Z
from ..operators import container, delta, sessions
from ..operators import journal as J
from ..operators.validate import host_reason_1
from ..sources import images as S
from ..sources.staging import stored
from . import pairs as P

MIB = 1 << 20


def overlay(blob: Column, at: int | Column, data: Column) -> Column:
    """blob with data over its bytes from an offset that counts from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.concat(F.substring(blob, F.lit(1), at.cast("int")), data, F.substring(blob, (at + F.octet_length(data) + 1).cast("int"), F.octet_length(blob)))


def _word(value: int | Column, width: int = 4) -> Column:
    return L.little(F.lit(value) if isinstance(value, int) else value, width)


def _flipped(blob: Column, at: Column) -> Column:
    return overlay(blob, at, F.unhex(F.lpad(F.hex((delta.byte_at(blob, at) + 1) % 256), 2, "0")))


def _restreamed(blob: Column) -> Column:
    """A raw version 1 patch whose stream has changed, with size and checksum of the payload set right."""
    stream = F.substring(blob, F.lit(L.HEADER_1 + 1), F.octet_length(blob))
    return overlay(overlay(blob, 28, _word(F.octet_length(stream))), L.PAYLOAD_CRC_AT, _word(F.crc32(stream)))


def _last(blob: Column) -> Column:
    return F.octet_length(blob) - 1


Kind = tuple[tuple[int, int], Callable[[Column], Column] | None, dict[str, object]]


def _kinds_1() -> list[Kind]:
    """((status, site), how the raw patch is changed, what the device has instead) of each kind of session."""
    return [
        ((L.OK, 0), None, {}),
        ((L.FORMAT, 2), lambda blob: overlay(blob, 0, F.lit(b"X")), {}),
        ((L.UNSUPPORTED, 3), lambda blob: overlay(blob, 6, _word(0x0900, 2)), {}),
        ((L.FORMAT, 4), lambda blob: overlay(blob, 4, _word(4, 2)), {}),
        ((L.PRODUCT, 5), None, {"product_id": 1}),
        ((L.ROLLBACK, 6), None, {"running_version": 2}),
        ((L.MISMATCH, 7), None, {"running_version": 0}),
        ((L.FORMAT, 9), lambda blob: overlay(blob, 8, _word(0x12)), {}),
        ((L.UNSUPPORTED, 9), lambda blob: overlay(overlay(blob, 8, _word(0)), 52, _word(0x7F, 1)), {}),
        ((L.FORMAT, 8), lambda blob: overlay(blob, 24, _word(0)), {}),
        ((L.TRUNCATED, 12), lambda blob: overlay(blob, 28, _word(_last(blob) - L.HEADER_1 + 2)), {}),
        ((L.FORMAT, 8), lambda blob: overlay(blob, 53, _word(7, 1)), {}),
        ((L.TOO_LARGE, 14), lambda blob: overlay(blob, 44, _word(1 << 31)), {}),
        ((L.CORRUPT, 11), lambda blob: _flipped(blob, _last(blob)), {}),
        ((L.BAD_SIGNATURE, 10), lambda blob: overlay(blob, 8, _word(L.RAW_FLAG | L.SIGNED)), {}),
        ((L.PARAM, 1), None, {"base": "none"}),
        ((L.MISMATCH, 13), None, {"base": "short"}),
        ((L.MISMATCH, 13), None, {"base": "changed"}),
        ((L.PARAM, 15), None, {"dst_addr": 1}),
        ((L.PARAM, 15), None, {"flash_block": 1000}),
        ((L.TOO_LARGE, 14), None, {"ram_budget": 16}),
        ((L.PARAM, 1), None, {"dst_addr": MIB, "journal_addr": MIB}),
        ((L.CORRUPT, 22), lambda blob: _restreamed(overlay(blob, L.HEADER_1, _word(1 << 40, 8))), {}),
        ((L.CORRUPT, 23), lambda blob: _restreamed(overlay(blob, L.HEADER_1, _word((1 << 31) - 1, 8))), {}),
        ((L.TRUNCATED, 19), lambda blob: _restreamed(F.substring(blob, F.lit(1), F.lit(L.HEADER_1 + 4))), {}),
        ((L.CORRUPT, 30), lambda blob: _flipped(blob, F.lit(36)), {}),
        ((L.ABORTED, 29), None, {"abort_after": 1}),
        ((L.COMMIT, 31), None, {"commit_takes": False}),
        ((L.PARAM, 0), None, {"hooks_complete": False}),
        ((L.UNSUPPORTED, 9), None, {"codec": L.LZ4}),
    ]


def _kinds_2() -> list[Kind]:
    """As _kinds_1 for version 2. The kinds that sign again, use another key or resume are named by their device."""
    return [
        ((L.OK, 0), None, {}),
        ((L.FORMAT, 35), lambda blob: overlay(blob, 0, F.lit(b"X")), {}),
        ((L.PRODUCT, 36), None, {"product_id": 1}),
        ((L.ROLLBACK, 37), None, {"running_version": 2}),
        ((L.MISMATCH, 38), None, {"running_version": 0}),
        ((L.MISMATCH, 38), None, {"base": "short"}),
        ((L.CORRUPT, 39), lambda blob: _flipped(blob, _last(blob)), {}),
        ((L.TOO_LARGE, 42), None, {"ram_budget": 200}),
        ((L.PARAM, 43), None, {"workspace_addr": 1000, "patch_addr": 1001}),
        ((L.BAD_SIGNATURE, 40), lambda blob: _flipped(blob, F.lit(L.SIGNATURE_AT)), {}),
        ((L.NOT_FOUND, 41), None, {"special": "key"}),
        ((L.AUTH, 46), lambda blob: _flipped(blob, _last(blob)), {"special": "signed"}),
        ((L.PARAM, 44), None, {"special": "resume"}),
        ((L.PARAM, 48), None, {"hooks_complete": False}),
        ((L.MISMATCH, 13), None, {"base": "changed"}),
        ((L.ABORTED, 29), None, {"abort_after": 1}),
        ((L.COMMIT, 31), None, {"commit_takes": False}),
        ((L.FORMAT, 35), lambda blob: overlay(blob, 168, _word(1)), {}),
        ((L.FORMAT, 35), lambda blob: overlay(blob, 160, _word(0)), {}),
        ((L.TRUNCATED, 35), lambda blob: F.substring(blob, F.lit(1), _last(blob)), {}),
    ]


def _chosen(kinds, default: Column, pick) -> Column:
    """The column that pick gives for a row's kind, or the default where it gives none."""
    out = default
    for k, kind in enumerate(kinds):
        if (value := pick(kind)) is not None:
            out = F.when(F.col("kind") == k, value).otherwise(out)
    return out


def _fleet(held: DataFrame, kinds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(offers, devices, images): one device a pair, of the kind that its number gives."""
    rows = held.withColumn("kind", F.col("pair_id") % len(kinds))
    plain = {"product_id": F.col("product_id"), "running_version": F.col("old_version"), "flash_block": F.lit(1024), "ram_budget": F.lit(MIB), "dst_addr": F.lit(0), "journal_addr": F.lit(0), "codec": F.lit(0)}
    plain |= {"hooks_complete": F.lit(True), "commit_takes": F.lit(True), **{c: F.lit(None).cast("long") for c in ("abort_after", "patch_addr", "workspace_addr")}}
    columns = [_chosen(kinds, value, lambda kind, c=c: F.lit(kind[2][c]) if c in kind[2] else None).alias(c) for c, value in plain.items()]
    devices = rows.select(F.col("pair_id").alias("device_id"), F.col("pair_id").alias("image_id"), *columns)
    changes = {"none": F.lit(None).cast("binary"), "short": F.substring("old", F.lit(1), F.octet_length("old") - 1), "changed": _flipped(F.col("old"), F.lit(0))}
    images = rows.select(F.col("pair_id").alias("image_id"), _chosen(kinds, F.col("old"), lambda kind: changes.get(kind[2].get("base"))).alias("old"))
    return rows.select(F.col("pair_id").alias("device_id"), "pair_id"), devices, images


def _shown(done: DataFrame) -> DataFrame:
    return done.select("pair_id", "status", "site", F.md5("image").alias("image_md5"), "state", "log")


def session_failures(spark, sf_dir):
    """Every kind of version 1 session over every pair."""
    held, kinds = P.held_pairs(spark, sf_dir), _kinds_1()
    offers, devices, images = _fleet(held, kinds)
    made = container.make_patches(held, L.RAW).withColumn("kind", F.col("pair_id") % len(kinds))
    patches = made.select("pair_id", _chosen(kinds, F.col("blob"), lambda kind: kind[1] and kind[1](F.col("blob"))).alias("blob"))
    return _shown(sessions.run_sessions(offers, devices, patches, images))


def session_failures_2(spark, sf_dir):
    """Every kind of version 2 session over every pair."""
    held, kinds, provider = P.held_pairs(spark, sf_dir), _kinds_2(), P.test_provider()
    offers, devices, images = _fleet(held, kinds)
    special = {kind[2]["special"]: k for k, kind in enumerate(kinds) if "special" in kind[2]}
    kind = F.col("pair_id") % len(kinds)
    other = dataclasses.replace(provider, keys=provider.keys | {P.OTHER_KEY_ID: bytes(range(64, 96))})
    made = P.second(held.where(kind != special["key"]), provider).union(P.second(held.where(kind == special["key"]), other, P.OTHER_KEY_ID))
    made = stored(made.withColumn("kind", kind), "made")
    patches = made.select("pair_id", "kind", _chosen(kinds, F.col("blob"), lambda kind: kind[1] and kind[1](F.col("blob"))).alias("blob"))
    again = container.signed_again(patches.where(F.col("kind") == special["signed"]), provider)
    patches = patches.where(F.col("kind") != special["signed"]).drop("kind").union(again)
    beyond = held.where(kind == special["resume"]).select(F.col("pair_id").alias("device_id"), F.lit(b"").alias("written"), *(F.lit(1 << 20 if c == "record_index" else 1024 if c == "resume_at" else 0).alias(c) for c in sessions._PLACES))
    return _shown(sessions.run_sessions_2(offers, devices, patches, images, provider, beyond))


def _expected(kinds) -> str:
    """SQL: what each kind of session comes to."""
    codes = ", ".join(f"({k}, {status}, {site}, '{L.STATUSES[status]}')" for k, ((status, site), _, _) in enumerate(kinds))
    return f"""SELECT pair_id, status, site, CASE WHEN status = 0 THEN md5(new) END AS image_md5, CASE WHEN status = 0 THEN 'done' ELSE 'failed' END AS state,
        CASE WHEN status <> 0 THEN printf('S%04X ', site) || text END AS log FROM p JOIN (VALUES {codes}) AS k(kind, status, site, text) ON k.kind = p.pair_id % {len(kinds)}"""


def journal_resume(spark, sf_dir):
    """Version 1 sessions that were cut half way: with a good record, a torn one, another session's, and one that the
    bytes written do not match. All end with the image; only the first kind keeps blocks."""
    held = P.held_pairs(spark, sf_dir)
    patches = stored(container.make_patches(held, L.RAW), "patches")
    offers, devices, images = _fleet(held, _kinds_1()[:1])
    heads = patches.select(F.col("pair_id").alias("device_id"), F.crc32(F.substring("blob", F.lit(1), F.lit(L.HEADER_1))).alias("session_id"))
    cut = held.select(F.col("pair_id").alias("device_id"), "new", F.octet_length("new").cast("long").alias("new_size")).join(heads, "device_id")
    cut = cut.withColumn("newpos", F.floor(F.col("new_size") / 2)).withColumn("written", F.concat(F.substring("new", F.lit(1), F.col("newpos").cast("int")), F.lit(b"\xff" * 16)))
    rows = J.journal_rows(cut, 1).select("device_id", J.record_bytes(1).alias("record"))
    kind = F.col("device_id") % 4
    damaged = F.when(kind == 1, _flipped(F.col("record"), F.lit(8))).when(kind == 2, F.lit(J.cleared(1))).otherwise(F.col("record"))
    journal = J.parsed(rows.select("device_id", damaged.alias("record")), 1)
    seen = cut.select("device_id", "session_id", "new_size", F.lit(1024).alias("flash_block"), F.when(kind == 3, F.concat(F.lit(b"?"), F.substring("written", F.lit(2), F.octet_length("written")))).otherwise(F.col("written")).alias("written"))
    probed = stored(J.probe_1(journal, seen).withColumnRenamed("status", "probe").join(seen.select("device_id", "written"), "device_id"), "probed")
    done = sessions.run_sessions(offers, devices, patches, images, resume=probed.select("device_id", "rewind", "written"))
    return done.join(probed.select("device_id", "probe", "rewind"), "device_id").select("pair_id", "probe", "rewind", "status", F.md5("image").alias("image_md5"), "erase_ops")


def journal_resume_2(spark, sf_dir):
    """Version 2 sessions cut after the last of their checkpoints, three blocks of 256 bytes apart, go on in the middle of
    a record and of a triple."""
    held, provider = P.held_pairs(spark, sf_dir), P.test_provider()
    patches = stored(P.second(held, provider, record_log2=8), "patches")
    triples = stored(delta.cursors(delta.parse_triples(delta.encode_pairs(held))), "triples")
    sizes = held.select("pair_id", F.octet_length("new").cast("long").alias("new_size"), F.lit(256).alias("flash_block"))
    stops = sessions.checkpoints_2(sizes, 3).groupBy("pair_id").agg(F.max("out_off").alias("out_off"))
    heads = L.held(patches, "h", L.header(F.col("blob"), 2)).select("pair_id", F.crc32(F.substring("blob", F.lit(1), F.lit(L.HEADER_2))).alias("session_id"), "h.record_count")
    frame = held.select("pair_id", F.least(F.lit((1 << 8) - 64), F.octet_length("new")).cast("long").alias("frame"))
    places = sessions.positions(stops, triples, (1 << 8) - 64)
    points = places.join(heads, "pair_id").join(held.select("pair_id", "new"), "pair_id").join(frame, "pair_id").withColumn("device_id", F.col("pair_id"))
    # records hold `frame` bytes of the delta, less than a record's most where the image is small
    index = F.floor((F.col("d_off") - 1) / F.col("frame"))
    points = points.withColumn("record_index", index).withColumn("record_base_d", index * F.col("frame")).withColumn("written", F.substring("new", F.lit(1), F.col("out_off").cast("int")))
    journal = J.parsed(J.journal_rows(points, 2).select("device_id", J.record_bytes(2).alias("record")), 2)
    seen = points.select("device_id", "session_id", "record_count", "written").join(sizes.withColumnRenamed("pair_id", "device_id"), "device_id")
    probed = stored(J.probe_2(journal, seen).withColumnRenamed("status", "probe").join(seen.select("device_id", "written"), "device_id"), "probed")
    offers, devices, images = _fleet(held, _kinds_2()[:1])
    done = sessions.run_sessions_2(offers, devices.withColumn("flash_block", F.lit(256)), patches, images, provider, probed)
    return done.join(probed.select("device_id", "probe", "resume_at"), "device_id", "left").select("pair_id", "probe", "resume_at", "status", F.md5("image").alias("image_md5"), "erase_ops")


def record_layout(spark, sf_dir):
    """Records of encrypted patches: what they decode to, what they take, nonces, and what their tags cover."""
    held, provider = P.held_pairs(spark, sf_dir), P.test_provider()
    patches = stored(P.second(held, provider), "patches")
    decoded = container.record_lengths(patches, provider).groupBy("pair_id").agg(F.sum("decoded").alias("decoded"))
    deltas = delta.encode_pairs(held).select("pair_id", F.octet_length("delta").cast("long").alias("delta_size"))
    heads = L.held(patches, "h", L.header(F.col("blob"), 2))
    heads = heads.select("pair_id", "blob", "h.payload_size", "h.hdr_len", "h.nonce_prefix")
    head = L.span(F.col("blob"), 0, F.col("hdr_len"))
    first = L.number(F.col("blob"), F.col("hdr_len").cast("int"), 4)
    covered = delta.mapped(heads.select("pair_id", head.alias("head"), first.alias("size")), lambda r: [{"pair_id": r["pair_id"], "kernel": container.associated(r["head"], 0, r["size"])}], ["pair_id"], "kernel binary")
    built = heads.select("pair_id", "payload_size", F.lower(F.hex(L.nonce(F.col("nonce_prefix"), F.lit(0)))).alias("nonce"), L.associated_data(head, F.lit(0), first).alias("aad"))
    out = built.join(covered, "pair_id").join(container.area_length(patches), "pair_id").join(decoded, "pair_id").join(deltas, "pair_id")
    return out.select("pair_id", "nonce", (F.col("aad") == F.col("kernel")).alias("aad_agrees"), (F.col("area") == F.col("payload_size")).alias("area_agrees"), (F.col("decoded") == F.col("delta_size")).alias("decoded_agrees"))


def base_matches(spark, sf_dir):
    """The images that each patch fits by size and checksum, equal ones and the base itself."""
    held = P.held_pairs(spark, sf_dir)
    images = S.text_images(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return S.match_base(container.make_patches(held, L.RAW), images)


def control_offsets(spark, sf_dir):
    value = F.col("o_orderkey") * 7919 * (1 - 2 * (F.col("o_custkey") % 2))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", value.alias("value")).withColumn("bytes", L.offset_bytes(F.col("value")))
    return rows.select("o_orderkey", F.lower(F.hex("bytes")).alias("bytes"), L.offset_value(F.col("bytes"), 0).alias("value"))


def context_sizes(spark, sf_dir):
    """What a version 1 session takes, for headers of every framing and devices of every block size."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderkey") % 9 == 0, L.FORMAT).otherwise(L.OK)
    block, log2 = F.pow(F.lit(2), F.col("o_custkey") % 8 + 6).cast("long"), F.col("o_orderkey") % 13 + 8
    block = F.when(F.col("o_custkey") % 10 == 0, 0).when(F.col("o_custkey") % 10 == 1, 100).otherwise(block)
    return orders.select("o_orderkey", Z.ctx_size(status, block, log2, F.lit(16)).alias("ctx"))


def host_parse(spark, sf_dir):
    """Why a host tool refuses headers, null where it does not."""
    rows = L.held(P.headers(spark, sf_dir), "h", L.header(F.col("blob")))
    return rows.select("o_orderkey", host_reason_1(F.col("blob"), F.col("h")).alias("reason"))


def newest_patches(spark, sf_dir):
    """The newest of all patches for each product and version."""
    return sessions.newest(P.headers(spark, sf_dir).withColumnRenamed("o_orderkey", "pair_id"))


def degraded_journals(spark, sf_dir):
    """Checkpoints that remain where some could not be written, and whether the session has given up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stops = sessions.checkpoints_2(docs.select(F.col("doc_id").alias("pair_id"), F.octet_length("text").cast("long").alias("new_size"), F.lit(512).alias("flash_block")), 1)
    points = stored(stops.withColumn("step", F.floor(F.col("out_off") / 512)), "points")
    kept, flags = J.surviving(points, points.where((F.col("pair_id") + F.col("step")) % 11 == 0).select("pair_id", "step"))
    return flags.join(kept.groupBy("pair_id").agg(F.count("*").alias("kept")), "pair_id", "left").select("pair_id", "flags", F.coalesce("kept", F.lit(0)).alias("kept"))


def lzma_parameters(spark, sf_dir):
    """What the properties of LZMA patches say, and the memory that decoding takes."""
    return container.lzma_info(container.make_patches(P.held_pairs(spark, sf_dir), L.LZMA)).select("pair_id", "lc", "lp", "pb", "dict_size", "workspace")


QUERIES = {
    "session_failures": session_failures,
    "session_failures_2": session_failures_2,
    "journal_resume": journal_resume,
    "journal_resume_2": journal_resume_2,
    "record_layout": record_layout,
    "base_matches": base_matches,
    "lzma_parameters": lzma_parameters,
    "control_offsets": control_offsets,
    "context_sizes": context_sizes,
    "host_parse": host_parse,
    "newest_patches": newest_patches,
    "degraded_journals": degraded_journals,
}


def oracle_sql() -> dict[str, str]:
    return {
        "session_failures": P.PAIRS_SQL + _expected(_kinds_1()),
        "session_failures_2": P.PAIRS_SQL + _expected(_kinds_2()),
        "journal_resume": P.PAIRS_SQL + """, s AS (SELECT pair_id, new, octet_length(new) AS n, pair_id % 4 = 0 AND octet_length(new) >= 2 AS good FROM p)
            SELECT pair_id, CASE WHEN good THEN 0 ELSE -17 END AS probe, CASE WHEN good THEN n // 2 // 1024 * 1024 END AS rewind, 0 AS status, md5(new) AS image_md5,
                (ceil(n / 1024.0) - CASE WHEN good THEN n // 2 // 1024 ELSE 0 END)::BIGINT AS erase_ops FROM s""",
        "journal_resume_2": P.PAIRS_SQL + """, s AS (SELECT pair_id, new, octet_length(new) AS n FROM p)
            SELECT pair_id, CASE WHEN n >= 768 THEN 0 END AS probe, CASE WHEN n >= 768 THEN n // 768 * 768 END AS resume_at, 0 AS status, md5(new) AS image_md5,
                (ceil(n / 256.0) - n // 768 * 3)::BIGINT AS erase_ops FROM s""",
        "record_layout": P.PAIRS_SQL + "SELECT pair_id, substr(sha256(pair_id::VARCHAR), 1, 32) || '0000000000000000' AS nonce, true AS aad_agrees, true AS area_agrees, true AS decoded_agrees FROM p",
        "base_matches": P.PAIRS_SQL + "SELECT p.pair_id, d.pair_id AS image_id FROM p JOIN d ON d.new = p.old",
        "lzma_parameters": P.PAIRS_SQL + "SELECT pair_id, 3 AS lc, 0 AS lp, 2 AS pb, 16384 AS dict_size, 32896 AS workspace FROM p",
        "control_offsets": """WITH v AS (SELECT o_orderkey, o_orderkey * 7919 * (1 - 2 * (o_custkey % 2)) AS value FROM orders),
            b AS (SELECT *, list_transform(range(7), lambda i: printf('%02x', (abs(value) >> (8 * i)) & 255)) AS low FROM v)
            SELECT o_orderkey, array_to_string(low, '') || CASE WHEN value < 0 THEN '80' ELSE '00' END AS bytes, value FROM b""",
        "context_sizes": """WITH s AS (SELECT o_orderkey, CASE o_custkey % 10 WHEN 0 THEN 1024 WHEN 1 THEN 0 ELSE pow(2, o_custkey % 8 + 6) END AS block, pow(2, o_orderkey % 13 + 8) AS most FROM orders)
            SELECT o_orderkey, (CASE WHEN o_orderkey % 9 = 0 OR block = 0 THEN 0 ELSE 2 * least(block, most) + 16 END)::BIGINT AS ctx FROM s""",
        "host_parse": P.HEADERS_SQL + """SELECT o_orderkey, CASE WHEN flags = 16 THEN 'unsupported header flags or nonzero reserved field'
            WHEN codec_id <> 1 THEN 'unsupported codec id in header' END AS reason FROM h""",
        "newest_patches": P.HEADERS_SQL + """SELECT product_id, old_version AS running_version, o_orderkey AS pair_id, fw_version FROM h WHERE fw_version > old_version
            QUALIFY row_number() OVER (PARTITION BY product_id, old_version ORDER BY fw_version DESC, o_orderkey) = 1""",
        "degraded_journals": """WITH s AS (SELECT doc_id AS pair_id, unnest(range(1, octet_length(encode(text)) // 512 + 1)) AS step FROM documents),
            f AS (SELECT pair_id, min(step) FILTER ((pair_id + step) % 11 = 0) AS first FROM s GROUP BY pair_id)
            SELECT pair_id, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS flags, count(*) FILTER (first IS NULL OR step < first) AS kept FROM s JOIN f USING (pair_id) GROUP BY pair_id, first""",
    }
