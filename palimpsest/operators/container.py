"""Building, inspecting, verifying and opening patches of both container versions, a row a patch."""

from __future__ import annotations

import itertools
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import crypto
from ..functions import delta as D
from ..functions import layout as L
from ..functions import sizing as Z
from .delta import mapped
from .validate import first_failure, header_2, records, tlvs

CODEC_FLAGS = {L.LZ4: L.LZ4_FLAG, L.LZMA: L.LZMA_FLAG, L.RAW: L.RAW_FLAG}


def framing(block_log2: int, new_size: int) -> int:
    """log2 of the frame size of an image; see sizing.image_framing."""
    return block_log2 if new_size <= 0 or block_log2 <= 8 else min(block_log2, max(8, new_size.bit_length() - 1))


def make_patches(pairs: DataFrame, codec: int = L.LZ4, block_log2: int = 10, dictionary: int = C.DICTIONARY, provider: crypto.Provider | None = None, custom: dict[int, C.Codec] | None = None) -> DataFrame:
    """(pair_id, product_id, old_version, fw_version, old, new) -> (pair_id, blob), version 1. With a provider
    patches are signed. The kernel makes the stream; the header is expressions."""
    chosen = C.find(codec, custom)
    if chosen is None:
        raise ValueError(f"no codec {codec}")

    def one(row):
        old, new = row["old"] or b"", row["new"] or b""
        delta, log2 = D.encode(old, new), framing(block_log2, len(new))
        props, stream = chosen.encode(delta, 1 << log2, dictionary)
        return [{k: row[k] for k in ("pair_id", "product_id", "old_version", "fw_version", "old", "new")} | {"log2": log2, "props": props, "stream": stream, "workspace": chosen.workspace(props)}]

    columns = ["pair_id", "product_id", "old_version", "fw_version", "old", "new"]
    made = mapped(pairs.select(*columns), one, columns, "log2 bigint, props binary, stream binary, workspace bigint")
    old, new = F.coalesce("old", F.lit(b"")), F.coalesce("new", F.lit(b""))
    flags = CODEC_FLAGS.get(codec, 0) | (L.SIGNED if provider else 0)
    head = L.build_header(
        {
            "magic": F.lit(L.MAGIC_1),
            "hdr_len": F.lit(L.HEADER_1),
            "hdr_ver": F.lit(L.VERSION_1),
            "flags": F.lit(flags),
            "product_id": F.col("product_id"),
            "fw_version": F.col("fw_version"),
            "old_size": F.octet_length(old),
            "new_size": F.octet_length(new),
            "payload_size": F.octet_length("props") + F.octet_length("stream"),
            "old_crc32": F.crc32(old),
            "new_crc32": F.crc32(new),
            "payload_crc32": F.crc32("stream"),
            "workspace_req": F.col("workspace"),
            "old_version": F.col("old_version"),
            "codec_id": F.lit(codec),
            "block_log2": F.col("log2"),
        }
    )
    out = made.select("pair_id", F.concat(head, "props", "stream").alias("blob"), F.octet_length("props").alias("skip"))
    if provider is None:
        return out.select("pair_id", "blob")

    def signed(row):
        blob, body = row["blob"], L.HEADER_1 + row["skip"]
        signature = provider.signs(blob[: L.SIGNATURE_AT] + blob[body:], False)
        return [{"pair_id": row["pair_id"], "blob": blob[: L.SIGNATURE_AT] + signature + blob[L.HEADER_1 :]}]

    return mapped(out, signed, ["pair_id"], "blob binary")


def pack_2(old: bytes, new: bytes, product_id: int, old_version: int, fw_version: int, nonce_prefix: bytes, key_id: bytes, provider: crypto.Provider, record_log2: int = 13, tags: bytes = b"") -> bytes:
    """One version 2 patch: every frame, and the closing marker, is a record of its own under the header."""
    return pack_all_2([(old, new, product_id, old_version, fw_version, nonce_prefix)], key_id, provider, record_log2, tags)[0]


def pack_all_2(images: list[tuple[bytes, bytes, int, int, int, bytes]], key_id: bytes, provider: crypto.Provider, record_log2: int = 13, tags: bytes = b"") -> list[bytes]:
    """pack_2 of each (old, new, product_id, old_version, fw_version, nonce_prefix); the key streams are made together."""
    key, plans = provider.keys[key_id], [_unsealed(key_id, provider.keys[key_id], record_log2, tags, *image) for image in images]
    prefixes = [image[-1] for image in images]
    made = iter(crypto.streams([(key, prefix + i.to_bytes(8, "little"), len(plain)) for prefix, (_, parts) in zip(prefixes, plans, strict=True) for i, plain in enumerate(parts)]))
    out = []
    for prefix, (head, parts) in zip(prefixes, plans, strict=True):
        area = bytearray()
        for i, plain in enumerate(parts):
            area += len(plain).to_bytes(4, "little") + crypto.encrypt(key, prefix + i.to_bytes(8, "little"), plain, associated(bytes(head), i, len(plain)), next(made))
        head[L.PAYLOAD_CRC_AT : L.PAYLOAD_CRC_AT + 4] = zlib.crc32(area).to_bytes(4, "little")
        head[L.SIGNATURE_AT : L.SIGNATURE_AT + L.SIGNATURE_SIZE] = provider.signs(L.SIGNATURE_DOMAIN + bytes(head) + bytes(area), True)
        out.append(bytes(head + area))
    return out


def _unsealed(key_id: bytes, key: bytes, record_log2: int, tags: bytes, old: bytes, new: bytes, product_id: int, old_version: int, fw_version: int, nonce_prefix: bytes) -> tuple[bytearray, list[bytes]]:
    """(header without payload checksum and signature, contents of the records) of a version 2 patch."""
    if len(key) != 32 or len(key_id) != 16 or len(nonce_prefix) != 16 or not any(nonce_prefix) or not 8 <= record_log2 <= 13 or len(tags) % 4:
        raise ValueError("key of 32, key id and nonzero nonce prefix of 16 bytes, record_log2 8 to 13, tags in fours")
    size = (1 << record_log2) - 64  # a literal block of this size still fits a record
    framed = C.frames(D.encode(old, new), min(size, len(new)) if new else size)
    parts = [len(b).to_bytes(4, "little") + b for b in C.frame_blocks(framed)] + [bytes(4)]
    length = L.HEADER_2 + len(tags)
    numbers = {"magic": L.MAGIC_2, "hdr_len": length, "hdr_ver": L.VERSION_2, "flags": L.REQUIRED_2, "product_id": product_id, "fw_version": fw_version, "old_size": len(old), "new_size": len(new), "payload_size": sum(4 + len(p) + L.TAG for p in parts), "old_crc32": zlib.crc32(old), "new_crc32": zlib.crc32(new), "workspace_req": workspace_2(record_log2, length), "old_version": old_version, "codec_id": L.LZ4, "block_log2": record_log2, "tlv_len": len(tags), "key_id": key_id, "nonce_prefix": nonce_prefix + bytes(8), "record_count": len(parts)}
    head = bytearray(length)
    for name, at, width in L.LAYOUT_2:
        value = numbers.get(name, 0)
        head[at : at + width] = value if isinstance(value, bytes) else value.to_bytes(width, "little")
    head[L.HEADER_2 :] = tags
    return head, parts


def workspace_2(record_log2: int, hdr_len: int, lz4_state: int = C.LZ4_STATE) -> int:
    two = 2 << record_log2
    return Z.SYNTHETIC_HEADER + two + 4 + 16 + hdr_len + two + lz4_state


def associated(head: bytes, index: int, size: int) -> bytes:
    """What a record's tag covers beside its ciphertext: the header without signature and payload checksum."""
    clean = bytearray(head)
    clean[L.SIGNATURE_AT : L.SIGNATURE_AT + L.SIGNATURE_SIZE] = bytes(L.SIGNATURE_SIZE)
    clean[L.PAYLOAD_CRC_AT : L.PAYLOAD_CRC_AT + 4] = bytes(4)
    return L.RECORD_DOMAIN + bytes(clean) + index.to_bytes(4, "little") + size.to_bytes(4, "little")


def make_patches_2(pairs: DataFrame, provider: crypto.Provider, key_id: bytes, record_log2: int = 13, tags: bytes = b"") -> DataFrame:
    """(pair_id, product_id, old_version, fw_version, old, new, nonce_prefix) -> (pair_id, blob), version 2. The
    nonce prefix is an input, so that the result depends on the rows alone; it must not repeat under a key."""

    def several(rows):
        images = [(row["old"] or b"", row["new"] or b"", row["product_id"], row["old_version"], row["fw_version"], row["nonce_prefix"]) for row in rows]
        for row, blob in zip(rows, pack_all_2(images, key_id, provider, record_log2, tags), strict=True):
            yield {"pair_id": row["pair_id"], "blob": blob}

    return mapped(pairs.select("pair_id", "product_id", "old_version", "fw_version", "old", "new", "nonce_prefix"), several, ["pair_id"], "blob binary", together=True)


def structure_2(patches: DataFrame) -> DataFrame:
    """patches (..., blob) with head, tags, area (walked records), status and site of a version 2 container."""
    out = L.held(patches, "head", L.header(F.col("blob"), 2))
    sound_length = F.col("head.hdr_len").between(L.HEADER_2, L.HEADER_2_MAX)
    tag_area = F.when(sound_length, F.substring("blob", F.lit(L.HEADER_2 + 1), (F.col("head.hdr_len") - L.HEADER_2).cast("int"))).otherwise(F.lit(b""))
    out = L.held(out, "tags", tlvs(tag_area, F.octet_length(tag_area)))
    rest = F.when(sound_length, F.substring("blob", (F.col("head.hdr_len") + 1).cast("int"), F.octet_length("blob"))).otherwise(F.lit(b""))
    out = out.withColumn("area", records(rest, F.col("head.record_count"), F.col("head.block_log2")))
    verdict = first_failure(header_2(F.col("blob"), F.col("head"), F.col("tags.sound"), F.col("area.sound")))
    return L.held(out, "_v", verdict).withColumn("status", F.col("_v.status")).withColumn("site", F.col("_v.site")).drop("_v")


def record_rows(patches: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id_col, index, ct, tag): the records of sound version 2 patches."""
    sound = structure_2(patches).where("status = 0").select(id_col, "blob", "head", F.explode("area.entries").alias("e"))
    at = F.col("head.hdr_len") + F.col("e.at")
    return sound.select(id_col, F.col("e.index").alias("index"), L.span(F.col("blob"), at, F.col("e.len")).alias("ct"), L.span(F.col("blob"), at + F.col("e.len"), L.TAG).alias("tag"))


def tag_rows(patches: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id_col, n, type, flags, value): the tag entries of version 2 patches whose tag area is sound."""
    found = structure_2(patches).where("tags.sound").select(id_col, "blob", F.posexplode("tags.entries").alias("n", "e"))
    return found.select(id_col, "n", F.col("e.type").alias("type"), F.col("e.flags").alias("flags"), L.span(F.col("blob"), F.col("e.at") + L.HEADER_2, F.col("e.len")).alias("value"))


def inspect(patches: DataFrame) -> DataFrame:
    """patches (pair_id, blob) with the fields that a report prints. The payload checksum runs to the blob's end,
    as reports have it, so trailing bytes show as a mismatch."""
    out = L.held(patches.select("pair_id", "blob", L.sniff(F.col("blob")).alias("version")), "h", L.header(F.col("blob"), 1))
    body = F.when(F.col("version") == 1, F.substring("blob", (F.col("h.hdr_len") + L.props_size(F.col("h.codec_id")) + 1).cast("int"), F.octet_length("blob"))).otherwise(F.substring("blob", (F.col("h.hdr_len") + 1).cast("int"), F.octet_length("blob")))
    names = ["flags", "product_id", "old_version", "fw_version", "old_size", "new_size", "payload_size", "old_crc32", "new_crc32", "payload_crc32", "workspace_req", "block_log2"]
    return out.select("pair_id", "version", F.octet_length("blob").cast("long").alias("patch_size"), *(F.col(f"h.{n}").alias(n) for n in names), L.codec_name(F.col("h.codec_id")).alias("codec"), Z.patch_ratio(F.octet_length("blob"), F.col("h.new_size")).alias("ratio"), (F.crc32(body) == F.col("h.payload_crc32")).alias("payload_ok"))


def verify_signatures(patches: DataFrame, provider: crypto.Provider) -> DataFrame:
    """(pair_id, signed, valid): unsigned patches are not valid, nor is anything without a public key."""
    blob = F.col("blob")
    out = L.held(patches.select("pair_id", "blob", L.sniff(blob).alias("version")), "h", L.header(blob, 1))
    span: Column = F.when(F.col("version") == 2, L.signed_span_2(blob, F.col("h"))).otherwise(L.signed_span_1(blob, F.col("h")))
    signed = (F.col("version").isNotNull()) & (F.col("h.flags").bitwiseAND(F.lit(L.SIGNED)) != 0)
    rows = out.select("pair_id", "version", F.coalesce(signed, F.lit(False)).alias("signed"), F.col("h.signature").alias("signature"), span.alias("span"))

    def one(row):
        valid = row["signed"] and row["signature"] is not None and provider.verifies(row["signature"], row["span"] or b"", row["version"] == 2)
        return [{"pair_id": row["pair_id"], "signed": row["signed"], "valid": bool(valid)}]

    return mapped(rows, one, ["pair_id", "signed"], "valid boolean")


def _walked(blob: bytes, provider: crypto.Provider, start: int) -> list[tuple[bytes, bytes, int]]:
    """(key, nonce, size) of the records from number `start` on, as far as they are sound; none without a key."""
    at, count, key = int.from_bytes(blob[4:6], "little"), int.from_bytes(blob[160:164], "little"), provider.keys.get(blob[120:136])
    out, window = [], 1 << blob[53]
    if key is None or start >= count:
        return []
    for i in range(count):
        size = int.from_bytes(blob[at : at + 4], "little")
        if not 0 < size <= window or at + 4 + size + L.TAG > len(blob):
            break
        if i >= start:
            out.append((key, blob[136:152] + i.to_bytes(8, "little"), size))
        at += 4 + size + L.TAG
    return out


def record_streams(wanted: list[tuple[bytes, int]], provider: crypto.Provider) -> list[list[bytes]]:
    """The key streams that opened_records takes for each (blob, start), made together."""
    walks = [_walked(blob, provider, start) for blob, start in wanted]
    made = iter(crypto.streams([record for walk in walks for record in walk]))
    return [list(itertools.islice(made, len(walk))) for walk in walks]


def opened_records(blob: bytes, provider: crypto.Provider, start: int = 0, streams: list[bytes] | None = None) -> tuple[list[bytes], int, int]:
    """(decoded contents of each record from number `start` on, status, site) of a version 2 patch whose structure is
    sound: key, records in order, contents. streams: those of record_streams, if they are there already."""
    length, count = (int.from_bytes(blob[a : a + w], "little") for a, w in ((4, 2), (160, 4)))
    head, key = blob[:length], provider.keys.get(blob[120:136])
    if key is None:
        return [], L.NOT_FOUND, 41
    if start >= count:
        return [], L.PARAM, 44
    streams = record_streams([(blob, start)], provider)[0] if streams is None else streams
    at, out, window = length, [], 1 << blob[53]
    for i in range(count):
        size = int.from_bytes(blob[at : at + 4], "little")
        if not 0 < size <= window or at + 4 + size + L.TAG > len(blob):
            return [], L.FORMAT, 45
        if i >= start:
            cipher, tag = blob[at + 4 : at + 4 + size], blob[at + 4 + size : at + 4 + size + L.TAG]
            plain = crypto.decrypt(key, blob[136:152] + i.to_bytes(8, "little"), cipher, tag, associated(head, i, size), streams[i - start])
            if plain is None:
                return [], L.AUTH, 46
            try:
                block = C.frame_blocks(plain)
                out.append(b"".join(C.decode_block(b, window) for b in block))
            except C.BadStream:
                return [], L.CORRUPT, 47
            if len(plain) != 4 + sum(map(len, block)):
                return [], L.CORRUPT, 47
        at += 4 + size + L.TAG
    return out, L.OK, 0


def open_2(blob: bytes, provider: crypto.Provider, start: int = 0, streams: list[bytes] | None = None) -> tuple[bytes, int, int]:
    """(delta from record `start` on, status, site); a patch without any contents is corrupt."""
    parts, status, site = opened_records(blob, provider, start, streams)
    delta = b"".join(parts)
    return (delta, status, site) if delta or status != L.OK else (b"", L.CORRUPT, 47)


def record_lengths(patches: DataFrame, provider: crypto.Provider, id_col: str = "pair_id") -> DataFrame:
    """(id_col, index, decoded, base_d): how many delta bytes each record of sound version 2 patches holds, and where they
    begin in the delta. A patch that does not open has no rows."""

    def several(rows):
        made = record_streams([(row["blob"], 0) for row in rows], provider)
        for row, streams in zip(rows, made, strict=True):
            parts, status, _ = opened_records(row["blob"], provider, 0, streams)
            at = 0
            for i, p in enumerate(parts if status == L.OK else ()):
                yield {id_col: row[id_col], "index": i, "decoded": len(p), "base_d": at}
                at += len(p)

    sound = structure_2(patches.select(id_col, "blob")).where("status = 0")
    return mapped(sound.select(id_col, "blob"), several, [id_col], "index bigint, decoded bigint, base_d bigint", together=True)


def area_length(patches: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id_col, records, area): how many records version 2 patches have and how many bytes these take with length and tag."""
    return record_rows(patches, id_col).groupBy(id_col).agg(F.count("*").alias("records"), F.sum(F.octet_length("ct") + 4 + F.octet_length("tag")).alias("area"))


def repeated_nonces(pairs: DataFrame) -> DataFrame:
    """The nonce prefixes that several rows of pairs (nonce_prefix) use, with how many: under one key there must be none."""
    return pairs.groupBy("nonce_prefix").agg(F.count("*").alias("uses")).where("uses > 1")


def signed_again(patches: DataFrame, provider: crypto.Provider) -> DataFrame:
    """patches (pair_id, blob) of version 2 with payload checksum and signature made anew, as for a changed record area."""

    def one(row):
        blob = bytearray(row["blob"])
        length = int.from_bytes(blob[4:6], "little")
        blob[L.PAYLOAD_CRC_AT : L.PAYLOAD_CRC_AT + 4] = zlib.crc32(blob[length:]).to_bytes(4, "little")
        blob[L.SIGNATURE_AT : L.SIGNATURE_AT + L.SIGNATURE_SIZE] = bytes(L.SIGNATURE_SIZE)
        blob[L.SIGNATURE_AT : L.SIGNATURE_AT + L.SIGNATURE_SIZE] = provider.signs(L.SIGNATURE_DOMAIN + bytes(blob), True)
        return [{"pair_id": row["pair_id"], "blob": bytes(blob)}]

    return mapped(patches.select("pair_id", "blob"), one, ["pair_id"], "blob binary")


def lzma_info(patches: DataFrame) -> DataFrame:
    """(pair_id, lc, lp, pb, dict_size, content_size, workspace) of version 1 patches that are LZMA's; null fields and a
    workspace of 0 where the properties are unusable."""
    rows = L.held(patches.select("pair_id", "blob"), "h", L.header(F.col("blob"), 1)).where(F.col("h.codec_id") == L.LZMA)
    rows = L.held(rows, "p", L.lzma_props(F.col("blob"), F.col("h.hdr_len")))
    return rows.select("pair_id", "p.lc", "p.lp", "p.pb", "p.dict_size", "p.content_size", Z.codec_workspace(F.col("h.codec_id"), F.col("p")).alias("workspace"))
