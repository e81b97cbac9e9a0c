"""Ordered validation: the first check that fails gives (status, site). Bad input is data, never an exception.

Every rule list is one CASE, so Spark evaluates rows in generated code and cheap checks shield dear ones.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import layout as L
from ..functions import sizing as Z

Rule = tuple[Column, int, int]


def first_failure(rules: list[Rule]) -> Column:
    """(status, site) of the first rule that holds; a null condition does not."""
    out = F.struct(F.lit(L.OK).alias("status"), F.lit(0).alias("site"))
    for condition, status, site in reversed(rules):
        out = F.when(condition, F.struct(F.lit(status).alias("status"), F.lit(site).alias("site"))).otherwise(out)
    return out


def header_1(blob: Column, head: Column, device: dict[str, Column], unlimited: bool = False, custom: tuple[int, ...] = ()) -> list[Rule]:
    """Rules of a version 1 header for a device with product_id, running_version, ram_budget and, if set, codec
    (0: any), lzma_max_dict and lzma_max_lc_plus_lp (0: no limit). unlimited: whatever the memory budget."""
    size, flags, codec = F.octet_length(blob), head["flags"], head["codec_id"]
    on = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    running = device["running_version"]
    wanted = device.get("codec", F.lit(L.AUTO))
    known = codec.isin(L.LZ4, L.LZMA, L.RAW, *custom)
    strange = (
        (head["reserved"] != 0)
        | (flags.bitwiseAND(F.lit(0xFFFFFFFF ^ (L.SIGNED | L.RAW_FLAG | L.LZMA_FLAG | L.LZ4_FLAG))) != 0)
        | (on(L.RAW_FLAG) != (codec == L.RAW))
        | (on(L.LZ4_FLAG) & (codec != L.LZ4))
        | (on(L.LZMA_FLAG) & (codec != L.LZMA))
        | (on(L.RAW_FLAG) & (on(L.LZ4_FLAG) | on(L.LZMA_FLAG)))
    )
    props = L.lzma_props(blob, head["hdr_len"])
    lzma = codec == L.LZMA
    most_bits, most_dict = device.get("lzma_max_lc_plus_lp", F.lit(0)), device.get("lzma_max_dict", F.lit(0))
    budget = device["ram_budget"]
    memory = [] if unlimited else [
        (head["workspace_req"] > budget, L.TOO_LARGE, 14),
        (Z.power(head["block_log2"]) > F.floor((budget - head["workspace_req"]) / 2), L.TOO_LARGE, 14),
    ]
    return [
        (blob.isNull(), L.PARAM, 2),
        (size < L.HEADER_1, L.TRUNCATED, 12),
        (head["magic"] != L.MAGIC_1, L.FORMAT, 2),
        (F.floor(head["hdr_ver"] / 256) != L.VERSION_1 >> 8, L.UNSUPPORTED, 3),
        (~head["hdr_len"].between(L.HEADER_1, L.HEADER_1_MAX) | (head["hdr_len"] > size), L.FORMAT, 4),
        (head["product_id"] != device["product_id"], L.PRODUCT, 5),
        (head["fw_version"] <= running, L.ROLLBACK, 6),
        (head["old_version"] != running, L.MISMATCH, 7),
        (strange, L.FORMAT, 9),
        ((codec == L.AUTO) | ((codec >= L.CODEC_END) & (codec < L.CUSTOM)), L.UNSUPPORTED, 9),
        ((wanted != L.AUTO) & (wanted != codec), L.UNSUPPORTED, 9),
        (~known, L.UNSUPPORTED, 9),
        ((head["old_size"] == 0) | (head["new_size"] == 0) | (head["payload_size"] == 0), L.FORMAT, 8),
        (head["payload_size"] > size - head["hdr_len"], L.TRUNCATED, 12),
        (~head["block_log2"].between(8, 20), L.FORMAT, 8),
        *memory,
        (L.props_size(codec) >= head["payload_size"], L.FORMAT, 8),
        (lzma & (props["lc"].isNull() | (props["content_size"] == 0)), L.FORMAT, 33),
        (lzma & (most_bits != 0) & (props["lc"] + props["lp"] > most_bits), L.FORMAT, 33),
        (lzma & (most_dict != 0) & (props["dict_size"] > most_dict), L.TOO_LARGE, 14),
    ]


def tlvs(area: Column, size: Column) -> Column:
    """Entries (type, flags, value_at, value_len) of a tag area, and whether it is sound, from a walk over its
    four-byte steps: an entry is 8 bytes and its value, zero-padded to four; flag bit 0 marks a critical type, and
    1 is the only one known."""
    steps = F.sequence(F.lit(0), F.greatest(F.floor(size / 4) - 1, F.lit(0)))
    start = F.struct(F.lit(0).cast("long").alias("next"), F.lit(True).alias("sound"), F.array().cast("array<struct<type:bigint,flags:bigint,at:bigint,len:bigint>>").alias("entries"))

    def step(acc: Column, i: Column) -> Column:
        at = (i * 4).cast("long")
        here = acc["sound"] & (acc["next"] == at) & (at < size)
        kind, flags, length = L.number(area, at, 2), L.number(area, at + 2, 2), L.number(area, at + 4, 4)
        end = at + 8 + length
        stop = F.ceil(end / 4) * 4
        pad = F.substring(area, (end + 1).cast("int"), (stop - end).cast("int"))
        whole = (size - at >= 8) & (length <= size - at - 8)
        fine = whole & ~((flags.bitwiseAND(F.lit(1)) != 0) & (kind != 1)) & (stop <= size) & (F.hex(pad) == F.repeat(F.lit("00"), (stop - end).cast("int")))
        fine = F.coalesce(fine, F.lit(False))
        entry = F.array(F.struct(kind.alias("type"), flags.alias("flags"), (at + 8).alias("at"), length.alias("len")))
        return F.when(here, F.struct(F.when(fine, stop).otherwise(acc["next"]).cast("long").alias("next"), fine.alias("sound"), F.when(fine, F.concat(acc["entries"], entry)).otherwise(acc["entries"]).alias("entries"))).otherwise(acc)

    walked = F.aggregate(steps, start, step)
    return F.when(size % 4 != 0, F.struct(F.lit(False).alias("sound"), start["entries"].alias("entries"))).otherwise(F.struct((walked["sound"] & (walked["next"] == size)).alias("sound"), walked["entries"].alias("entries")))


_ENTRY = T.StructType([T.StructField(n, T.LongType()) for n in ("index", "at", "len")])
_AREA = T.StructType([T.StructField("sound", T.BooleanType()), T.StructField("longest", T.LongType()), T.StructField("entries", T.ArrayType(_ENTRY))])


@F.pandas_udf(_AREA)
def records(area: pd.Series, count: pd.Series, log2: pd.Series) -> pd.DataFrame:
    """A record area: whether `count` records of length, ciphertext and tag use it exactly, the longest
    ciphertext, and where each one lies. The walk depends on every length before, so it is a kernel."""
    rows = []
    for data, n, bits in zip(area, count, log2, strict=True):
        at, entries = 0, []
        fits = data is not None and not pd.isna(n) and not pd.isna(bits) and n * (5 + L.TAG) <= len(data)
        while fits and len(entries) < n:
            size = int.from_bytes(data[at : at + 4], "little")
            if at + 4 + size + L.TAG > len(data) or not 0 < size <= 1 << int(bits):
                break
            entries.append({"index": len(entries), "at": at + 4, "len": size})
            at += 4 + size + L.TAG
        sound = bool(fits and len(entries) == n and at == len(data))
        rows.append((sound, max((e["len"] for e in entries), default=0), entries))
    return pd.DataFrame(rows, columns=["sound", "longest", "entries"])


def header_2(blob: Column, head: Column, tlvs_sound: Column, records_sound: Column) -> list[Rule]:
    """Rules of a version 2 container, all at site 35."""
    size, flags = F.octet_length(blob), head["flags"]
    zeros = lambda n: F.lit(bytes(n))
    area = size - head["hdr_len"]
    rules = [
        (blob.isNull() | (size < L.HEADER_2), L.PARAM),
        (head["magic"] != L.MAGIC_2, L.FORMAT),
        (~head["hdr_len"].between(L.HEADER_2, L.HEADER_2_MAX) | (head["hdr_len"] > size) | (head["hdr_len"] % 4 != 0), L.FORMAT),
        (head["hdr_ver"] != L.VERSION_2, L.UNSUPPORTED),
        (flags.bitwiseAND(F.lit(0xFFFFFFFF ^ L.KNOWN_2)) != 0, L.FORMAT),
        (flags != L.REQUIRED_2, L.UNSUPPORTED),
        ((head["reserved"] != zeros(8)) | (head["header_digest"] != zeros(16)), L.FORMAT),
        (head["tlv_len"] != head["hdr_len"] - L.HEADER_2, L.FORMAT),
        (~tlvs_sound, L.FORMAT),
        (head["codec_id"] != L.LZ4, L.UNSUPPORTED),
        (head["codec_profile"] != 0, L.UNSUPPORTED),
        (~head["block_log2"].between(8, 13), L.FORMAT),
        ((head["key_id"] == zeros(16)) | (F.substring(head["nonce_prefix"], 17, 8) != zeros(8)), L.FORMAT),
        (head["record_count"] == 0, L.FORMAT),
        (head["payload_size"] > area, L.TRUNCATED),
        (head["payload_size"] != area, L.FORMAT),
        (~records_sound, L.FORMAT),
    ]
    return [(condition, status, 35) for condition, status in rules]


def host_reason_1(blob: Column, head: Column) -> Column:
    """Why a host tool refuses to parse a version 1 header, null if it does not. It knows no device, and is stricter about
    codec flags than devices are; sizes, versions and the payload are left to them."""
    size, flags, codec = F.octet_length(blob), head["flags"], head["codec_id"]
    on = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    raw, lzma, lz4 = on(L.RAW_FLAG), on(L.LZMA_FLAG), on(L.LZ4_FLAG)
    # The texts that host tools print.
    reasons = [
        (blob.isNull() | (size < L.HEADER_1), "patch is shorter than the minimum header"),
        (head["magic"] != L.MAGIC_1, "bad magic"),
        ((head["hdr_len"] < L.HEADER_1) | (head["hdr_len"] > size), "invalid header length"),
        ((head["reserved"] != 0) | (flags.bitwiseAND(F.lit(0xFFFFFFFF ^ (L.SIGNED | L.RAW_FLAG | L.LZMA_FLAG | L.LZ4_FLAG))) != 0), "unsupported header flags or nonzero reserved field"),
        (~(raw | lzma | lz4), "missing codec flag"),
        (lz4 & lzma, "multiple codec flags are not supported"),
        (raw & (lz4 | lzma), "raw patches cannot select a codec"),
        ((codec == L.LZ4) & ~lz4, "LZ4 patch is missing FLAG_CODEC_LZ4"),
        ((codec == L.LZMA) & ~lzma, "LZMA patch is missing FLAG_CODEC_LZMA"),
        (raw != (codec == L.RAW), "raw flag and codec id disagree"),
        (~codec.isin(L.LZ4, L.LZMA, L.RAW), "unsupported codec id in header"),
    ]
    out = F.lit(None).cast("string")
    for condition, text in reversed(reasons):
        out = F.when(condition, text).otherwise(out)
    return out


def host_reason_2(blob: Column, head: Column, tlvs_sound: Column) -> Column:
    """As host_reason_1 for version 2 headers; the record area is not looked at."""
    size, zeros = F.octet_length(blob), (lambda n: F.lit(bytes(n)))
    length = head["hdr_len"]
    # The texts that host tools print.
    reasons = [
        (blob.isNull() | (size < L.HEADER_2), "MFP2 patch is shorter than 192-byte header"),
        ((head["magic"] != L.MAGIC_2) | (head["hdr_ver"] != L.VERSION_2) | ~length.between(L.HEADER_2, L.HEADER_2_MAX) | (length % 4 != 0) | (length > size), "invalid MFP2 header"),
        ((head["tlv_len"] != length - L.HEADER_2) | (head["flags"] != L.REQUIRED_2) | (head["codec_id"] != L.LZ4) | ~head["block_log2"].between(8, 13), "unsupported MFP2 profile"),
        ((head["record_count"] == 0) | (head["codec_profile"] != 0), "invalid MFP2 record/profile fields"),
        ((head["reserved"] != zeros(8)) | (head["header_digest"] != zeros(16)) | (head["key_id"] == zeros(16)) | (F.substring(head["nonce_prefix"], 17, 8) != zeros(8)), "invalid MFP2 reserved/key fields"),
        (~tlvs_sound, "invalid MFP2 TLV"),
    ]
    out = F.lit(None).cast("string")
    for condition, text in reversed(reasons):
        out = F.when(condition, text).otherwise(out)
    return out
