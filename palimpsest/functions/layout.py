"""Container layouts as data. One table a format generates both the parsing and the building expressions.

All integers are little-endian and unsigned; they are BIGINT columns, since 32-bit flags, checksums and
versions do not fit INT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
MAGIC_1, MAGIC_2 = 0x3150464D, 0x3250464D
HEADER_1, HEADER_1_MAX = 120, 288
HEADER_2, HEADER_2_MAX = 192, 4096
VERSION_1, VERSION_2 = 0x0100, 0x0200
SIGNED, RAW_FLAG, LZMA_FLAG, LZ4_FLAG = 1, 2, 4, 8
ENCRYPTED_2 = 2
REQUIRED_2 = SIGNED | ENCRYPTED_2 | LZ4_FLAG
KNOWN_2 = 0x1F
AUTO, LZ4, LZMA, RAW, CODEC_END, CUSTOM = 0, 1, 2, 3, 4, 0x80
TAG = 16
SIGNATURE_AT, SIGNATURE_SIZE, PAYLOAD_CRC_AT = 56, 64, 40
SIGNATURE_DOMAIN, RECORD_DOMAIN = b"MCF2SIG\0", b"MCF2REC\0"

#: (name, offset, width); a width over 4 is a byte string.
SHARED = (
    ("magic", 0, 4),
    ("hdr_len", 4, 2),
    ("hdr_ver", 6, 2),
    ("flags", 8, 4),
    ("product_id", 12, 4),
    ("fw_version", 16, 4),
    ("old_size", 20, 4),
    ("new_size", 24, 4),
    ("payload_size", 28, 4),
    ("old_crc32", 32, 4),
    ("new_crc32", 36, 4),
    ("payload_crc32", 40, 4),
    ("workspace_req", 44, 4),
    ("old_version", 48, 4),
    ("codec_id", 52, 1),
    ("block_log2", 53, 1),
)
LAYOUT_1 = (*SHARED, ("reserved", 54, 2), ("signature", 56, 64))
LAYOUT_2 = (
    *SHARED,
    ("tlv_len", 54, 2),
    ("signature", 56, 64),
    ("key_id", 120, 16),
    ("nonce_prefix", 136, 24),
    ("record_count", 160, 4),
    ("codec_profile", 164, 4),
    ("reserved", 168, 8),
    ("header_digest", 176, 16),
)
LAYOUTS = {1: LAYOUT_1, 2: LAYOUT_2}

# The texts that devices log, and the names of a session's states in their order.
STATES = ("idle", "header", "validate", "alloc", "decode", "apply", "writeback", "verify", "commit", "done", "failed")
STATUSES = {
    0: "ok",
    -1: "invalid argument",
    -2: "invalid state",
    -3: "out of memory",
    -4: "malformed patch",
    -5: "unsupported feature",
    -6: "patch needs more memory than budgeted",
    -7: "patch is for a different product",
    -8: "base image does not match",
    -9: "corrupt patch",
    -10: "patch is truncated",
    -11: "signature verification failed",
    -12: "refusing downgrade",
    -13: "flash write failed",
    -14: "source or sink read failed",
    -15: "aborted by caller",
    -16: "rejected by commit hook",
    -17: "not found",
    -18: "authentication failed",
}
OK, PARAM, STATE, NOMEM, FORMAT, UNSUPPORTED, TOO_LARGE, PRODUCT, MISMATCH, CORRUPT, TRUNCATED, BAD_SIGNATURE, ROLLBACK, FLASH, IO, ABORTED, COMMIT, NOT_FOUND, AUTH = STATUSES
CODEC_NAMES = {LZ4: "lz4", LZMA: "lzma", RAW: "raw"}
PROPS = {LZ4: 4, LZMA: 9}
LIBRARY_VERSION = (1, 12, 0)


def number(data: Column, at: int | Column, width: int) -> Column:
    """The unsigned little-endian integer of up to 7 bytes at an offset from 0; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.hex(F.substring(data, at + i + 1, F.lit(1))) for i in reversed(range(width))]
    text = F.concat(*parts)
    return F.when(F.octet_length(data) >= at + width, F.conv(text, 16, 10).cast("long"))


def little(value: Column, width: int) -> Column:
    """The binary of an integer, lowest byte first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(width))))


def span(data: Column, at: int | Column, size: int | Column) -> Column:
    """size bytes of data from an offset that counts from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.substring(data, (at + 1).cast("int"), size.cast("int") if isinstance(size, Column) else F.lit(size))


def header(blob: Column, version: int = 1) -> Column:
    """The header as a struct. Fields past the end of a short blob are null."""
    fields = [(number(blob, at, width) if width <= 4 else F.when(F.octet_length(blob) >= at + width, span(blob, at, width))).alias(name) for name, at, width in LAYOUTS[version]]
    return F.struct(*fields)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is evaluated once a row. A plain projection would be merged into whatever uses it,
    and a header's fields are used so often that the generated code would outgrow the compiler."""
    return df.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, value))  # never merged: not deterministic


def build_header(values: dict[str, Column], version: int = 1) -> Column:
    """The header's bytes from columns; a field that is not named is zero."""
    parts = []
    for name, _, width in LAYOUTS[version]:
        if width <= 4:
            parts.append(little(values.get(name, F.lit(0)), width))
        else:
            parts.append(values.get(name, F.lit(bytes(width))))
    return F.concat(*parts)


def signed_header(head: Column) -> Column:
    """A version 2 header as the signature covers it: the signature zeroed."""
    return F.concat(span(head, 0, SIGNATURE_AT), F.lit(bytes(SIGNATURE_SIZE)), F.substring(head, F.lit(SIGNATURE_AT + SIGNATURE_SIZE + 1), F.lit(HEADER_2_MAX)))


def associated_header(head: Column) -> Column:
    """A version 2 header as record encryption covers it: signature and payload checksum zeroed."""
    plain = signed_header(head)
    return F.concat(span(plain, 0, PAYLOAD_CRC_AT), F.lit(bytes(4)), F.substring(plain, F.lit(PAYLOAD_CRC_AT + 5), F.lit(HEADER_2_MAX)))


def props_size(codec_id: Column) -> Column:
    """Bytes of codec properties before the stream."""
    return F.when(codec_id == LZ4, PROPS[LZ4]).when(codec_id == LZMA, PROPS[LZMA]).otherwise(0)


def stream(blob: Column, head: Column) -> Column:
    """The compressed stream of a version 1 patch: the payload without the properties."""
    skip = props_size(head["codec_id"])
    return span(blob, head["hdr_len"] + skip, F.greatest(head["payload_size"] - skip, F.lit(0)))


def signed_span_1(blob: Column, head: Column) -> Column:
    """What a version 1 signature covers: the header before the signature, and the stream."""
    return F.concat(span(blob, 0, SIGNATURE_AT), stream(blob, head))


def signed_span_2(blob: Column, head: Column) -> Column:
    """What a version 2 signature covers: domain, header without signature, record area."""
    rest = F.substring(blob, (head["hdr_len"] + 1).cast("int"), F.octet_length(blob))
    return F.concat(F.lit(SIGNATURE_DOMAIN), signed_header(span(blob, 0, head["hdr_len"])), rest)


def nonce(prefix: Column, index: Column) -> Column:
    """Nonce of a record: 16 bytes of prefix and the index in 8."""
    return F.concat(span(prefix, 0, 16), little(index, 8))


def associated_data(head: Column, index: Column, size: Column) -> Column:
    return F.concat(F.lit(RECORD_DOMAIN), associated_header(head), little(index, 4), little(size, 4))


def lzma_props(blob: Column, at: int | Column = 0) -> Column:
    """lc, lp, pb, dict_size (4096 at least) and content_size of nine property bytes; null lc if invalid."""
    v = number(blob, at, 1)
    off = (lambda n: at + n)
    sound = v < 225
    return F.struct(
        F.when(sound, v % 9).alias("lc"),
        F.when(sound, F.floor(v / 9) % 5).alias("lp"),
        F.when(sound, F.floor(v / 45)).alias("pb"),
        F.greatest(number(blob, off(1), 4), F.lit(4096)).alias("dict_size"),
        number(blob, off(5), 4).alias("content_size"),
    )


def offset_value(data: Column, at: int | Column) -> Column:
    """A control offset: 55 bits of magnitude and the sign in the top bit of eight bytes."""
    low, top = number(data, at, 7), number(data, (at + 7), 1)
    magnitude = low.bitwiseAND(F.lit((1 << 55) - 1))
    return F.when(top >= 128, -magnitude).otherwise(magnitude)


def offset_bytes(value: Column) -> Column:
    """Eight bytes of a control offset, sign and magnitude."""
    return F.concat(little(F.abs(value), 7), F.unhex(F.when(value < 0, F.lit("80")).otherwise(F.lit("00"))))


def status_text(status: Column) -> Column:
    out = F.lit("unknown error")
    for code, text in STATUSES.items():
        out = F.when(status == code, text).otherwise(out)
    return out


def codec_name(codec_id: Column) -> Column:
    """Name of a built-in codec, "?" for any other id."""
    out = F.lit("?")
    for code, name in CODEC_NAMES.items():
        out = F.when(codec_id == code, name).otherwise(out)
    return out


def log_line(status: Column, site: Column) -> Column:
    """The text a failing session logs."""
    return F.concat(F.lit("S"), F.lpad(F.hex(site.cast("long")), 4, "0"), F.lit(" "), status_text(status))


def packed_version(major: int, minor: int, patch: int) -> int:
    return major << 16 | minor << 8 | patch


def sniff(blob: Column) -> Column:
    """1 or 2 for the container version that the first four bytes name, null for neither."""
    magic = number(blob, 0, 4)
    return F.when(magic == MAGIC_1, 1).when(magic == MAGIC_2, 2)
