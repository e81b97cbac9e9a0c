"""What applying a patch needs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import LZ4_STATE, RAW_STATE
from .layout import HEADER_2, LZ4, LZMA, RAW

SYNTHETIC_HEADER = 124
DEFAULT_BLOCK = 1024


def power(log2: Column) -> Column:
    return F.pow(F.lit(2), log2).cast("long")


def power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def window(block_size: Column, block_log2: Column) -> Column:
    """The decode window: the configured block, capped at the declared framing."""
    return F.least(block_size, power(block_log2))


def dictionary_buffer(size: Column) -> Column:
    unit = F.when(size >= 1 << 30, 1 << 22).when(size >= 1 << 22, 1 << 20).otherwise(1 << 12)
    return F.ceil(size / unit) * unit


def lzma_workspace(lc: Column, lp: Column, dict_size: Column) -> Column:
    """Decoder state, probabilities and dictionary; 0 if that is beyond 32 bits."""
    state = F.ceil((256 + 2 * (1984 + 768 * power(lc + lp))) / 8) * 8
    total = (state + dictionary_buffer(F.greatest(dict_size, F.lit(4096)))).cast("long")
    return F.when(total < 1 << 32, total).otherwise(F.lit(0))


def codec_workspace(codec_id: Column, props: Column) -> Column:
    """Of a built-in codec; 0 if its properties are unusable, null for an unknown one. props: layout.lzma_props."""
    usable = props["lc"].isNotNull() & (props["content_size"] > 0)
    lzma = F.when(usable, lzma_workspace(props["lc"], props["lp"], props["dict_size"])).otherwise(F.lit(0))
    return F.when(codec_id == LZ4, F.lit(LZ4_STATE)).when(codec_id == RAW, F.lit(RAW_STATE)).when(codec_id == LZMA, lzma).cast("long")


def ctx_size(status: Column, block_size: Column, block_log2: Column, codec_need: Column) -> Column:
    """Bytes that a version 1 session takes: two windows and the codec; 0 if it cannot be sized. status is the
    header's with the budget lifted."""
    block = F.when(block_size == 0, F.lit(DEFAULT_BLOCK)).otherwise(block_size)
    fine = (status == 0) & power_of_two(block) & (codec_need > 0)
    return F.when(fine, 2 * window(block, block_log2) + codec_need).otherwise(F.lit(0)).cast("long")


def v2_ctx_size(record_log2: Column, hdr_len: Column, lz4_state: int = LZ4_STATE) -> Column:
    """Bytes that a version 2 session takes: synthetic header, two records and marker, associated data, and the
    inner session. lz4_state is 16 on 32-bit targets and 24 on 64-bit ones."""
    two = 2 * power(record_log2)
    return (SYNTHETIC_HEADER + (two + 4) + (16 + hdr_len) + (two + lz4_state)).cast("long")


def v2_header_length(tlv_len: Column) -> Column:
    return HEADER_2 + tlv_len


def image_framing(block_log2: Column, new_size: Column) -> Column:
    """log2 of the frame size: the largest power of two that is no larger than the image and the block, 8 at
    least and block_log2 for an empty image. Sizes are below 2 ** 32."""
    fits = F.array_max(F.filter(F.sequence(F.lit(8), F.greatest(block_log2, F.lit(8)).cast("int")), lambda e: (e == 8) | (power(e) <= new_size)))
    return F.when((new_size <= 0) | (block_log2 <= 8), block_log2).otherwise(fits).cast("int")


def patch_ratio(patch_size: Column, new_size: Column) -> Column:
    """Patch size in percent of the image."""
    return F.when(new_size > 0, F.round(100 * patch_size / new_size, 2))
