"""What the query modules share: images, pairs of them, headers and keys made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions import layout as L
from ..operators import container
from ..sources import images as S
from ..sources.staging import spread, stored

PRODUCT, OLD_VERSION, NEW_VERSION = 0x1234, 1, 2
KEY_ID, OTHER_KEY_ID = bytes(range(16)), bytes(range(16, 32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_provider() -> crypto.Provider:
    """Fixed keys for the queries; not secret."""
    seed = bytes(range(32))
    return crypto.Provider(signing=seed, public=crypto.public_key(seed), keys={KEY_ID: bytes(range(32, 64))})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.previous_pairs(table(spark, sf_dir, "documents"))
    numbers = {"product_id": PRODUCT, "old_version": OLD_VERSION, "fw_version": NEW_VERSION}
    return found.select("pair_id", "base_id", "old", "new", *(F.lit(v).cast("long").alias(k) for k, v in numbers.items()))


def held_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, dealt evenly and written once: queries read them as patches to make, devices, offers and images."""
    return stored(spread(pairs(spark, sf_dir), "pair_id"), "pairs")


def second(pairs: DataFrame, provider: crypto.Provider, key_id: bytes = KEY_ID, record_log2: int = 13) -> DataFrame:
    """Version 2 patches of pairs, with nonce prefixes from their ids."""
    prefix = F.unhex(F.substring(F.sha2(F.col("pair_id").cast("string"), 256), 1, 32))
    return container.make_patches_2(pairs.withColumn("nonce_prefix", prefix), provider, key_id, record_log2)


def _header_values() -> dict[str, Column]:
    col = F.col
    return {
        "magic": F.lit(L.MAGIC_1),
        "hdr_len": F.lit(L.HEADER_1),
        "hdr_ver": F.when(col("o_orderkey") % 29 == 0, F.lit(0x0900)).otherwise(F.lit(L.VERSION_1)),
        "flags": F.when(col("o_orderkey") % 23 == 0, F.lit(16)).otherwise(F.lit(L.LZ4_FLAG)),
        "product_id": (col("o_orderkey") % 5).cast("long"),
        "fw_version": (col("o_orderkey") % 11).cast("long"),
        "old_size": (col("o_custkey") % 13).cast("long"),
        "new_size": (col("o_orderkey") * 131 % 4294967296).cast("long"),
        "payload_size": (col("o_orderkey") % 17).cast("long"),
        "old_crc32": (col("o_orderkey") * 2654435761 % 4294967296).cast("long"),
        "new_crc32": (col("o_custkey") * 2246822519 % 4294967296).cast("long"),
        "payload_crc32": F.lit(0),
        "workspace_req": (col("o_custkey") % 3000).cast("long"),
        "old_version": (col("o_custkey") % 2 + 3).cast("long"),
        "codec_id": F.when(col("o_orderkey") % 19 == 0, F.lit(0x7F)).otherwise(F.lit(L.LZ4)),
        "block_log2": (col("o_custkey") % 5 + 7).cast("long"),
    }


def headers(spark, sf_dir) -> DataFrame:
    head = L.build_header(_header_values())
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(head, F.lit(bytes(12))).alias("blob"))


PAIRS_SQL = """WITH d AS (SELECT doc_id AS pair_id, encode(text) AS new FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    i AS (SELECT pair_id, coalesce(lag(pair_id) OVER (ORDER BY pair_id), max(pair_id) OVER ()) AS base_id FROM d),
    p AS (SELECT i.pair_id, i.base_id, b.new AS old, d.new AS new FROM i JOIN d ON d.pair_id = i.pair_id JOIN d AS b ON b.pair_id = i.base_id) """
HEADERS_SQL = """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 2304 ELSE 256 END AS hdr_ver,
    CASE WHEN o_orderkey % 23 = 0 THEN 16 ELSE 8 END AS flags, o_orderkey % 5 AS product_id, o_orderkey % 11 AS fw_version,
    o_custkey % 13 AS old_size, o_orderkey * 131 % 4294967296 AS new_size, o_orderkey % 17 AS payload_size,
    o_orderkey * 2654435761 % 4294967296 AS old_crc32, o_custkey * 2246822519 % 4294967296 AS new_crc32,
    o_custkey % 3000 AS workspace_req, o_custkey % 2 + 3 AS old_version,
    CASE WHEN o_orderkey % 19 = 0 THEN 127 ELSE 1 END AS codec_id, o_custkey % 5 + 7 AS block_log2 FROM orders) """
