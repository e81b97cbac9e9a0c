"""Queries over the driver's tables, each with equivalent SQL where SQL can say it.

Texts of documents stand in for images; pairs of images are each document and the one before it (sources.previous_pairs).
Rows of orders and customer stand in for headers and devices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions import layout as L
from ..functions import sizing as Z
from ..operators import container, delta, sessions
from ..operators.validate import first_failure, header_1
from ..sources import images as S
from ..sources.staging import stored
from . import outcomes
from .pairs import HEADERS_SQL, PAIRS_SQL, headers, held_pairs, pairs, second, table, test_provider


def image_inventory(spark, sf_dir):
    return S.inventory(S.text_images(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("crc32")


def image_crc32(spark, sf_dir):
    return S.inventory(S.text_images(table(spark, sf_dir, "documents"), "doc_id", "text")).select("image_id", "crc32")


def base_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_id", "base_id", F.md5("old").alias("old_md5"), F.md5("new").alias("new_md5"))


def gram_index(spark, sf_dir):
    bases = S.text_images(table(spark, sf_dir, "documents"), "doc_id", "text").where("image_id is not null")
    return delta.gram_index(bases.select(F.col("image_id").alias("base_id"), "bytes"), "base_id", "bytes")


def delta_kernel(spark, sf_dir):
    """Encode, parse and apply; delta_size must be new_size + 24 bytes a triple."""
    pairs = held_pairs(spark, sf_dir)
    deltas = stored(delta.encode_pairs(pairs), "deltas")
    counts = delta.parse_triples(deltas).groupBy("pair_id").agg(F.count("n").alias("triples"), F.max("site").alias("site"))
    rebuilt = delta.apply_kernel(deltas.join(pairs.select("pair_id", "old"), "pair_id"))
    out = deltas.select("pair_id", "new_size", F.octet_length("delta").alias("delta_size")).join(counts, "pair_id").join(rebuilt.select("pair_id", F.md5("image").alias("image_md5")), "pair_id")
    exact = F.col("delta_size") == F.col("new_size") + 24 * F.col("triples")
    return out.select("pair_id", "new_size", "image_md5", (exact & (F.col("site") == 0)).alias("exact"))


def delta_relational(spark, sf_dir):
    """The same images by joins of triples and base blocks."""
    pairs = held_pairs(spark, sf_dir)
    triples = stored(delta.cursors(delta.parse_triples(delta.encode_pairs(pairs))), "triples")
    image = delta.apply_relational(triples, delta.blocks(pairs, "pair_id", "old"))
    return image.select("pair_id", F.octet_length("image").cast("long").alias("new_size"), F.md5("image").alias("image_md5"))


def triple_cursors(spark, sf_dir):
    order = F.col("o_orderkey")
    triples = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair_id"), order.alias("n"), (order % 101).alias("x"), (order % 7).alias("y"), (order % 1000 - 500).alias("z"))
    return delta.cursors(triples)


def _outcomes(pairs: DataFrame, patches: DataFrame, provider: crypto.Provider | None = None, second: bool = False) -> DataFrame:
    """One device a pair, with the pair's base as its image."""
    devices = pairs.select(F.col("pair_id").alias("device_id"), "product_id", F.col("old_version").alias("running_version"), F.col("pair_id").alias("image_id"))
    offers = pairs.select(F.col("pair_id").alias("device_id"), "pair_id")
    old = pairs.select(F.col("pair_id").alias("image_id"), "old")
    run = sessions.run_sessions_2 if second else sessions.run_sessions
    done = run(offers, devices, patches, old, provider) if provider else run(offers, devices, patches, old)
    return done.select("pair_id", "status", "site", F.md5("image").alias("image_md5"), "erase_ops")


def _round_trip(codec: int):
    def query(spark, sf_dir):
        pairs = held_pairs(spark, sf_dir)
        return _outcomes(pairs, container.make_patches(pairs, codec))

    return query


def session_signed(spark, sf_dir):
    provider, pairs = test_provider(), held_pairs(spark, sf_dir)
    return _outcomes(pairs, container.make_patches(pairs, provider=provider), provider)


def session_encrypted(spark, sf_dir):
    provider, pairs = test_provider(), held_pairs(spark, sf_dir)
    return _outcomes(pairs, second(pairs, provider), provider, second=True)


def signatures(spark, sf_dir):
    """Signed, signed with one byte of the stream changed, unsigned: valid or not."""
    provider, pairs = test_provider(), held_pairs(spark, sf_dir)
    good = stored(container.make_patches(pairs, provider=provider), "signed")
    size = F.octet_length("blob")
    flipped = F.concat(F.substring("blob", F.lit(1), size - 1), F.unhex(F.lpad(F.hex((delta.byte_at(F.col("blob"), size - 1) + 1) % 256), 2, "0")))
    plain = container.make_patches(pairs)
    kinds = {"good": good, "changed": good.withColumn("blob", flipped), "unsigned": plain}
    out = [container.verify_signatures(p, provider).withColumn("kind", F.lit(k)) for k, p in kinds.items()]
    return out[0].union(out[1]).union(out[2])


def inspect(spark, sf_dir):
    seen = container.inspect(container.make_patches(held_pairs(spark, sf_dir), L.RAW))
    return seen.select("pair_id", "version", "codec", "flags", "product_id", "old_version", "fw_version", "old_size", "new_size", "block_log2", "payload_ok")


def record_walk(spark, sf_dir):
    """Records of encrypted patches: every pair has a closing record of four bytes."""
    rows = container.record_rows(second(held_pairs(spark, sf_dir), test_provider()))
    last = rows.groupBy("pair_id").agg(F.max_by(F.octet_length("ct"), "index").cast("long").alias("last_ct"), (F.max("index") + 1 == F.count("*")).alias("gapless"), F.min(F.octet_length("tag")).cast("long").alias("tag_bytes"))
    return last


def header_fields(spark, sf_dir):
    head = L.held(headers(spark, sf_dir), "h", L.header(F.col("blob")))
    names = ["magic", "hdr_ver", "flags", "product_id", "fw_version", "old_size", "new_size", "old_crc32", "new_crc32", "workspace_req", "old_version", "codec_id", "block_log2"]
    return head.select("o_orderkey", *(F.col(f"h.{n}").alias(n) for n in names))


def header_validate(spark, sf_dir):
    device = {"product_id": F.lit(3), "running_version": F.lit(4), "ram_budget": F.lit(4096)}
    rows = L.held(headers(spark, sf_dir), "h", L.header(F.col("blob")))
    out = L.held(rows, "v", first_failure(header_1(F.col("blob"), F.col("h"), device)))
    return out.select("o_orderkey", F.col("v.status").alias("status"), F.col("v.site").alias("site"), L.status_text(F.col("v.status")).alias("text"))


def sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size, log2 = F.octet_length("text").cast("long"), (F.col("doc_id") % 13 + 8).cast("long")
    lc, lp = F.col("doc_id") % 9, F.col("doc_id") % 5
    return docs.select("doc_id", Z.image_framing(log2, size).cast("long").alias("framing"), Z.window(F.lit(4096), log2).alias("window"), Z.v2_ctx_size(F.least(log2, F.lit(13)), F.lit(192)).alias("v2_ctx"), Z.lzma_workspace(lc, lp, size * 1000).alias("lzma"))


def step_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sessions.steps(docs.select(F.col("doc_id").alias("pair_id"), F.octet_length("text").cast("long").alias("new_size"), F.lit(1024).alias("block")))


def stop_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sessions.checkpoints_2(docs.select(F.col("doc_id").alias("pair_id"), F.octet_length("text").cast("long").alias("new_size"), F.lit(512).alias("flash_block")), 3)


def checkpoint_table(spark, sf_dir):
    """Version 1 checkpoints of runs whose triples are 64, 128, ... bytes long."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.octet_length("text").cast("long").alias("new_size"))
    triples = docs.where("new_size > 0").select("pair_id", "new_size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("new_size") - 1) / 96))).alias("n"))
    triples = triples.select("pair_id", "n", F.least(F.lit(96), F.col("new_size") - F.col("n") * 96).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"))
    stepped = sessions.steps(docs.withColumn("block", F.lit(64)))
    return sessions.checkpoints_1(stepped, delta.cursors(triples), 2)


def device_candidates(spark, sf_dir):
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), (F.col("c_custkey") % 5).alias("product_id"), (F.col("c_custkey") % 2 + 3).alias("running_version"))
    patches = headers(spark, sf_dir).withColumnRenamed("o_orderkey", "pair_id")
    return sessions.candidates(devices, patches)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "image_inventory": image_inventory,
    "image_crc32": image_crc32,
    "base_pairs": base_pairs,
    "gram_index": gram_index,
    "delta_kernel": delta_kernel,
    "delta_relational": delta_relational,
    "triple_cursors": triple_cursors,
    "session_raw": _round_trip(L.RAW),
    "session_lz4": _round_trip(L.LZ4),
    "session_lzma": _round_trip(L.LZMA),
    "session_signed": session_signed,
    "session_encrypted": session_encrypted,
    "signatures": signatures,
    "inspect": inspect,
    "record_walk": record_walk,
    "header_fields": header_fields,
    "header_validate": header_validate,
    "sizes": sizes,
    "step_table": step_table,
    "stop_table": stop_table,
    "checkpoint_table": checkpoint_table,
    "device_candidates": device_candidates,
} | outcomes.QUERIES

_ROUND_TRIP = PAIRS_SQL + "SELECT pair_id, 0 AS status, 0 AS site, md5(new) AS image_md5, CAST(ceil(octet_length(new) / 1024.0) AS BIGINT) AS erase_ops FROM p"
ORACLE_SQL: dict[str, str] = {
    "image_inventory": "SELECT doc_id AS image_id, octet_length(encode(text)) AS size, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "image_crc32": """WITH RECURSIVE r AS (SELECT range AS i, range AS v, 0 AS k FROM range(256)
            UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM r WHERE k < 8),
        tab AS (SELECT list(v ORDER BY i) AS t FROM r WHERE k = 8),
        b AS (SELECT doc_id, hex(encode(text)) AS h, t FROM documents, tab)
        SELECT doc_id AS image_id, xor(list_reduce(list_transform(range(length(h) // 2), lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc32 FROM b""",
    "base_pairs": PAIRS_SQL + "SELECT pair_id, base_id, md5(old) AS old_md5, md5(new) AS new_md5 FROM p",
    "gram_index": """WITH b AS (SELECT doc_id AS base_id, hex(encode(text)) AS h FROM documents WHERE doc_id IS NOT NULL),
        places AS (SELECT base_id, h, unnest(range(length(h) // 2 - 7)) AS pos FROM b)
        SELECT base_id, h[2 * pos + 1 : 2 * pos + 16] AS gram, min(pos)::BIGINT AS first_pos FROM places GROUP BY ALL""",
    "delta_kernel": PAIRS_SQL + "SELECT pair_id, octet_length(new) AS new_size, md5(new) AS image_md5, true AS exact FROM p",
    "delta_relational": PAIRS_SQL + "SELECT pair_id, octet_length(new) AS new_size, md5(new) AS image_md5 FROM p",
    "triple_cursors": """WITH t AS (SELECT o_custkey AS pair_id, o_orderkey AS n, o_orderkey % 101 AS x, o_orderkey % 7 AS y, o_orderkey % 1000 - 500 AS z FROM orders)
        SELECT *, coalesce(sum(x + y) OVER w, 0)::BIGINT AS newpos, coalesce(sum(x + z) OVER w, 0)::BIGINT AS oldpos FROM t
        WINDOW w AS (PARTITION BY pair_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "session_raw": _ROUND_TRIP,
    "session_lz4": _ROUND_TRIP,
    "session_lzma": _ROUND_TRIP,
    "session_signed": _ROUND_TRIP,
    "session_encrypted": _ROUND_TRIP,
    "signatures": PAIRS_SQL + "SELECT pair_id, k.kind <> 'unsigned' AS signed, k.kind = 'good' AS valid, k.kind FROM p, (VALUES ('good'), ('changed'), ('unsigned')) AS k(kind)",
    "inspect": PAIRS_SQL + """SELECT pair_id, 1 AS version, 'raw' AS codec, 2::BIGINT AS flags, 4660::BIGINT AS product_id, 1::BIGINT AS old_version, 2::BIGINT AS fw_version,
        octet_length(old) AS old_size, octet_length(new) AS new_size, least(10, greatest(8, floor(log2(octet_length(new)))))::BIGINT AS block_log2, true AS payload_ok FROM p""",
    "record_walk": PAIRS_SQL + "SELECT pair_id, 4::BIGINT AS last_ct, true AS gapless, 16::BIGINT AS tag_bytes FROM p",
    "header_fields": HEADERS_SQL + "SELECT o_orderkey, 827344461 AS magic, hdr_ver, flags, product_id, fw_version, old_size, new_size, old_crc32, new_crc32, workspace_req, old_version, codec_id, block_log2 FROM h",
    "header_validate": HEADERS_SQL + """, v AS (SELECT o_orderkey, CASE
            WHEN hdr_ver <> 256 THEN [-5, 3] WHEN product_id <> 3 THEN [-7, 5] WHEN fw_version <= 4 THEN [-12, 6] WHEN old_version <> 4 THEN [-8, 7]
            WHEN flags = 16 OR (flags = 8 AND codec_id <> 1) THEN [-4, 9] WHEN codec_id = 127 THEN [-5, 9]
            WHEN old_size = 0 OR new_size = 0 OR payload_size = 0 THEN [-4, 8] WHEN payload_size > 12 THEN [-10, 12]
            WHEN block_log2 < 8 THEN [-4, 8] WHEN workspace_req > 4096 OR pow(2, block_log2) > (4096 - workspace_req) // 2 THEN [-6, 14]
            WHEN payload_size <= 4 THEN [-4, 8] ELSE [0, 0] END AS r FROM h)
        SELECT o_orderkey, r[1] AS status, r[2] AS site, CASE r[1] WHEN 0 THEN 'ok' WHEN -4 THEN 'malformed patch' WHEN -5 THEN 'unsupported feature'
            WHEN -6 THEN 'patch needs more memory than budgeted' WHEN -7 THEN 'patch is for a different product' WHEN -8 THEN 'base image does not match'
            WHEN -10 THEN 'patch is truncated' WHEN -12 THEN 'refusing downgrade' END AS text FROM v""",
    "sizes": """WITH s AS (SELECT doc_id, octet_length(encode(text)) AS n, doc_id % 13 + 8 AS e, doc_id % 9 AS lc, doc_id % 5 AS lp FROM documents),
        w AS (SELECT *, greatest(n * 1000, 4096) AS dict FROM s)
        SELECT doc_id, CASE WHEN n <= 0 OR e <= 8 THEN e ELSE least(e, greatest(8, floor(log2(n))::BIGINT)) END AS framing, least(4096, pow(2, e)::BIGINT) AS window,
            (124 + (2 * pow(2, least(e, 13)) + 4) + 208 + (2 * pow(2, least(e, 13)) + 16))::BIGINT AS v2_ctx,
            (ceil((256 + 2 * (1984 + 768 * pow(2, lc + lp))) / 8) * 8 + CASE WHEN dict >= 1073741824 THEN ceil(dict / 4194304) * 4194304
                WHEN dict >= 4194304 THEN ceil(dict / 1048576) * 1048576 ELSE ceil(dict / 4096) * 4096 END)::BIGINT AS lzma FROM w""",
    "step_table": """WITH s AS (SELECT doc_id AS pair_id, octet_length(encode(text)) AS n FROM documents),
        k AS (SELECT *, unnest(range(1, (ceil(n / 1024.0) + 1)::BIGINT)) AS step FROM s WHERE n > 0)
        SELECT pair_id, step, least(step * 1024, n) AS ends_at FROM k""",
    "stop_table": """WITH s AS (SELECT doc_id AS pair_id, octet_length(encode(text)) AS n FROM documents)
        SELECT pair_id, unnest(range(1536, n + 1, 1536)) AS out_off FROM s WHERE n >= 1536""",
    "checkpoint_table": """WITH s AS (SELECT doc_id AS pair_id, octet_length(encode(text)) AS n FROM documents),
        k AS (SELECT pair_id, n, unnest(range(1, n // 192 + 1)) AS j FROM s)
        SELECT pair_id, j * 3 AS step, j * 192 AS newpos FROM k WHERE j * 192 < n""",
    "device_candidates": HEADERS_SQL + """SELECT c_custkey AS device_id, o_orderkey AS pair_id FROM customer
        JOIN h ON h.product_id = c_custkey % 5 AND h.old_version = c_custkey % 2 + 3 AND h.fw_version > c_custkey % 2 + 3""",
} | outcomes.oracle_sql()
