"""Journals: the small records from which an interrupted session goes on.

A record is a fixed run of little-endian words that ends in its own checksum. Tables of records hold one row a key;
writing replaces rows, reads back what was written and only then takes the old table's place.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L

RECORD_MOST = 64
MAGIC = {1: 0x4D434A52, 2: 0x32504A52}  # fixed values
FIELDS = {
    1: ("magic", "session_id", "newpos", "prefix_crc32"),
    2: ("magic", "session_id", "out_off", "old_off", "d_off", "record_index", "record_base_d", "phase", "diff_remaining", "extra_remaining", "seek", "prefix_crc32"),
}
SIGNED = ("old_off", "diff_remaining", "extra_remaining", "seek")
SIZE = {version: 4 * len(fields) + 4 for version, fields in FIELDS.items()}
DEGRADED = 1  # fixed value: the session flag that a checkpoint could not be written


def _words(version: int) -> list[Column]:
    return [L.little(F.pmod(F.col(c).cast("long"), F.lit(1 << 32)), 4) for c in FIELDS[version]]


def checksum(version: int = 1) -> Column:
    """Checksum of a journal row over its fields, its own field as zero."""
    return F.crc32(F.concat(*_words(version), F.lit(bytes(4))))


def journal_rows(points: DataFrame, version: int = 1) -> DataFrame:
    """points (device_id, session_id, written, and the version's place fields) as a session leaves them: with magic, the
    checksum of the bytes written up to the place, and the row's own. A null `written` counts as nothing."""
    place = "newpos" if version == 1 else "out_off"
    prefix = F.crc32(F.coalesce(F.substring("written", F.lit(1), F.col(place).cast("int")), F.lit(b"")))
    rows = points.withColumn("magic", F.lit(MAGIC[version]).cast("long")).withColumn("prefix_crc32", prefix)
    rows = rows.select("device_id", *(F.col(c).cast("long").alias(c) for c in FIELDS[version]))
    return rows.withColumn("record_crc", checksum(version))


def record_bytes(version: int = 1) -> Column:
    """The record of a journal row."""
    return F.concat(*_words(version), L.little(F.col("record_crc"), 4))


def parsed(records: DataFrame, version: int = 1) -> DataFrame:
    """records (device_id, record) -> journal rows; fields beyond a short record are null."""
    words = {c: L.number(F.col("record"), 4 * i, 4) for i, c in enumerate((*FIELDS[version], "record_crc"))}
    return records.select("device_id", *((F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w) if c in SIGNED else w).alias(c) for c, w in words.items()))


def cleared(version: int = 1) -> bytes:
    """The record that says there is nothing to resume: zeros, in version 1 with their checksum."""
    size = SIZE[version]
    return bytes(size - 4) + (zlib.crc32(bytes(size)).to_bytes(4, "little") if version == 1 else bytes(4))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, record) of a table of records; none if nothing was ever written there."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "key long, record binary")
    return spark.read.schema("key long, record binary").parquet(path)


def write_records(records: DataFrame, path: str) -> DataFrame:
    """Puts records (key, record) into the table at path, one a key, and returns (key, status): 0, -1 for a record that
    is empty or longer than RECORD_MOST, -13 if what is read back differs. Keys must be unique. If any record comes
    back wrong the table stays as it was."""
    spark = records.sparkSession
    rows = records.select(F.col("key").cast("long").alias("key"), "record")
    sound = F.coalesce(F.octet_length("record").between(1, RECORD_MOST), F.lit(False)) & F.col("key").isNotNull()
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    kept = read_records(spark, path).join(rows.where(sound).select("key"), "key", "left_anti")
    kept.union(rows.where(sound)).write.parquet(staged)
    back = spark.read.schema("key long, record binary").parquet(staged).select(F.col("key").alias("_key"), F.col("record").alias("_back"))
    status = F.when(~sound, L.PARAM).when(F.col("_back").eqNullSafe(F.col("record")), L.OK).otherwise(L.FLASH)
    out = rows.join(back, F.col("key") == F.col("_key"), "left").select("key", status.alias("status")).collect()  # a row a session
    if not any(r.status == L.FLASH for r in out):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        new, old, gone = hadoop.Path(staged), hadoop.Path(path), hadoop.Path(f"{staged}-old")
        fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(old):
            fs.rename(old, gone)
        fs.rename(new, old)
        fs.delete(gone, True)
    return spark.createDataFrame([tuple(r) for r in out], "key long, status int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def clear(spark: SparkSession, keys: DataFrame, path: str, version: int = 1) -> DataFrame:
    """Clears the records of keys (key): (key, status)."""
    return write_records(keys.select("key").withColumn("record", F.lit(cleared(version))), path)


def surviving(checkpoints: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """checkpoints (pair_id, step, ...) and those (pair_id, step) that could not be written -> the checkpoints that
    remain, since a session gives up journaling at its first failure, and (pair_id, flags) of every session."""
    first = failures.groupBy("pair_id").agg(F.min("step").alias("_first"))
    joined = checkpoints.join(first, "pair_id", "left")
    flags = checkpoints.select("pair_id").distinct().join(first, "pair_id", "left").select("pair_id", F.when(F.col("_first").isNotNull(), DEGRADED).otherwise(0).alias("flags"))
    return joined.where("_first is null or step < _first").drop("_first"), flags


def probe_1(journal: DataFrame, sessions: DataFrame) -> DataFrame:
    """sessions (device_id, session_id, new_size, flash_block, written) with status 0 and rewind, the byte at which
    the erase block in question begins, or status -17: a cold start. journal: a row a device at most. Anything
    stale, torn, foreign or not matched by the written bytes is a cold start."""
    j = journal.select("device_id", *FIELDS[1], "record_crc").withColumn("fits", (F.col("magic") == MAGIC[1]) & (F.col("record_crc") == checksum(1))).withColumnRenamed("session_id", "j_session")
    joined = sessions.join(j, "device_id", "left")
    prefix = F.crc32(F.substring("written", F.lit(1), F.col("newpos").cast("int")))
    good = F.col("fits") & (F.col("j_session") == F.col("session_id")) & (F.col("newpos") > 0) & (F.col("newpos") < F.col("new_size")) & (prefix == F.col("prefix_crc32"))
    good = F.coalesce(good, F.lit(False))
    rewind = F.floor(F.col("newpos") / F.col("flash_block")) * F.col("flash_block")
    return joined.select("device_id", F.when(good, L.OK).otherwise(L.NOT_FOUND).alias("status"), F.when(good, rewind).cast("long").alias("rewind"))


def probe_2(journal: DataFrame, sessions: DataFrame) -> DataFrame:
    """As probe_1 for version 2: sessions also have record_count; the end of the image is a valid place, and the
    delta offset has no upper bound. A good row also has what run_sessions_2 needs to go on."""
    j = journal.select("device_id", *FIELDS[2], "record_crc").withColumn("fits", (F.col("magic") == MAGIC[2]) & (F.col("record_crc") == checksum(2))).withColumnRenamed("session_id", "j_session")
    joined = sessions.join(j, "device_id", "left")
    good = (
        F.col("fits")
        & (F.col("j_session") == F.col("session_id"))
        & F.col("out_off").between(1, F.col("new_size"))
        & (F.col("out_off") % F.col("flash_block") == 0)
        & (F.col("record_index") < F.col("record_count"))
        & (F.col("phase") <= 2)
        & (F.col("record_base_d") <= F.col("d_off"))
        & (F.crc32(F.substring("written", F.lit(1), F.col("out_off").cast("int"))) == F.col("prefix_crc32"))
    )
    good = F.coalesce(good, F.lit(False))
    kept = [F.when(good, F.col(c)).alias(c) for c in FIELDS[2] if c not in ("magic", "session_id", "out_off", "prefix_crc32")]
    return joined.select("device_id", F.when(good, L.OK).otherwise(L.NOT_FOUND).alias("status"), F.when(good, F.col("out_off")).alias("resume_at"), *kept)
