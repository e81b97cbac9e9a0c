"""Sources and sinks of images and patches."""

from __future__ import annotations

import posixpath
import re
import uuid
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import layout as L


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, blob, size) of files, whole. Scans skip empty files, so those that only the listing has come with an
    empty blob; the listing is the one that Spark's driver holds anyway."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(b"").alias("blob"), F.lit(0).cast("long").alias("size"))
    return files.select("path", F.col("content").alias("blob"), F.col("length").alias("size")).union(empty)


def sniffed(files: DataFrame) -> DataFrame:
    """files with version: 1 or 2 by the first four bytes, null for anything else."""
    return files.withColumn("version", L.sniff(F.col("blob")))


def text_images(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(image_id, bytes): texts as images, null as none."""
    return rows.select(rows[id_col].cast("long").alias("image_id"), rows[text_col].cast("string").cast("binary").alias("bytes"))


def inventory(images: DataFrame) -> DataFrame:
    """(image_id, size, crc32, md5, sha256)."""
    data = F.col("bytes")
    return images.select("image_id", F.octet_length(data).cast("long").alias("size"), F.crc32(data).alias("crc32"), F.md5(data).alias("md5"), F.sha2(data, 256).alias("sha256"))


def base_pairs(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", shared: int = 64, least: int = 200) -> DataFrame:
    """(pair_id, base_id, old, new): texts of `least` characters or more that begin with the same `shared` ones, each
    against the one with the least id in its group; copies of the base and null texts have no pair.

    The pairing is this library's choice of test data: near copies begin alike. Bases are found by an
    aggregation over keys and ids alone, and joined back by id, so texts of a group never meet in one task.
    """
    docs = rows.select(rows[id_col].cast("long").alias("pair_id"), rows[text_col].cast("string").alias("text")).where(F.char_length("text") >= least)
    keyed = docs.withColumn("key", F.xxhash64(F.substring("text", 1, shared)))
    first = keyed.groupBy("key").agg(F.min("pair_id").alias("base_id"), F.count("*").alias("n")).where("n > 1").select("key", "base_id")
    bases = docs.join(first.select(F.col("base_id").alias("pair_id")).distinct(), "pair_id").select(F.col("pair_id").alias("base_id"), F.col("text").alias("old_text"))
    met = keyed.join(first, "key").where("pair_id <> base_id").join(bases, "base_id")
    same = F.substring("old_text", 1, shared) == F.substring("text", 1, shared)
    met = met.where(same & (F.col("old_text") != F.col("text")))
    return met.select("pair_id", "base_id", F.col("old_text").cast("binary").alias("old"), F.col("text").cast("binary").alias("new"))


def previous_pairs(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int = 1024) -> DataFrame:
    """(pair_id, base_id, old, new): every text against the one with the next smaller id, the first against the last.
    Ids must be unique; rows with a null id or text are no images.

    Ids alone are ordered, range by range of equal width; only the last id of each range meets in one task.
    """
    docs = rows.select(rows[id_col].cast("long").alias("pair_id"), rows[text_col].cast("string").cast("binary").alias("new")).where("pair_id is not null and new is not null")
    span = docs.agg(F.min("pair_id").cast("double").alias("low"), F.max("pair_id").cast("double").alias("high"))
    share = (F.col("pair_id").cast("double") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    ids = docs.select("pair_id").join(F.broadcast(span)).select("pair_id", F.floor(share * ranges).alias("range"))
    ends = ids.groupBy("range").agg(F.max("pair_id").alias("end"))
    before = ends.select("range", F.coalesce(F.lag("end").over(Window.orderBy("range")), F.max("end").over(Window.partitionBy())).alias("before"))
    within = ids.select("range", "pair_id", F.lag("pair_id").over(Window.partitionBy("range").orderBy("pair_id")).alias("base_id"))
    found = within.join(F.broadcast(before), "range").select("pair_id", F.coalesce("base_id", "before").alias("base_id"))
    return docs.join(found, "pair_id").join(docs.select(F.col("pair_id").alias("base_id"), F.col("new").alias("old")), "base_id").select("pair_id", "base_id", "old", "new")


def match_base(patches: DataFrame, images: DataFrame) -> DataFrame:
    """(pair_id, image_id) of patches and the base images they were built against, by size and checksum."""
    heads = L.held(patches.select("pair_id", "blob"), "h", L.header(F.col("blob"), 1)).selectExpr("pair_id", "h.old_size size", "h.old_crc32 crc32")
    return heads.join(inventory(images).select("image_id", "size", "crc32"), ["size", "crc32"]).select("pair_id", "image_id")


def write_files(rows: DataFrame, folder: str, name_col: str, blob_col: str) -> DataFrame:
    """Writes a file a row, under a name no attempt shares and then moved, and returns (name, path, size). Names
    must be unique; folder must be a place that all executors see."""

    def run(batches):
        fs, root = (pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") or "://" not in folder else pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for name, blob in zip(batch.column("name").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                staged, final = posixpath.join(root, f".{uuid.uuid4().hex}"), posixpath.join(root, name)
                with fs.open_output_stream(staged, compression=None) as out:
                    out.write(blob or b"")
                fs.move(staged, final)
                done.append({"name": name, "path": final, "size": len(blob or b"")})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64())]))

    return rows.select(F.col(name_col).cast("string").alias("name"), F.col(blob_col).alias("blob")).mapInArrow(run, "name string, path string, size long")


def publish(images: DataFrame, table: str, id_col: str, bytes_col: str, crc_col: str) -> DataFrame:
    """Writes images beside the path `table`, reads them back, and returns (id_col, verified): whether what lies there
    has the expected checksum. Only where every row does it takes the place of what was there before, so that a lost
    job or a bad write leaves the old images. The counterpart of programming flash and reading it back."""
    spark, staged = images.sparkSession, f"{table.rstrip('/')}.staged-{uuid.uuid4().hex}"
    images.select(id_col, bytes_col, crc_col).write.parquet(staged)
    checks = spark.read.parquet(staged).select(id_col, F.coalesce(F.crc32(bytes_col) == F.col(crc_col), F.lit(False)).alias("verified"))
    if not checks.where("not verified").limit(1).count():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        old, new, gone = hadoop.Path(table), hadoop.Path(staged), hadoop.Path(f"{staged}-old")
        fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(old):
            fs.rename(old, gone)
        fs.rename(new, old)
        fs.delete(gone, True)
        staged = table
    return spark.read.parquet(staged).select(id_col, F.coalesce(F.crc32(bytes_col) == F.col(crc_col), F.lit(False)).alias("verified"))


def latest(journal: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of an append-only journal for each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return journal.withColumn("_r", rank).where("_r = 1").drop("_r")
