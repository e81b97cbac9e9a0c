"""What the operators of this subpackage share: input tables, shared scratch space, broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and pad lines, as SQL text and as a Java regular expression.
BLANKS = "\t\n\x0b\f\r "
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What a kernel gets at a time, at most: an executor holds each batch several times, on both sides and while it grows.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that extra columns of any name cannot clash with an operator's own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def ascii_lower(col):
    """A-Z to a-z and nothing else (lower() also maps letters beyond ASCII)."""
    return F.translate(col, UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only a single-machine session may set its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store behind a path as executors see it; file: URIs may have one slash or three."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
            p = hadoop.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder belongs to whoever owns spark.checkpoint.dir
            return


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/palimpsest-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def lean(kernel: Callable) -> Callable:
    """kernel, after whose last batch Arrow returns the memory that it keeps: a worker that waits for its next task, or
    through stages without kernels, would hold it."""

    @functools.wraps(kernel)
    def run(batches):
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()

    return run


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile hands its kernels at most BATCH_ROWS rows or BATCH_BYTES (one row at least) at a time. A
    session that asks for less gets that."""
    now = spark._jsparkSession.sessionState().conf()  # read there, since sizes may be set with units
    limits = {"maxRecordsPerBatch": (now.arrowMaxRecordsPerBatch(), BATCH_ROWS), "maxBytesPerBatch": (now.arrowMaxBytesPerBatch(), BATCH_BYTES)}
    limits = {f"spark.sql.execution.arrow.{k}": v for k, v in limits.items()}
    before = {k: spark.conf.get(k) for k in limits}
    for k, (asked, most) in limits.items():
        spark.conf.set(k, str(min(asked, most) if asked > 0 else most))  # 0 and less: no limit
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, tag: str, into: list[str] | None = None, kernel: bool = False) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, lost executors cost no recomputation. into: a list
    that the path is added to, for discard(). kernel: df comes from an Arrow kernel, which gets small batches."""
    path = scratch(df.sparkSession, tag)
    with small_batches(df.sparkSession) if kernel else contextlib.nullcontext():
        df.write.parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing will read any more, and has the driver look for shuffle files that nothing refers to:
    left to itself it does so only when its own memory runs short, while the executors' disks fill."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while paths:
        p = hadoop.Path(paths.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
