"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a single-machine session may set its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: what several branches use is made once, and a lost executor
    costs no recomputation. The folder belongs to whoever owns spark.checkpoint.dir."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/palimpsest-{spark.sparkContext.applicationId}/core-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over as many partitions as shuffles have, for kernels whose time is not in proportion to
    bytes: adaptive coalescing, which goes by bytes, leaves them alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
