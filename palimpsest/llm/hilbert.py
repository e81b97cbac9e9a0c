"""Hilbert-curve sharding: quantise metadata, sort by curve index, cut the order into runs.

A value's cell is the share of all rows that lie before it, in 2 ** bits steps, so that few values spread over
the whole axis as many do: every dimension gets its part of the curve's leading bits and readers can skip shards
by any of them. Numbers are cut by approximate quantiles over all rows; texts by exact ones over whole values,
from their grouped counts, summed along a range-partitioned order. Rows are range-partitioned by (curve, text
checksum, size, id), so that rows of one cell may lie in several partitions. The sorted table is written once;
positions are the partitions' row numbers plus the counts of the partitions before.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

BITS = 8


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of cells, integers below 2 ** bits, one column a dimension
    (Skilling's transform: undo the excess work of the curve bit by bit, Gray-encode, interleave)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _is_text(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] == "string"


def _value(df: DataFrame, column: str) -> Column:
    """What a dimension is quantised by: texts as they are, anything else as a double."""
    return df[column] if _is_text(df, column) else df[column].cast("double")


def _text_bounds(values: DataFrame, column: str, steps: int) -> list[str]:
    """The values at the ranks k / steps of all rows, k from 1 to steps - 1: at most so many texts, whatever the input."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = stored(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "values")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("n"))  # a row a partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy("value")
    ranked = ordered.join(F.broadcast(base), "part").withColumn("end", F.col("base") + F.sum("n").over(within))
    first, last = ((F.floor(c * steps / F.col("total"))).cast("int") for c in (F.col("end") - F.col("n"), F.col("end")))
    found = ranked.where(first < last).select("value", F.explode(F.sequence(first + 1, last)).alias("k"))
    return [r.value for r in found.where(F.col("k") < steps).orderBy("k").collect()]


def with_curve(df: DataFrame, dimensions: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """df with its rows' index on the curve through the named dimensions. Nulls and NaNs share the first cell."""
    values = df.select(*(_value(df, c).alias(f"_{i}") for i, c in enumerate(dimensions)))
    texts = [_is_text(df, c) for c in dimensions]
    steps = 1 << bits
    parts = [k / steps for k in range(1, steps)]
    numbers = [F.percentile_approx(F.when(~F.isnan(c), F.col(c)), parts, 20_000).alias(c) for c, text in zip(values.columns, texts, strict=True) if not text]
    some = values.agg(*numbers).first().asDict() if numbers else {}
    # a bound that is repeated moves the values after it on: cells are ranks, not numbers of values
    bounds = [_text_bounds(values, c, steps) if text else np.array(some[c] or [], float) for c, text in zip(values.columns, texts, strict=True)]

    def cells(column: pd.Series, edges) -> np.ndarray:
        if isinstance(edges, list):
            codes, known = pd.factorize(column)
            of = np.array([bisect_left(edges, x) for x in known] + [0], np.int64)  # code -1, null, is the last
            return of[codes]
        v = column.to_numpy(float, na_value=np.nan)
        return np.where(np.isnan(v), 0, np.searchsorted(edges, v, "left"))

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([cells(c, e) for c, e in zip(columns, bounds, strict=True)], axis=1), bits))

    return df.withColumn(name, curve(*(_value(df, c) for c in dimensions)))


def positions(df: DataFrame, order: list[str], tag: str = "sorted") -> tuple[DataFrame, int]:
    """df with `position`, its place from 0 in the total order, and the number of rows. Ties may fall either way."""
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ordered = stored(ordered, tag)
    part = F.shiftright("_row", 33)
    counts = sorted(map(tuple, ordered.groupBy(part.alias("part")).count().collect()))  # a row a partition
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    base = F.broadcast(spark.createDataFrame(list(starts.items()) or [(0, 0)], "_part long, _base long"))
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(base, part == F.col("_part")).withColumn("position", F.col("_base") + within).drop("_row", "_part", "_base"), total


def cut(position: Column, total: int, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of a position when total rows are cut into runs whose lengths differ by one at most."""
    small, more = divmod(total, shards)
    head, each = more * (small + 1), max(small, 1)
    late = position >= head
    whole = lambda x, n: F.floor((x - x % n) / n)
    shard = F.when(~late, whole(position, small + 1)).otherwise(more + whole(position - head, each))
    slot = F.when(~late, position % (small + 1)).otherwise((position - head) % each)
    return shard.cast("int"), slot.cast("long")


def hilbert_shards(docs: DataFrame, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 8, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve), a row a row of docs.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 its unsigned CRC-32 (null: of no bytes). The
    order is (curve, crc, size, doc_id), nulls first; shards are runs of it under the law `rows`, so counts
    differ by one at most and the first shards have the extra rows. slot counts from 0 within a shard.
    Equal texts with equal metadata are neighbours in the order; a run may still end between them, since the law
    of equal counts leaves no group of a third of all rows whole, and copies with other metadata lie elsewhere.
    Nulls of a dimension share its first cell; equal values share a cell, so a dimension with one value
    has one cell. An empty table gives no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *(docs[c].alias(f"dim{i}") for i, c in enumerate(dimensions)))
    rows = with_curve(rows, [f"dim{i}" for i in range(len(dimensions))], bits)
    placed, total = positions(rows, ["curve", "text_crc32", "size", "doc_id"])
    shard, slot = cut(F.col("position"), total, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str | None = None, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 8, bits: int = BITS, id_col: str = "doc_id") -> str:
    """Writes docs, all columns, sorted along the curve under path/shard=K, so that readers can skip files by
    the dimensions' minima and maxima; returns the path."""
    path = path or scratch(docs.sparkSession, "shards")
    rows = docs.withColumn("_id", F.col(id_col).cast("long"))
    placed, total = positions(with_curve(rows, list(dimensions), bits, "_curve"), ["_curve", "_id"])
    shard, _ = cut(F.col("position"), total, shards)
    out = placed.withColumn("shard", shard)
    out.repartitionByRange("position").sortWithinPartitions("position").drop("_id", "_curve", "position").write.partitionBy("shard").parquet(path)
    return path
