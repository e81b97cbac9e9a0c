"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Only minima per node are aggregated and joined back, so a node with very many neighbours is combined
on the map side and split by the adaptive skew join. Every round is cut with checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_root


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v), u the centre. Large: centre's larger neighbours go to its least; small: the smaller ones."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    ends = F.explode(F.array("u", "v"))
    return joined.select(ends.alias("a"), F.col("m").alias("b")).where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): every node of an edge with the least node it reaches.

    Null ends and loops are ignored; repeated and reversed edges count once; no edges give no rows.
    """
    shared_root(edges.sparkSession)
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        before = state
        both = now.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        far = _star(both, True).distinct()
        near = far.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = _star(near, False).distinct().checkpoint()
