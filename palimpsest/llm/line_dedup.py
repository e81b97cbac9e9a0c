"""Line deduplication across documents, DataFrame functions only.

Only hashes travel: lines become (128-bit key hash, document, position), are range-partitioned by hash and
sorted by document and position inside each partition, and a window streams over them with the first
document of the running hash in hand. A hash is dealt over SALTS sub-ranges by document first, so that a
line which a third of all documents hold is no single task's work; the first documents of the sub-ranges,
at most SALTS a hash, meet in a second, equal step. What comes back is a run-length bitmap of the kept
lines for each document that loses any; texts are read again and cut where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, stored, texts

SALTS = 1024


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _streamed(rows: DataFrame, keys: list[str], ranges: list[str]) -> DataFrame:
    """rows with `keeps`: whether the row's document is the first of its key. One range exchange, one sort."""
    first = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.repartitionByRange(*ranges).withColumn("keeps", F.first("doc_id").over(first).eqNullSafe(F.col("doc_id")))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = SALTS) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep) of the documents that lose lines; keep is the bitmap of kept lines
    as runs (start, count), line numbers from 0.

    A line's key is the line without ASCII blanks at both ends, A-Z lower-cased. A key of at least min_chars
    code points that several documents hold loses its lines in all but the one with the least doc_id, where
    all of them stay. A null text is one empty line. Rows with equal doc_id are one document; a null doc_id
    is one document that comes after all others. An empty table gives no rows.
    """
    docs = texts(docs, id_col, text_col)
    lines = docs.select("doc_id", _text_key(docs.text).alias("text_key"), F.size(_lines(docs.text)).alias("n_lines"), F.posexplode(_lines(docs.text)).alias("pos", "line"))
    key = F.btrim(ascii_lower(F.col("line")), F.lit(BLANKS))
    lines = lines.withColumn("line", key).where(F.char_length("line") >= min_chars)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    hashed = lines.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), salt.alias("salt"), "doc_id", "text_key", "n_lines", "pos")
    near = stored(_streamed(stored(hashed, "lines"), ["h", "g", "salt"], ["h", "salt"]), "firsts")
    far = _streamed(near.where("keeps"), ["h", "g"], ["h"])
    dropped = near.where("not keeps").union(far.where("not keeps"))
    gone = dropped.groupBy("doc_id", "text_key", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    edges = F.concat(F.array(F.lit(-1)), "gone", F.array("n_lines"))
    gaps = gone.withColumn("edges", edges).withColumn("keep", F.expr("filter(transform(sequence(0, size(edges) - 2), i -> struct(edges[i] + 1 as start, edges[i + 1] - edges[i] - 1 as count)), r -> r.count > 0)"))
    return gaps.select("doc_id", "text_key", F.size("gone").alias("n_dropped"), "keep")


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (in place of columns so named): the lines that the bitmaps keep, joined by a line feed."""
    marks = bitmaps.select("doc_id", "text_key", F.col("n_dropped").cast("long").alias("n_dropped"), "keep")
    text = docs[text_col].cast("string")
    on = docs[id_col].cast("long").eqNullSafe(marks["doc_id"]) & (_text_key(text) == marks["text_key"])
    lines, keep = _lines(text), marks["keep"]
    cut = F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["count"]))), "\n")
    kept = F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(cut)
    added = [F.size(lines).cast("long").alias("n_lines"), F.coalesce(marks["n_dropped"], F.lit(0)).alias("n_dropped"), kept.alias("kept_text")]
    return docs.join(marks, on, "left").select(*[docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")], *added)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row; see line_bitmaps for the rule and odd cases."""
    docs = texts(docs, id_col, text_col)
    return keep_lines(docs, line_bitmaps(docs, min_chars=min_chars)).select("doc_id", "n_lines", "n_dropped", "kept_text")
