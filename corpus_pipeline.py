"""The corpus pipeline: documents in, packed training sequences out, each stage on what the one before kept.

Language ID drops documents in no language and relabels the others; line dedup cuts repeated lines; the
Jaccard join keeps one document of each group of near duplicates; decontamination drops documents that hold
benchmark passages; packing lays out the rest.

Stages take rows with any further columns, whose names never matter, and return COLUMNS alone. Null and empty texts are
documents without letters, which the first stage drops; no stage fails on them. Rows with a null doc_id stay, except
where their own text is rejected: they link with nothing and are packed one by one. Repeated rows travel together, one
of them goes on after the Jaccard join. Ties go to the smaller doc_id. An empty table gives an empty table of the same
columns from every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, stored, table
from palimpsest.llm.decontaminate import spaced_seed_hits
from palimpsest.llm.jaccard_join import ngram_jaccard_join
from palimpsest.llm.language import UNKNOWN, identify_documents
from palimpsest.llm.line_dedup import keep_lines, line_bitmaps
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.queries import tokenizer_path

#: No SQL: language ID sums logarithms of a fitted model and packing needs a tokenizer.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids, null matching null."""
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs.doc_id.eqNullSafe(F.col("_id")), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, with lang set to it. Those without any letters (null and empty texts too), or that the
    model of no language explains best, go; so do rows of a doc_id, or of the null doc_id, that has such a text. A doc_id
    with texts in several languages gets the first by name."""
    found = identify_documents(docs)
    of = found.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.when(F.col("lang") != UNKNOWN, F.col("lang"))).alias("_lang"), F.max((F.col("lang") == UNKNOWN).cast("int")).alias("_lost"))
    docs = docs.select(*COLUMNS)
    joined = docs.join(of.where("_lost = 0"), docs.doc_id.eqNullSafe(F.col("_id")))
    return joined.select(*(F.col("_lang").alias("lang") if c == "lang" else docs[c] for c in COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that an earlier document holds cut out; n_chars follows. No document goes, though its text
    may become empty; a text that loses nothing, null too, stays as it is. The null doc_id comes after all others."""
    kept = keep_lines(docs.select(*COLUMNS), line_bitmaps(docs))
    changed = F.col("n_dropped") > 0
    return kept.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.char_length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id, and of repeated rows one. Texts without words
    and rows with a null doc_id are near nothing and stay."""
    first = ngram_jaccard_join(docs).where("component_id is null or component_id = doc_id")
    return _kept(docs.select(*COLUMNS), first).dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. All rows of a doc_id, or of the null doc_id, go with one that has;
    an empty benchmark leaves everything."""
    leaks = spaced_seed_hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(leaks, docs.doc_id.eqNullSafe(F.col("_id")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences; a null or empty text is one token."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        made: list[str] = []
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), made)
        discard(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
