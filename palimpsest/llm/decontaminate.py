"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only.

A mask selects some of the tokens in a short span and ignores the others, so a hit survives changed words
at the ignored places. Document spans and benchmark spans are hashed under each mask and joined; around
each hit the two texts are laid side by side and the best-scoring stretch of the diagonal decides.

The exploded document spans never leave their task: the benchmark side is cut into blocks of a checked
size, each broadcast. Only hits are shuffled, once a diagonal, with the few document tokens that an item
covers there; of the documents, those with a hit are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

#: 1: the token counts, 0: it is ignored. Complete for scores of 10: a stretch of equal (1) and differing (-1) tokens that sums to 10
#: has a hit of one of them, however long it is. A test proves it over all states of the last seven tokens.
MASKS = ("10110001", "11101", "1110001", "101101")
#: Benchmark spans and tokens broadcast at a time; a larger benchmark takes several passes.
BLOCK = 1_000_000
#: Shorter items say too little to be told from common phrases: they match nothing.
LEAST_TOKENS = 5


#: Scripts without blanks between words, for regular expressions, and the range of characters that they lie in.
UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}"
_FAR = "[\u0e00-\u1fff\u2e80-\ud7ff\uf900-\ufaff\\x{10000}-\\x{10ffff}]"


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased; characters of unspaced scripts stand alone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(low.rlike(_FAR), F.regexp_replace(low, f"([{UNSPACED}])", " $1 ")).otherwise(low)
    words = F.array_remove(F.split(apart, "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(mask: str, k: int) -> Column:
    """A seed for each place of the token array w, null where mask number k reaches beyond its end: the selected tokens'
    hashes, shifted by their order and put together by exclusive or. Other tokens with an equal seed cost a comparison."""
    at = [j for j, c in enumerate(mask) if c == "1"]
    with_next = lambda bits: lambda x, y: x.bitwiseXOR(F.shiftleft(y, bits))
    out = F.transform("w", lambda x: x.bitwiseXOR(F.lit(k)))
    for n, j in enumerate(at[1:], 1):
        out = F.zip_with(out, F.slice("w", j + 1, F.size("w")), with_next(13 * n % 61))
    return out


def _spans(masks: tuple[str, ...]) -> Column:
    """All seeds of w, size(w) a mask, so that position modulo size(w) is the place. Masks begin and end with 1."""
    return F.concat(*(_seeds(m, k) for k, m in enumerate(masks)))


def spaced_seed_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_score: int = 10) -> DataFrame:
    """(doc_id, item_id, score, doc_pos): the documents that hold a passage of a benchmark item.

    Tokens are runs of letters and digits, lower-cased, and single characters of scripts that write words without
    blanks (Han, Kana, Thai, Lao, Khmer, Myanmar). Under a hit, equal tokens of the diagonal count 1 and
    differing ones -1; score is the best stretch's sum and doc_pos the token at which the diagonal meets the
    item's first token (negative if the document begins inside the item). A pair is returned if its score
    reaches min_score, so ten equal tokens, or more with ten fewer changes than equal ones, are a leak; none is
    missed at a min_score of 10 or more, below that only those with a hit are found. An item of fewer than min_score
    tokens but LEAST_TOKENS at least is a leak where a document holds it whole, word for word; shorter ones match
    nothing. Null and blank texts match nothing, null ids are groups like any other, repeated rows give one row, an
    empty table on either side gives none.
    """
    docs = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = bench.select(bench[item_col].alias("item_id"), tokens(bench[item_text_col].cast("string")).alias("w")).where(F.size("w") >= LEAST_TOKENS)
    items = items.dropDuplicates(["item_id", "w"]).withColumn("row", F.xxhash64("item_id", "w"))
    spans = docs.select("doc_id", "text_key", tokens(docs.text).alias("w")).select("doc_id", "text_key", F.size("w").alias("size"), "w")
    spans = spans.select("doc_id", "text_key", "size", F.posexplode_outer(_spans(masks)).alias("at", "seed")).where("seed is not null")

    total, longest = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.max(F.size("w")), F.lit(0))).first()
    blocks = max(1, -(-total * len(masks) // BLOCK))
    side = F.broadcast if longest <= BLOCK else (lambda df: df)  # an item too long for a block is shuffled
    found = []
    for b in range(blocks):
        seeds = items.where(F.pmod("row", F.lit(blocks)) == b).select("row", F.size("w").alias("n"), F.posexplode_outer(_spans(masks)).alias("ipos", "seed")).where("seed is not null")
        hits = spans.join(side(seeds.select("row", "n", "seed", (F.col("ipos") % F.col("n")).alias("ipos"))), "seed")
        found.append(hits.select("doc_id", "text_key", "row", "n", (F.col("at") % F.col("size") - F.col("ipos")).alias("diagonal")))
    hits = stored(reduce(DataFrame.union, found).distinct(), "hits")

    ids = hits.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    same = docs.doc_id.eqNullSafe(F.col("_doc")) & (docs.text_key == F.col("_key"))
    hit = docs.join(ids, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    hit = hit.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), tokens(F.col("text")).alias("w"))
    met = hits.join(hit, hits.doc_id.eqNullSafe(F.col("_doc")) & (hits.text_key == F.col("_key")))
    # the document's tokens beside the item: w[0] of the slice meets the item's token number `skip`
    slice_ = F.slice("w", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.least(F.col("n"), F.col("n") + F.col("diagonal")))
    met = met.select("doc_id", "row", "n", "diagonal", slice_.alias("w"), F.greatest(-F.col("diagonal"), F.lit(0)).alias("skip"))
    pairs = met.join(items.select("row", "item_id", F.col("w").alias("iw")), "row")
    step = "if(w[j] = iw[j + skip], 1, -1)"
    stretch = f"""aggregate(sequence(0, size(w) - 1), struct(0 as now, 0 as best),
        (s, j) -> struct(greatest(0, s.now + {step}) as now, greatest(s.best, s.now + {step}) as best)).best"""
    scored = pairs.select("doc_id", "item_id", F.expr(stretch).alias("score"), F.col("diagonal").alias("doc_pos"), "n").where(F.col("score") >= F.least(F.lit(min_score), F.col("n")))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("doc_pos")).alias("p"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.score").cast("long").alias("score"), (-F.col("best.p")).cast("long").alias("doc_pos"))
