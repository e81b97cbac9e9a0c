"""URL filter: host and path rules first, then a character language-model ratio. DataFrame functions only.

Two variable-order Markov models, of accepted and of rejected URLs, are counted by grouped aggregation
over every URL that a rule decides, and smoothed by Witten-Bell interpolation from order 0 to ORDER. Their
log ratio becomes one dense array over an alphabet of 32 symbols (32 ** (ORDER + 1) entries, whatever the
input), read as a scalar subquery, so scoring needs neither a join nor a shuffle. A URL's score is its
summed log ratio over its length. The threshold is the one with the least balanced error on the labelled URLs,
each scored by models that have not seen it: two more pairs are counted from either half of the URLs, by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (host, path, verdict). A rule fits its host, all its subdomains, and paths that start with its path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Context length of the models.
ORDER = 2
#: Symbols 1 to 26 are letters; the rest as listed, digits as one. 0 is whatever else and what stands before the start.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-?"
GRID = 1000  # thresholds are multiples of 1 / GRID


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; null or without '://': both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; ties go to the earlier rule."""
    fits = []
    for i, (h, p, verdict) in enumerate(rules):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(len(h + p)).alias("n"), F.lit(-i).alias("i"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def _codes(url: Column) -> Column:
    """The URL as an array of symbols, empty for null."""
    known = F.translate(ascii_lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    return F.transform(F.array_remove(F.split(known, ""), ""), lambda c: F.instr(F.lit(SYMBOLS), c))


def _grams(size: int) -> str:
    """SQL: for each symbol of array w, its code and those before it as one number in base 32."""
    mask = 32**size - 1
    return f"""transform(sequence(0, size(w) - 1), i -> ({' + '.join(f'if(i >= {k}, get(w, i - {k}), 0) * {32**k}' for k in range(size))}) & {mask})"""


def _counts(labelled: DataFrame, order: int) -> DataFrame:
    """(g, fold, a, b): how often accepted and rejected URLs of either half hold each gram; 2 * 32 ** (order + 1) rows at most."""
    grams = labelled.where("size(w) > 0").select("verdict", "fold", F.explode(F.expr(_grams(order + 1))).alias("g"))
    of = {v: F.coalesce(F.count_if(F.col("verdict") == name), F.lit(0)) for v, name in (("a", "allow"), ("b", "block"))}
    return grams.groupBy("g", "fold").agg(*(n.alias(v) for v, n in of.items()))


def _model(counts: DataFrame, order: int) -> DataFrame:
    """One row, one array: log P(symbol | context) of accepted over rejected, by gram of order + 1 symbols."""
    size = order + 1
    grid = counts.sparkSession.range(32**size).select(F.col("id").alias("g"), F.lit(1 / 32).alias("pa"), F.lit(1 / 32).alias("pb"))
    for k in range(size):  # order k sees k symbols of context
        ends = counts.groupBy((F.col("g") % 32 ** (k + 1)).alias("e")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = ends.groupBy(F.floor(F.col("e") / 32).alias("c")).agg(*(x for v in "ab" for x in (F.sum(v).alias(f"n{v}"), F.count_if(F.col(v) > 0).alias(f"t{v}"))))
        grid = grid.withColumn("e", F.col("g") % 32 ** (k + 1)).withColumn("c", F.floor(F.col("e") / 32)).join(ends, "e", "left").join(context, "c", "left").fillna(0, ["a", "b", "na", "nb", "ta", "tb"])
        p = {v: F.when(F.col(f"n{v}") == 0, F.col(f"p{v}")).otherwise((F.col(v) + F.col(f"t{v}") * F.col(f"p{v}")) / (F.col(f"n{v}") + F.col(f"t{v}"))) for v in "ab"}
        grid = grid.select("g", p["a"].alias("pa"), p["b"].alias("pb"))
    ratio = F.round(F.log("pa") - F.log("pb"), 9)
    return grid.select("g", ratio.alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("lm"))


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the score, in GRID-ths, below which URLs are rejected. Null if a class has no URLs."""
    classes = scored.groupBy("cell").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # cells are bounded by the range of scores
    total = Window.partitionBy()
    error = F.coalesce(F.sum("a").over(before), F.lit(0)) / F.sum("a").over(total) + 1 - F.coalesce(F.sum("b").over(before), F.lit(0)) / F.sum("b").over(total)
    best = classes.withColumn("whole", (F.sum("a").over(total) > 0) & (F.sum("b").over(total) > 0)).where("whole")
    return best.select("cell", F.round(error, 9).alias("error")).agg(F.min_by("cell", F.struct("error", "cell")).alias("t"))


def _prepared(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    """(page_id, host, path, fold, rule, verdict, w) of every row: which half its URL is in, what the rules say, its symbols."""
    urls = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    fold = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
    urls = urls.select("page_id", host.alias("host"), path.alias("path"), "url", fold.alias("fold")).withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    return urls.select("page_id", "host", "path", "fold", F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("verdict"), _codes(F.col("url")).alias("w"))


def _score(order: int) -> Column:
    """Summed log ratio of the symbols of w under the model lm, over their number."""
    total = F.aggregate(F.expr(_grams(order + 1)), F.lit(0.0), lambda s, g: s + F.get(F.col("lm"), g))
    return F.round(F.when(F.size("w") > 0, total / F.size("w")).otherwise(F.lit(0.0)), 9)


def _held_out(labelled: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The gram counts, and (verdict, cell) of every labelled URL under the models of the half that it is not in."""
    counts = stored(_counts(labelled, order), "grams")
    unseen = [stored(_model(counts.where(F.col("fold") != half), order), "model").scalar() for half in (0, 1)]
    scored = labelled.withColumn("lm", F.when(F.col("fold") == 0, unseen[0]).otherwise(unseen[1])).select("verdict", _score(order).alias("score"))
    return counts, scored.select("verdict", F.floor(F.col("score") * GRID).alias("cell"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    A URL that a rule fits has the rule's verdict; any other is blocked if its score, the summed log ratio
    of the accepted and the rejected model over its number of characters, is under the threshold. A null URL
    or one without '://' has an empty host and path and no rule; a null or empty one has score 0 and is
    allowed. Without rule-decided URLs of both verdicts, as in an empty table, nothing is blocked by the
    models. Null ids and repeated rows come back as they are; the threshold's ties go to the lower score.
    """
    urls = _prepared(pages, id_col, url_col, rules)
    counts, held_out = _held_out(urls.where("verdict is not null").select("verdict", "fold", "w"), order)
    t = stored(_threshold(held_out), "threshold").scalar()
    lm = stored(_model(counts, order), "model").scalar()
    scored = urls.withColumn("lm", lm).withColumn("score", _score(order)).drop("lm")
    blocked = (F.floor(F.col("score") * GRID) < t) & (F.size("w") > 0)
    verdict = F.coalesce("verdict", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def held_out_error(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """One row (allowed, allowed_lost, blocked, blocked_missed): how many URLs that rules decide the models of the other
    half put on the wrong side of the threshold that filter_urls uses."""
    _, cells = _held_out(_prepared(pages, id_col, url_col, rules).where("verdict is not null").select("verdict", "fold", "w"), order)
    cells = stored(cells, "cells")
    t = stored(_threshold(cells), "threshold").scalar()
    good, low = F.col("verdict") == "allow", F.col("cell") < F.col("t")
    return cells.withColumn("t", t).agg(F.count_if(good).alias("allowed"), F.count_if(good & low).alias("allowed_lost"), F.count_if(~good).alias("blocked"), F.count_if(~good & ~low).alias("blocked_missed"))
