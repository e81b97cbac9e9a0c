"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as log likelihoods: the text (a letter-trigram model), the declared
markup language, the address suffix, and the host. The text model is fitted on a bounded sample of labelled
rows; how declarations and suffixes go with languages, and what each host writes in, is gathered from all
rows by grouped aggregation of the text posteriors. Host priors are smoothed towards their domain's, these
towards the suffix's, these towards the corpus's, and leave out the row in question. Texts are scored once
and only scores travel, so a host with a third of all rows costs partial sums and a split join.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, lean, stored
from .shingles import column

#: Labelled rows a language that the text model is fitted on, and as many to tell what is strange to it: by turns of
#: those whose ids have the least hashes.
SAMPLE = 500
CELLS = 1 << 16
MOST_LABELS = 4096
ALPHA = 0.02
#: Letter trigrams a text counts for at most; they depend on each other, so more would only feign certainty.
WEIGHT = 40.0
#: Strength, in rows, with which a level of the host hierarchy is drawn to the next one.
PULL = 4.0
UNKNOWN = "und"
#: Text counts as no language's if it is likelier in none by so much a trigram, as a natural logarithm: MARGIN more than
#: any labelled row that the model has not seen, for texts of ENOUGH trigrams; for shorter ones the margin grows as the
#: mean's error does, with one over the root of their number. STRANGE at most, and without such rows.
STRANGE, MARGIN, ENOUGH = 4.0, 2.0, 100
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = 32
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>|&#?\w+;")
CHUNK = 1 << 18


def visible(html: str | None) -> str:
    """Text of a page without markup, scripts, styles, comments and entities."""
    return _MARKUP.sub(" ", html or "")


def _trigrams(buf: np.ndarray, offsets: np.ndarray):
    """(lo, hi, codes, row, letters): of texts lo to hi - 1, the cells of their trigrams of lower-cased letters and
    gaps, the texts they belong to, and how many letter bytes each text has. Runs of other bytes are one gap; a
    trigram of gaps only cannot arise."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        part = buf[offsets[i] : offsets[j]]
        row = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))
        letter = _LETTER[part]
        letters = np.bincount(row[letter] - i, minlength=j - i)
        first = np.ones(len(part), bool)
        first[1:] = row[1:] != row[:-1]
        keep = letter.copy()
        keep[1:] |= letter[:-1] & ~first[1:]
        b, row = np.where(letter, _LOW[part], _SPACE)[keep].astype(np.uint32), row[keep]
        same = row[2:] == row[:-2]
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(16) if len(b) > 2 else b[:0]
        yield i, j, code[same], row[2:][same], letters
        i = j


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, (buf, offsets) = batch.column("label").to_pylist(), column(batch, "text")
        for _, _, code, row, _ in _trigrams(buf, offsets):
            for r in np.unique(row):
                have = total.setdefault(langs[r], np.zeros(CELLS, np.int64))
                have += np.bincount(code[row == r], minlength=CELLS)
    for lang, have in total.items():
        cells = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(have[cells])], names=["label", "cell", "n"])


def _least_hashed(rows: DataFrame, most: int) -> DataFrame:
    """(id, label, k): the `most` different ids of each label with the least hashes, by their rank k from 1. Only ids
    under a bound on the hash, from the label's count, are ranked: about `most` a label, however many rows it has."""
    share = (F.xxhash64("id").cast("double") / 2.0**63 + 1) / 2
    counts = rows.groupBy("label").agg(F.count("*").alias("rows"))
    if counts.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")  # a model of so many would take 2 GB
    counts = F.broadcast(counts)
    bound = most + 8 * most**0.5 + 32
    while True:
        some = rows.join(counts, "label").where((share * F.col("rows") <= bound)).select("id", "label").distinct()
        some = stored(some, "sample")
        few = some.groupBy("label").agg(F.count("*").alias("ids")).join(counts, "label", "right").where((F.coalesce("ids", F.lit(0)) < most) & (F.col("rows") > bound))
        if not few.limit(1).count():  # else ids repeat, and their rows do not tell how many there are
            return some.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= most)
        bound *= 8


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """(languages, log probabilities [cell, language], familiarity) from at most `sample` rows a language, and as many
    more that the model does not see for the familiarity, the largest gap among them. The last column is the model of text in no language: any
    trigram as likely as any other that the languages use. Of rows that repeat an id and label one counts."""
    rows = labelled.select(labelled[id_col].cast("long").alias("id"), labelled[text_col].cast("string").alias("text"), labelled[label_col].cast("string").alias("label")).where("label is not null and text is not null")
    chosen = F.broadcast(_least_hashed(rows.select("id", "label"), 2 * sample))  # 2 * `sample` ids a language
    same = rows.id.eqNullSafe(chosen.id) & (rows.label == chosen.label)
    texts = rows.join(chosen, same).groupBy(rows.label, "k").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("label", "k", F.col("x.text").alias("text"))
    texts = stored(texts, "texts")
    seen = texts.where("k % 2 = 1").select("text", "label").mapInArrow(_counts, "label string, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    found = seen.toArrow()  # at most CELLS rows a language
    langs = sorted(set(found.column("label").to_pylist()))
    if not langs:
        return [], np.zeros((CELLS, 1)), STRANGE
    total = np.zeros((CELLS, len(langs)))
    at = {k: i for i, k in enumerate(langs)}
    total[found.column("cell").to_numpy(), [at[k] for k in found.column("label").to_pylist()]] = found.column("n").to_numpy()
    logs = np.log((total + ALPHA) / (total.sum(0) + ALPHA * CELLS))
    used = max(1, int((total.sum(1) > 0).sum()))
    logs = np.concatenate([logs, np.full((CELLS, 1), -np.log(used))], axis=1)
    shared = labelled.sparkSession.sparkContext.broadcast((langs, logs, STRANGE))
    new = texts.where("k % 2 = 0").select("text").mapInArrow(_scores(shared, False), "letters long, trigrams long, text_logs array<double>")
    gaps = new.where("trigrams > 0").select(_gap(len(langs)).alias("gap")).agg(F.max("gap")).first()[0]
    return langs, logs, STRANGE if gaps is None else min(STRANGE, max(0.0, gaps))


def _gap(k: int) -> Column:
    """By how much a trigram no language explains a row of text_logs better than any of k languages; null without trigrams."""
    best = F.array_max(F.slice("text_logs", 1, k))
    return F.try_divide(F.col("text_logs")[k] - best, F.least(F.col("trigrams").cast("double"), F.lit(WEIGHT)))


def _scores(model, strip: bool):
    @lean
    def run(batches):
        langs, logs, _ = model.value
        for batch in batches:
            if strip:
                text = pa.array([visible(x) for x in batch.column("text").to_pylist()], pa.string())
                buf, offsets = column(pa.RecordBatch.from_arrays([text], names=["text"]), "text")
            else:
                buf, offsets = column(batch, "text")
            total, n, letters = np.zeros((len(batch), len(langs) + 1)), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for lo, hi, code, row, some in _trigrams(buf, offsets):
                letters[lo:hi] = some
                n[lo:hi] += np.bincount(row - lo, minlength=hi - lo)
                for k in range(len(langs) + 1):
                    total[lo:hi, k] += np.bincount(row - lo, logs[code, k], minlength=hi - lo)
            total *= np.minimum(1.0, WEIGHT / np.maximum(n, 1))[:, None]
            total -= total.max(axis=1, keepdims=True)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * (len(langs) + 1), pa.int32()), pa.array(np.round(total, 6).ravel()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(letters), pa.array(n), flat], names=[*names, "letters", "trigrams", "text_logs"])

    return run


def declared_language(html: Column) -> Column:
    """The primary subtag of the root element's lang attribute, lower-cased; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, "(?i)<html[^>]*\\slang\\s*=\\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def host_levels(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix): all labels, the last two, the last; null without a host."""
    host = F.nullif(ascii_lower(F.regexp_extract(url, "://([^/?#:]*)", 1)), F.lit(""))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _posterior(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(x - top) for x in logs]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def fuse(scored: DataFrame, langs: list[str], familiar: float = STRANGE) -> DataFrame:
    """scored (declared, host, domain, suffix, letters, text_logs, ...) with lang, posterior, text_lang.

    A row is in the language with the greatest posterior. It is UNKNOWN if its text holds no letter, or if the
    model of no language explains it better than any language by more a trigram than rows of known language let
    expect (familiar: the largest gap among those): most of its trigrams are then ones that no language has. Evidence that a row lacks (null, or no trigram) adds nothing.
    """
    k = len(langs)
    keys = ["declared", "host", "domain", "suffix"]
    post = _posterior([F.col("text_logs")[i] for i in range(k)])
    soft = scored.select("*", *(F.when(F.col("trigrams") > 0, p).otherwise(F.lit(0.0)).alias(f"s{i}") for i, p in enumerate(post)), (F.col("trigrams") > 0).cast("int").alias("one"))
    sums = lambda name: [*(F.round(F.sum(f"s{i}"), 6).alias(f"{name}{i}") for i in range(k)), F.sum("one").alias(f"{name}n")]
    out = soft
    for key in keys:
        of = soft.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(*sums(key))
        out = out.join(of, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    whole = soft.agg(*sums("whole"))
    out = out.join(F.broadcast(whole))  # one row
    own = lambda name, i: F.coalesce(F.col(f"{name}{i}") - F.col(f"s{i}"), F.lit(0.0))  # noqa: E731  without the row itself
    many = lambda name: F.coalesce(F.col(f"{name}n") - F.col("one"), F.lit(0))
    logs = []
    for i in range(k):
        share = (own("whole", i) + 1.0) / (many("whole") + k)
        corpus = share
        for level in ("suffix", "domain", "host"):
            share = (F.greatest(own(level, i), F.lit(0.0)) + PULL * share) / (many(level) + PULL)
        declared = (F.greatest(own("declared", i), F.lit(0.0)) + PULL * corpus) / (many("declared") + PULL)  # P(language | declared)
        logs.append(F.col("text_logs")[i] + F.log(share) + F.when(F.col("declared").isNotNull(), F.log(declared) - F.log(corpus)).otherwise(F.lit(0.0)))
    out = out.withColumns({f"l{i}": F.round(x, 9) for i, x in enumerate(logs)})
    final = _posterior([F.col(f"l{i}") for i in range(k)])
    out = out.withColumns({f"p{i}": p for i, p in enumerate(final)})
    best = F.array_max(F.array(*(F.struct(F.col(f"l{i}").alias("l"), F.lit(-i).alias("i"), F.lit(name).alias("lang"), F.col(f"p{i}").alias("p")) for i, name in enumerate(langs))))
    text_best = F.array_max(F.array(*(F.struct(F.col("text_logs")[i].alias("l"), F.lit(-i).alias("i"), F.lit(name).alias("lang")) for i, name in enumerate(langs))))
    bound = F.least(F.lit(STRANGE), familiar + MARGIN * F.sqrt(ENOUGH / F.greatest(F.lit(1), F.least(F.col("trigrams"), F.lit(ENOUGH)))))
    none = (F.col("letters") == 0) | F.coalesce(_gap(k) > bound, F.lit(False))
    lost = F.lit(UNKNOWN)
    return out.select(*scored.columns, F.when(none, lost).otherwise(best["lang"]).alias("lang"), F.when(none, F.lit(0.0)).otherwise(F.round(best["p"], 6)).alias("posterior"), F.when(none, lost).otherwise(text_best["lang"]).alias("text_lang"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray, float], strip: bool) -> DataFrame:
    """rows (id, text, declared, host, domain, suffix) -> (id, declared, host, domain, suffix, letters, trigrams,
    lang, posterior, text_lang), a row a row. strip: whether the text is markup. With no languages all are UNKNOWN;
    texts without a letter, null ones too, are UNKNOWN; null ids and repeated rows come back as they are."""
    langs, _, familiar = model
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = "id long, declared string, host string, domain string, suffix string, letters long, trigrams long, text_logs array<double>"
    scored = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "declared", "host", "domain", "suffix").mapInArrow(_scores(shared, strip), kinds)
    if not langs:
        return scored.select(*scored.columns[:-1], F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(UNKNOWN).alias("text_lang"))
    return fuse(stored(scored, "scores", kernel=True), langs, familiar).drop("text_logs")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Languages of pages (page_id, url, html), with the text model fitted on labelled (doc_id, text, lang)."""
    host, domain, suffix = host_levels(F.col("url"))
    rows = pages.select(pages["page_id"].cast("long").alias("id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("text"))
    rows = rows.select("id", "text", declared_language(F.col("text")).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    return identify(rows, fit(labelled, "doc_id", "text", "lang"), strip=True).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Languages of documents (doc_id, text, lang, source): lang is what is declared, source the host."""
    none = F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("declared"), docs["source"].cast("string").alias("host"), none.alias("domain"), none.alias("suffix"))
    return identify(rows, fit(docs, "doc_id", "text", "lang"), strip=False).withColumnRenamed("id", "doc_id")
