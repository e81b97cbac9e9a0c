"""The registered queries of this subpackage: each operator over its whole table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import spaced_seed_hits
from .hilbert import hilbert_shards
from .jaccard_join import ngram_jaccard_join
from .language import identify_pages
from .line_dedup import line_dedup
from .neighbours import nearest
from .packing import pack_documents
from .secrets import scan_secrets
from .url_filter import filter_urls
from .warc import round_trip


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_dictionary": op1_warc_dictionary,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_guess_cost_secrets": op3_guess_cost_secrets,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_multiprobe_neighbours": op5_multiprobe_neighbours,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_language_evidence": op7_language_evidence,
    "op8_url_language_model": op8_url_language_model,
    "op9_line_dedup": op9_line_dedup,
    "op10_spaced_seed_decontamination": op10_spaced_seed_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_dictionary": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS hex FROM p),
        firsts AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex),
        groups AS (SELECT hex, list_transform(range(8), lambda g: ('0x' || hex[g * 5 + 1 : g * 5 + 5])::BIGINT) AS five FROM firsts)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
               array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0],
                   lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> k) & 31) + 1]), '')), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
        FROM d JOIN firsts USING (hex) JOIN groups USING (hex)
    """,
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node),
        t AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.component_id
        FROM d JOIN t ON t.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        marked AS (SELECT k.*, f.first_doc IS NOT NULL AND f.first_doc <> k.doc_id AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    # no masks here: ten more equal tokens than different ones hold two equal ones in a row, and so does a whole short item
    "op10_spaced_seed_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'),
                                                                 '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'),
                                                             '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
        dp AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d),
        bp AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM b WHERE len(w) >= 5),
        ds AS (SELECT doc_id, i, w[i] AS u, w[i + 1] AS v FROM dp),
        bs AS (SELECT item_id, i, w[i] AS u, w[i + 1] AS v FROM bp),
        h AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i - bs.i AS g FROM ds JOIN bs ON ds.u = bs.u AND ds.v = bs.v),
        steps AS (SELECT h.doc_id, h.item_id, g, j, CASE WHEN d.w[j + g] = b.w[j] THEN 1 ELSE -1 END AS v
                  FROM h JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, len(b.w) + 1)) AS u(j)
                  WHERE j + g BETWEEN 1 AND len(d.w)),
        sums AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, g ORDER BY j) AS s FROM steps),
        best AS (SELECT doc_id, item_id, g,
                        s - least(0, coalesce(min(s) OVER (PARTITION BY doc_id, item_id, g ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score
                 FROM sums),
        top AS (SELECT doc_id, item_id, g, max(score) AS score FROM best GROUP BY ALL)
        SELECT doc_id, item_id, max(score)::BIGINT AS score, arg_max(g, score * 1000000000 - g)::BIGINT AS doc_pos
        FROM top JOIN b USING (item_id) WHERE score >= least(10, len(b.w)) GROUP BY doc_id, item_id
    """,
}
