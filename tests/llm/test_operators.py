"""Every operator on Spark: brute-force results, and nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import common, decontaminate, hilbert, jaccard_join, language, line_dedup, neighbours, packing, queries, secrets, url_filter, warc
from palimpsest.llm.common import scratch
from palimpsest.llm.components import components

from .test_kernels import plain_base, shingle_set

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
CLASH = ["token", "doc", "n", "p", "a", "b", "h", "g", "pos", "line", "seed", "w", "hist", "_doc", "_key", "part", "curve", "position", "_row", "tokens", "size", "lm", "cell", "digest", "row", "vec", "v", "score", "block"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, chains, shared lines, and every odd case."""
    base, passage = prose(120), prose(60)
    texts = [base, base, base.upper(), base + " " + prose(4), base.replace(VOCABULARY[0], "zz")]
    grown = base
    for _ in range(6):  # a chain: neighbours link, ends may not
        grown = " ".join(grown.split()[8:]) + " " + prose(8)
        texts.append(grown)
    for _ in range(20):
        some = base.split()
        for _ in range(RNG.randrange(8)):
            some[RNG.randrange(len(some))] = RNG.choice(VOCABULARY)
        texts.append(" ".join(some))
    texts += [f"{prose(40)}\n{passage}\n{prose(40)}" for _ in range(15)]
    texts += [None, "", " \n\t ", "one two", "one  two", "ONE two", "tiny", "\n", "é ſ K", prose(30_000), passage, passage]
    texts += [prose(RNG.randrange(1, 60)) for _ in range(20)]
    return [(i, t) for i, t in enumerate(texts)]


ROWS = corpus()
ODD = [(500, ROWS[0][1]), (500, ROWS[0][1]), (None, ROWS[0][1]), (None, None), (501, "other words are here now"), (501, "quite something else is written here")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(7) for i, c in enumerate(CLASH)}) if extra else df


def linked(rows):
    """doc_id -> (size, least id reached), by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (None, 1)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("common", [1024, 1])
def test_jaccard_join_agrees_with_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard_join, "COMMON", common)  # 1: every shingle's entries are dealt over parts
    monkeypatch.setattr(jaccard_join, "SALTS", 3 if common == 1 else 256)
    got = jaccard_join.ngram_jaccard_join(frame(spark, ROWS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(ROWS)
    few = jaccard_join.ngram_jaccard_join(frame(spark, ROWS), buckets=1 << 14).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, got))  # the order of shingles changes no link


def test_the_bitmap_keeps_every_member(spark):
    ids = [(i * 7919,) for i in range(5000)]
    members = jaccard_join._Members(spark.createDataFrame(ids, "doc_id long"))
    flat = members.flat.value
    bits = [r.bit for r in spark.createDataFrame(ids, "doc_id long").select(members.bit("doc_id").alias("bit")).collect()]
    assert all(flat[b >> 3] >> (b & 7) & 1 for b in bits)
    assert int(np.unpackbits(flat).sum()) == len(set(bits))


def test_jaccard_join_of_odd_rows(spark):
    got = jaccard_join.ngram_jaccard_join(frame(spark, ROWS[:40] + ODD)).collect()
    assert len(got) == 40 + len(ODD)
    assert [r.component_id for r in got if r.doc_id == 500] == [0, 0]
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (len(shingle_set(ROWS[0][1])), None)]
    assert {(r.component_id) for r in got if r.doc_id == 501} == {501}
    assert jaccard_join.ngram_jaccard_join(frame(spark, [])).count() == 0
    assert sorted(tuple(r) for r in jaccard_join.ngram_jaccard_join(frame(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 1), (2, 0, 2)]


def plain_lines(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({i: i + 32 for i in range(65, 91)})
    rank = lambda d: (d is None, d or 0)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(rank(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == rank(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINES = [
    (1, "a line that many share\nshort\nonly here, once"),
    (2, "  A LINE that many share\t\nshort\n\n"),
    (3, "a line that many share\na line that many share\nÉcole des lignes\n" + "x" * 100_000),
    (4, None),
    (5, ""),
    (6, "école des lignes\nÉcole des lignes"),
    (7, "123456789\n123456789"),
    (8, "123456789\n1234567890"),
    (9, "1234567890"),
    (None, "a line that many share\nseen by none but nulls"),
    (None, "seen by none but nulls"),
    (0, "only here, once"),
    (2, "  A LINE that many share\t\nshort\n\n"),
    (10, "all gone already\n"),
    (9, "all gone already"),
]


@pytest.mark.parametrize("salts", [1, 1024])
def test_line_dedup_agrees_with_plain_lines(spark, salts):
    for rows in (LINES, ROWS[:60], []):
        df = frame(spark, rows)
        got = line_dedup.keep_lines(df, line_dedup.line_bitmaps(df, salts=salts)).select("doc_id", "n_lines", "n_dropped", "kept_text")
        assert sorted(map(tuple, got.collect()), key=repr) == plain_lines(rows)


def test_bitmaps_are_runs(spark):
    text = "\n".join(f"line number {i:05}" for i in range(10))
    rows = [(1, text), (2, "mine alone, this line\n" + text + "\nand this line too")]
    marks = line_dedup.line_bitmaps(frame(spark, rows)).collect()
    assert [(r.doc_id, r.n_dropped, [(k.start, k["count"]) for k in r["keep"]]) for r in marks] == [(2, 10, [(0, 1), (11, 1)])]


def plain_leaks(docs, items, masks=decontaminate.MASKS, least=10):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        for i, u in items:
            w, iw = cut(t), cut(u)
            diagonals = {a - b for m in masks for a in range(len(w) - len(m) + 1) for b in range(len(iw) - len(m) + 1) if all(w[a + j] == iw[b + j] for j, c in enumerate(m) if c == "1")}
            for g in sorted(diagonals, reverse=True):
                now = best = 0
                for j in range(max(0, -g), min(len(iw), len(w) - g)):
                    now = max(0, now + (1 if w[j + g] == iw[j] else -1))
                    best = max(best, now)
                if len(iw) >= 5 and best >= min(least, len(iw)):
                    out[d, i] = max(out.get((d, i), (0, -(10**9))), (best, -g))
    return {(d, i, s, -g) for (d, i), (s, g) in out.items()}


def test_decontamination_agrees_with_all_diagonals(spark, monkeypatch):
    items = [(i, prose(RNG.randrange(8, 40))) for i in range(6)] + [(90, None), (91, ""), (92, "a b c"), (None, prose(20)), (0, "another text of the same item but one with other words in it")]
    docs = [(i, t) for i, t in ROWS if t is None or len(t) < 2000][:25]
    for i, (_, text) in enumerate(items[:6]):
        words = text.split()
        docs.append((600 + i, prose(10) + " " + text.upper().replace(" ", ", ") + " " + prose(5)))
        changed = list(words)
        for at in range(4, len(changed), 7):
            changed[at] = "changed"
        docs.append((700 + i, " ".join(changed)))
        docs.append((800 + i, " ".join(words[:9])))  # nine words are a leak of an item that has no more
    docs += [docs[30], (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1)).withColumn("row", F.lit(1))
    wanted = plain_leaks(docs, items)
    assert {d for d, *_ in wanted} >= {600, 604, None}
    for block, some in ((1_000_000, "true"), (300, "true"), (len(items[1][1].split()) - 1, "item_id = 1")):  # one pass, several, an item longer than a block
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = {tuple(r) for r in decontaminate.spaced_seed_hits(frame(spark, docs), bench.where(some)).collect()}
        assert got == {w for w in wanted if some == "true" or w[1] == 1}
    assert decontaminate.spaced_seed_hits(frame(spark, []), bench).count() == 0
    assert decontaminate.spaced_seed_hits(frame(spark, docs), bench.where("false")).count() == 0


PAGES = [(3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "u", None), (5, "u", ""), (6, "", "<p>é</p>" * 50_000), (7, "x\ny", "alone"), (None, "n", "<p>same</p>"), (8, "twice", "row"), (8, "twice", "row")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "row", "first", "payload", "refers_to")})
    got = warc.round_trip(pages, least_bytes=least).collect()
    assert len(got) == len(PAGES) and all(r.intact for r in got)
    wanted = []
    for p, _, html in PAGES:
        payload = (html or "").encode()
        peers = [q for q, _, h in PAGES if (h or "") == (html or "") and q is not None]
        first = min(peers) if peers else None
        revisit = len(payload) >= least and p != first
        wanted.append((p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    wanted = [w for w in wanted if w[0] != 8]
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted((r for r in rows if r[0] != 8), key=repr) == sorted(wanted, key=repr)
    twice = sorted((r[3], r[4]) for r in rows if r[0] == 8)
    assert twice == ([("response", None), ("revisit", 8)] if least == 0 else [("response", None)] * 2)
    payloads = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(payloads[6]) == ("<p>é</p>" * 50_000).encode() and bytes(payloads[1]) == b"<p>same</p>"
    assert warc.round_trip(pages.where("false")).count() == 0


def test_secret_scan(spark):
    rows = [(1, 'password = "hunter2hunter2" token: 04dbebab91ab85687d33eeaaf9ac699e1188f962'), (2, None), (3, ""), (None, "AKIA" + "A1" * 8), (4, "é password:x7Kq2mZpR9"), (4, "é password:x7Kq2mZpR9"), (5, "login: 9f8s7dG2hjK1, pin=1234 pwd = changeme"), (6, "x" * 1_000_000 + " secret=abcdef")]
    got = secrets.scan_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows, strict=True):
        base = plain_base(t or "")
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex) == (d, *(sum(k == n for _, k, _ in base) for n in range(3)))
        assert r.base_sha256 == hashlib.sha256(secrets.written(base).encode()).hexdigest()
        assert {secrets.written([x]) for x in base} <= set(r.spans.split(","))
    assert "guess:7:19" in got[6].spans and got[6].n_assign == 0 and got[6].spans.count("guess") == 1
    masked = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert masked[1] == '[secret]" [secret]' and masked[2] is None and "9f8s" not in masked[5]
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_common_words(spark):
    texts = ["aaa bbb bbb ccc ccc Ccc x yy password: zzz", "ddd ddd éée éée ccc", None, "", "zzz"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert secrets.common_words(docs) == ["ccc", "bbb", "ddd", "éée", "aaa", "zzz"]  # the value of a password is no word
    assert secrets.common_words(docs, most=4) == ["ccc", "bbb", "ddd", "éée"] and secrets.common_words(docs, most=3) == ["ccc"]
    assert secrets.common_words(docs.where("false")) == []


def test_hilbert_shards(spark):
    rows = [(i if i % 9 else None, t, ["en", "de", None][i % 3], f"src{i % 5}", None if i % 7 == 0 else i * i) for i, (_, t) in enumerate(ROWS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("dim0", "curve", "position", "size", "shard")})
    got = hilbert.hilbert_shards(docs, bits=3).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    counts = [sum(r.shard == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    order = [(r.curve, r.text_crc32, r.size, r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    few = hilbert.hilbert_shards(docs.limit(3)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert.hilbert_shards(docs.where("false")).count() == 0
    path = hilbert.write_shards(docs.drop("shard"), scratch(spark, "test"))
    assert spark.read.parquet(path).count() == len(rows)


def test_every_dimension_prunes_shards(spark):
    """Few values spread over their whole axis, and texts that begin alike are told apart."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(5000), rng.choice(["en", "de", "fr", "zh-Hans", "zh-Hant"]), f"https://www.example.org/source/{rng.randrange(20):02d}") for i in range(4000)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    of = {r.doc_id: r.shard for r in hilbert.hilbert_shards(docs).select("doc_id", "shard").collect()}
    for column, most in ((2, 5), (3, 5)):
        shards = defaultdict(set)
        for r in rows:
            shards[r[column]].add(of[r[0]])
        print({k: sorted(v) for k, v in shards.items()})
        assert sum(map(len, shards.values())) / len(shards) <= most
    cells = hilbert.with_curve(docs, ["source"], 5).select("source", "curve").distinct().collect()
    assert len({r.curve for r in cells}) == len(cells) == 20
    assert [r.source for r in sorted(cells, key=lambda r: r.curve)] == sorted({r[3] for r in rows})


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 800)] + 0.5 * rng.standard_normal((800, 16))
    x[10:15] = x[9]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 16), (1300, [1.0] * 15 + [None]), (1400, [float("nan")] * 16), (1500, [float("inf")] + [1.0] * 15), (1600, [1.0] * 8), (None, [1.0] * 16), (300, rows[300][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "score", "rank", "query_id")})
    got = neighbours.nearest(df).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    assert set(found) == set(range(0, 800, 100))
    right = 0
    for q, mine in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [(d[i], i) for i in np.lexsort((np.arange(800), d)) if i != q][:10]
        assert len(mine) == 10 and mine == sorted(mine)
        assert all(abs(s - d[i]) < 1e-12 and i != q for s, i in mine)
        right += len({i for _, i in mine} & {i for _, i in best})
    assert right >= 0.9 * 10 * len(found)
    assert neighbours.nearest(df.where("vec_id >= 1000")).count() == 0
    few = neighbours.nearest(df.where("vec_id in (0, 5, 7)")).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 5), (0, 7)}  # all candidates, hashed together or not


def test_neighbours_of_hot_vectors_and_several_lengths(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(i, [float(v) for v in rng.standard_normal(3)]) for i in range(400, 600)] + [(i, [float(v) for v in 1e5 + 1e-3 * rng.standard_normal(4)]) for i in range(600, 900)]
    rows += [(500, [9.0, 9.0, 9.0]), (700, rows[700][1])]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(range(0, 900, 100))
    for q, mine in got.items():
        own = min(v for i, v in rows if i == q)
        near = {}
        for i, v in rows:
            if i != q and len(v) == len(own):
                d = math.sqrt(sum((a - b) ** 2 for a, b in zip(v, own, strict=True)))
                near[i] = min(d, near.get(i, d))
        best = sorted((d, i) for i, d in near.items())[:10]
        mine = sorted(mine)
        assert [n for n, *_ in mine] == list(range(1, 11)) and all(abs(d - near[i]) < 1e-9 for _, d, i in mine)
        if q < 400 or q >= 600:  # equal vectors, and offsets that squared norms would drown
            assert [i for *_, i in mine] == [i for _, i in best]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the generated tables")
def test_recall_on_the_table(spark):
    """Recall against all distances with production parameters, and the share of rows that is measured."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if r.embedding]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    held = neighbours.entries(neighbours._valid(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding"), 11)
    index = neighbours.Index(x.shape[1], neighbours.scale_of(held), neighbours.TABLES, neighbours.HASHES, neighbours.PROBES)
    with np.errstate(over="ignore"):
        block = neighbours.Block(x, ids, np.arange(len(x) + 1), index)
        right, share = [], []
        for i in np.flatnonzero(ids % 100 == 0):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            best = set(ids[np.lexsort((ids, d))][:11])
            probes = [index.probes(x[i : i + 1], t)[0] for t in range(neighbours.TABLES)]
            found, _ = block.best(x[i], probes, 11)
            right.append(len(best & set(found)) / 11)
            share.append(len(block.members(probes)) / len(x))
    print(f"recall {np.mean(right):.3f}, measured share of the rows {np.mean(share):.3f}")
    assert np.mean(right) >= 0.9 and np.mean(share) < 0.75


def test_packing(spark):
    path = queries.tokenizer_path()
    rows = [(d, t) for d, t in ROWS if not t or len(t) < 5000] + ODD + [(900, ROWS[-25][1] or ""), (901, " ".join(VOCABULARY) * 4)]
    got = packing.pack_documents(frame(spark, rows), path, size=64, with_ids=True).collect()
    encode = packing.encoder(path)
    wanted = []
    for d, t in rows:
        ids = [*next(iter(encode([t or ""]))), 2]
        first = (len(ids) - 1) % 64 + 1
        edges = [0, *range(first, len(ids) + 1, 64)]
        wanted += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=repr) == sorted(wanted, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * -(-sum(r.length for r in got) // 64)
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_url_filter(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        host = rng.choice(["a.example.com", "b.example.net", "c.example.org", "www.example.com", "x.org"])
        rows.append((i, f"https://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(1000)}{rng.choice(['', '?a=1', '#t'])}"))
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "http://EXAMPLE.com/en/x"), (904, "http://notexample.com/en/"), (905, "http://www.example.com/en/"), (906, "http://com"), (907, "http://a.net/es/?q"), (908, "é://ünï.org/ß" + "y" * 5000), (None, "http://x.org/1"), (0, rows[0][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "path", "rule", "w", "lm", "cell", "verdict")})
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    parts = {}
    for p, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        parts[p] = (host.translate({i: i + 32 for i in range(65, 91)}), path)
    for r in got:
        host, path = parts[r.page_id]
        fits = [(len(h + q), h + q, v) for h, q, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        if rule:
            assert r.verdict == rule[2]
    by_id = {r.page_id: r for r in got}
    assert [by_id[i].verdict for i in (900, 901, 903, 904, 905, 906)] == ["allow", "allow", "block", "allow", "allow", "allow" if by_id[906].rule else by_id[906].verdict]
    check_models(rows, got)
    alone = url_filter.filter_urls(pages.where("page_id = 902")).collect()
    assert [(r.verdict, r.rule) for r in alone] == [("allow", None)]
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def check_models(rows, got):
    """Scores and threshold by a plain computation."""
    code = lambda u: [url_filter.SYMBOLS.find("0" if c in "0123456789" else chr(ord(c) + 32) if "A" <= c <= "Z" else c) + 1 for c in u or ""]
    urls, ruled = dict(rows), {r.page_id: r.verdict for r in got if r.rule}
    fold = {p: xxhash.xxh64(u.encode(), seed=42).intdigest() % 2 for p, u in rows if p in ruled}

    def model(folds):
        counts = {v: [defaultdict(int) for _ in range(3)] for v in ("allow", "block")}
        for p, u in rows:
            if p in ruled and fold[p] in folds:
                w = [0, 0, *code(u)]
                for i in range(2, len(w)):
                    for k in range(3):
                        counts[ruled[p]][k][tuple(w[i - k : i + 1])] += 1

        def chance(v, gram):
            p = 1 / 32
            for k in range(3):
                part = gram[2 - k :]
                after = [c for g, c in counts[v][k].items() if g[:-1] == part[:-1]]
                if after:
                    p = (counts[v][k].get(part, 0) + len(after) * p) / (sum(after) + len(after))
            return p

        ratio = {}

        def score(u):
            w = [0, 0, *code(u)]
            total = 0.0
            for i in range(2, len(w)):
                gram = tuple(w[i - 2 : i + 1])
                if gram not in ratio:
                    ratio[gram] = round(np.log(chance("allow", gram)) - np.log(chance("block", gram)), 9)
                total += ratio[gram]
            return round(total / len(u), 9) if u else 0.0

        return score

    whole, unseen = model({0, 1}), [model({1}), model({0})]
    for r in got:
        assert abs(r.score - whole(urls[r.page_id])) < 1e-6
    cells = lambda v: [math.floor(unseen[fold[p]](u) * url_filter.GRID) for p, u in rows if ruled.get(p) == v]
    good, bad = cells("allow"), cells("block")
    errors = {t: round(sum(c < t for c in good) / len(good) + sum(c >= t for c in bad) / len(bad), 9) for t in sorted({*good, *bad})}
    t = min(errors, key=lambda c: (errors[c], c))
    for r in got:
        if not r.rule:
            assert r.verdict == ("block" if urls[r.page_id] and math.floor(r.score * url_filter.GRID) < t else "allow")


LANGS = {"en": "the of and that with from this are was", "de": "der die und nicht mit von eine ist das", "fr": "les des dans pour avec une est que sur"}


def text_in(lang, n, rng):
    return " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "er", "en", "es"]) for _ in range(n))


def test_language_identification(spark):
    rng = random.Random(8)
    docs = [(i, text_in(k, 40, rng), k, f"src{i % 4}", 1) for i, k in enumerate(["en", "de", "fr"] * 60)]
    labelled = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("host", "declared", "label", "id")})
    pages, truth = [], {}
    for i in range(150):
        k = ["en", "de", "fr"][i % 3]
        truth[i] = k
        declared = k if i % 10 else "de"
        pages.append((i, f"http://w{i % 3}.site.{'com' if k == 'en' else k}/{i}", f'<html lang="{declared}"><script>var x = "der die das";</script><p>{text_in(k, 12, rng)}</p></html>'))
    odd = [(900, None, None), (901, "", ""), (902, "http://w0.site.com/", "<html lang=en>123 !!</html>"), (None, "u", pages[0][2]), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "lang", "text", "s0")})
    got = language.identify_pages(df, labelled).collect()
    assert len(got) == len(pages) + len(odd)
    assert sum(r.lang == truth[r.page_id] for r in got if r.page_id in truth) >= 0.97 * len(pages)
    assert all(0 <= r.posterior <= 1 for r in got)
    assert {r.lang for r in got if r.page_id in (900, 901, 902)} == {language.UNKNOWN}
    assert {r.lang for r in language.identify_pages(df, labelled.where("false")).collect()} == {language.UNKNOWN}
    assert language.identify_pages(df.where("false"), labelled).count() == 0
    held = language.identify_documents(labelled).collect()
    assert sum(r.lang == docs[r.doc_id][2] for r in held) == len(docs)


def plain_language(pages, labelled, strange):
    """Scores and fusion in plain Python: page_id -> (lang, posterior), with every labelled row as the model's sample."""

    def cells(text):
        b, out = text.encode(), []
        letter = [chr(c).isalpha() if c < 128 else True for c in b]
        for i, c in enumerate(b):
            if letter[i]:
                out.append(ord(chr(c).lower()) if c < 128 else c)
            elif i and letter[i - 1]:
                out.append(32)
        return [((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 16 for x, y, z in zip(out, out[1:], out[2:], strict=False)], sum(letter)

    langs, seen = sorted({k for *_, k in labelled}), defaultdict(lambda: defaultdict(int))
    for _, t, k in labelled:
        for c in cells(t)[0]:
            seen[k][c] += 1
    size = {k: sum(seen[k].values()) for k in langs}
    flat = -math.log(len({c for k in langs for c in seen[k]}))
    rows = []
    for p, url, html in pages:
        code, letters = cells(language.visible(html))
        n = len(code)
        logs = [sum(math.log((seen[k][c] + 0.02) / (size[k] + 0.02 * 65536)) for c in code) for k in langs] + [flat * n]
        logs = [x * min(1.0, 40 / max(n, 1)) for x in logs]
        logs = [round(x - max(logs), 6) for x in logs]
        soft = [math.exp(x) for x in logs[:-1]]
        said = re.search(r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", html or "")
        host = (re.search("://([^/?#:]*)", url or "") or [None, ""])[1].lower() or None
        levels = {"declared": said and said[1].lower(), "host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host and host.split(".")[-1]}
        rows.append((p, n, letters, logs, [x / sum(soft) if n else 0.0 for x in soft], levels))
    out = {}
    for p, n, letters, logs, soft, levels in rows:
        total = []
        for i in range(len(langs)):

            def others(level, i=i, p=p, levels=levels):
                some = [r for r in rows if r[0] != p and (level is None or levels[level] is not None and r[5][level] == levels[level])]
                return sum(r[4][i] for r in some), sum(r[1] > 0 for r in some)

            mass, many = others(None)
            share = corpus = (mass + 1) / (many + len(langs))
            for level in ("suffix", "domain", "host"):
                mass, many = others(level)
                share = (mass + 4 * share) / (many + 4)
            mass, many = others("declared")
            said = (mass + 4 * corpus) / (many + 4)
            total.append(logs[i] + math.log(share) + (math.log(said) - math.log(corpus) if levels["declared"] else 0))
        weights = [math.exp(x - max(total)) for x in total]
        none = not letters or n and (logs[-1] - max(logs[:-1])) / min(n, 40) > strange
        out[p] = ("und", 0.0) if none else (langs[max(range(len(langs)), key=lambda i: (total[i], -i))], max(weights) / sum(weights))
    return out


def test_language_scores_and_fusion_agree_with_plain_python(spark, monkeypatch):
    rng = random.Random(12)
    labelled = [(i, text_in(k, 30, rng), k) for i, k in enumerate(["en", "de", "fr"] * 40)]
    pages = [(i, f"http://{rng.choice(['a', 'B', 'c.d'])}.x{i % 2}.{rng.choice(['com', 'de', 'fr'])}/{i}", f'<html lang="{rng.choice(["en", "de", "fr", "xx"])}">{text_in(rng.choice(["en", "de", "fr"]), rng.choice([1, 2, 30]), rng)}</html>') for i in range(80)]
    pages += [(90, None, "é"), (91, "http://a.x0.com", ""), (92, "no host", "<p>nicht die</p>"), (93, "http://q.de/", "zzxqj kkvwq " * 20), (94, "", None)]
    for n, (k, host) in enumerate([("de", "gut"), ("en", "good"), ("fr", "bon")]):  # hosts of one language, with texts that say little
        pages += [(200 + 40 * n + i, f"http://{host}.org/", text_in(k, 20, rng)) for i in range(20)]
        pages += [(220 + 40 * n + i, f"http://{host}.org/", w) for i, w in enumerate(["e", "s", "er", "en", "es", "d", "st", "t", "n e", "a"])]
    # every labelled row is in the model's half: the other half has none
    ranked = language._least_hashed
    monkeypatch.setattr(language, "_least_hashed", lambda rows, most: ranked(rows, most).withColumn("k", F.col("k") * 2 - 1))
    got = language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labelled, "doc_id long, text string, lang string")).collect()
    wanted = plain_language(pages, labelled, language.STRANGE)
    assert {r.page_id: r.lang for r in got} == {p: lang for p, (lang, _) in wanted.items()}
    assert all(abs(r.posterior - wanted[r.page_id][1]) < 1e-4 for r in got)
    assert any(r.lang != r.text_lang for r in got)  # fusion has decided some


def test_text_in_no_language_goes(spark):
    """What the model has not seen sets the bound: other languages and junk lie beyond it, clean rows within."""
    rng = random.Random(13)
    labelled = [(i, text_in(k, 60, rng), k, "s", 1) for i, k in enumerate(["en", "de", "fr"] * 200)]
    strange = [(900, "qzx wvk jjx pqv xzk vvq " * 10, "en", "s", 1), (901, "0f3a9c d4e8b2 77aa01 " * 30, "de", "s", 1)]
    df = spark.createDataFrame(labelled + strange[:1] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    langs, _, familiar = language.fit(df.where("doc_id < 900"), "doc_id", "text", "lang")
    assert langs == ["de", "en", "fr"] and 0 <= familiar < language.STRANGE - language.MARGIN
    model = language.fit(df.where("doc_id < 900"), "doc_id", "text", "lang")
    rows = spark.createDataFrame(labelled + strange, df.schema).selectExpr("doc_id id", "text", "lang declared", "source host", "cast(null as string) domain", "cast(null as string) suffix")
    got = {r.id: r.lang for r in language.identify(rows, model, strip=False).collect()}
    assert got[900] == language.UNKNOWN and sum(got[r[0]] == r[2] for r in labelled) == len(labelled)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the generated tables")
def test_documents_of_the_table_stay_and_other_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    strange = {
        -1: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte",
        -2: "0f3a9c d4e8b2 77aa01 19bc fe01 aa90cd 8812ef 00ff aa12 bb34 cc56 dd78 ee9a " * 5,
        -3: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
    }
    rows = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(k, t, "en", "src1") for k, t in strange.items()], "doc_id long, text string, lang string, source string"))
    lost = {r.doc_id for r in language.identify_documents(rows).where(F.col("lang") == language.UNKNOWN).collect()}
    assert lost == set(strange)


def test_the_sample_of_hot_and_repeated_ids(spark):
    rows = [(i, "en") for i in range(3000)] + [(7, "en")] * 2000 + [(i, "de") for i in range(30)] + [(1, "fr")] * 500 + [(None, "fr")]
    got = language._least_hashed(spark.createDataFrame(rows, "id long, label string"), 40).collect()
    assert sorted(r.k for r in got if r.label == "en") == list(range(1, 41)) and sum(r.label == "de" for r in got) == 30
    assert {r.id for r in got if r.label == "fr"} == {1, None}


def test_markup_takes_linear_time():
    import time

    for text in ("<" * 1_000_000, "<!-- " * 200_000, "&" * 1_000_000, "<script " * 100_000, "a<b " * 250_000):
        began = time.process_time()
        language.visible(text)
        assert time.process_time() - began < 1, text[:10]


def test_evidence_decides_short_texts(spark):
    """A text that says little goes with its host; one that is clear does not."""
    rng = random.Random(9)
    labelled = spark.createDataFrame([(i, text_in(k, 40, rng), k) for i, k in enumerate(["en", "de"] * 40)], "doc_id long, text string, lang string")
    pages = [(i, f"http://{'gut' if i % 2 else 'good'}.org/{i}", text_in("de" if i % 2 else "en", 30, rng)) for i in range(60)]
    pages += [(100, "http://gut.org/x", "xq"), (101, "http://good.org/x", "xq"), (102, "http://gut.org/y", text_in("en", 30, rng))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify_pages(df, labelled).collect()}
    assert got[102].lang == "en" and got[102].text_lang == "en"
    assert (got[100].lang, got[101].lang) in (("de", "en"), (language.UNKNOWN, language.UNKNOWN))


def test_pipeline(spark, tmp_path):
    rng = random.Random(10)
    item = " ".join(VOCABULARY[40:70])
    docs = [(i, text_in(["en", "de", "fr"][i % 3], 60, rng), ["en", "de", "fr"][i % 3], f"s{i % 3}", 5) for i in range(60)]
    shared = text_in("en", 20, rng)
    docs += [(100, docs[0][1], "en", "s0", 5), (101, f"{docs[1][1]}\n{shared}", "de", "s0", 5), (102, f"{text_in('en', 50, rng)}\n{shared}", "en", "s1", 5), (103, text_in("en", 90, rng) + " " + item, "en", "s0", 5), (104, "12 34 !!", "en", "s0", 5), (105, None, "en", None, None), (None, text_in("fr", 50, rng), None, "s1", 5), (106, docs[5][1], "fr", "s1", 5), (106, docs[5][1], "fr", "s1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    root = str(tmp_path)
    spark.createDataFrame(docs, schema).withColumn("token", F.lit(1)).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    kept, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, root)
        out.write.parquet(f"{root}/{name}")
        kept = spark.read.parquet(f"{root}/{name}")
        seen[name] = kept.collect()
        if name != "best-fit packing":
            assert kept.columns == list(corpus_pipeline.COLUMNS)
    ids = {name: sorted({r.doc_id for r in rows if r.doc_id is not None}) for name, rows in seen.items()}
    clean = set(range(60))
    assert clean <= set(ids["language ID"]) and not {104, 105} & set(ids["language ID"])
    assert any(r.doc_id is None for r in seen["best-fit packing"])
    lines = {r.doc_id: r for r in seen["line dedup"]}
    assert lines[102].text.count("\n") == 0 and lines[102].n_chars == len(lines[102].text) and lines[100].text == "" and lines[101].text == shared
    joined = ids["n-gram Jaccard join"]
    assert clean <= set(joined) and [r.doc_id for r in seen["n-gram Jaccard join"]].count(106) == 1
    assert set(joined) - set(ids["benchmark decontamination"]) == {103}
    assert ids["best-fit packing"] == ids["benchmark decontamination"]
    whole = corpus_pipeline.run(spark, root)
    strip = lambda rows: sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    assert strip(whole.collect()) == strip(seen["best-fit packing"])


def test_the_pipeline_of_odd_tables(spark, tmp_path):
    schema, other = "doc_id long, text string, lang string, source string, n_chars long", [F.lit("x").alias(c) for c in ("id", "label", "keep", "token", "bit", "_id", "row")]
    odd = [(None, None, None, None, None), (1, "", "", "", 0), (None, "", None, None, None), (1, "", "", "", 0)]
    for rows, items in (([], [(1, "one two three four five six")]), (odd, [])):
        root = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, schema).select("*", *other).write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
        docs = spark.read.parquet(f"{root}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:  # each on the odd table itself, since the first one drops it all
            out = stage(spark, docs, root)
            left = {"language ID": 0, "n-gram Jaccard join": 3}.get(name, len(rows)) if rows else 0
            assert out.count() == left, name
            assert name == "best-fit packing" or out.columns == list(corpus_pipeline.COLUMNS)
        assert corpus_pipeline.run(spark, root).count() == 0


def test_kernels_of_the_pipeline_get_small_batches(spark, tmp_path, monkeypatch):
    """However many rows a partition has and however long they are; the session's own limits come back."""
    most = common.BATCH_BYTES
    rng = random.Random(12)
    docs = [(i, text_in("en", 30, rng), "en", "s", 5) for i in range(2500)] + [(10_000 + i, text_in("en", 40_000, rng), "en", "s", 5) for i in range(16)]
    root = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")

    def watched(name, make):
        def made(*options):
            kernel = make(*options)

            def run(batches):
                def noted():
                    for batch in batches:
                        with open(f"{root}/{name}", "a") as f:
                            print(len(batch), batch.nbytes, file=f)
                        yield batch

                yield from kernel(noted())

            return run

        return made

    kernels = [(language, "_scores"), (jaccard_join, "_profile"), (jaccard_join, "_prefixes"), (packing, "_pieces")]
    for module, name in kernels:
        monkeypatch.setattr(module, name, watched(name, getattr(module, name)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    try:
        assert corpus_pipeline.run(spark, root).select("doc_id").distinct().count() == len(docs)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "32m" and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for _, name in kernels:
        seen = [tuple(map(int, x.split())) for x in open(f"{root}/{name}")]
        assert sum(n for n, _ in seen) >= len(docs) and max(n for n, _ in seen) <= common.BATCH_ROWS, name
        assert max(size for _, size in seen) < most + (1 << 20), name  # a batch ends with the row that goes beyond


def test_registered_queries_have_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df, wanted = queries.QUERIES[name](spark, sf), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(wanted.columns)
        at = [wanted.columns.index(c) for c in columns]
        assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in wanted.fetchall()), name


def all_leaks(docs, items, least=10):
    """As plain_leaks, over every diagonal, hit by a mask or not."""
    out = {}
    for d, t in docs:
        for i, u in items:
            w, iw = t.split(), u.split()
            for g in range(len(w) - 1, -len(iw), -1):
                now = best = 0
                for j in range(max(0, -g), min(len(iw), len(w) - g)):
                    now = max(0, now + (1 if w[j + g] == iw[j] else -1))
                    best = max(best, now)
                if len(iw) >= 5 and best >= min(least, len(iw)):
                    out[d, i] = max(out.get((d, i), (0, -(10**9))), (best, -g))
    return {(d, i, s, -g) for (d, i), (s, g) in out.items()}


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "one two three four"), (2, "one two three four five"), (3, "alpha beta gamma delta eps zeta eta theta iota"), (4, "我们今天下午三点在图书馆见面好吗"), (5, "สวัสดีครับผมชื่อสมชาย")]
    docs = [(1, "zero one two three four five six"), (2, "alpha beta gamma delta eps zeta eta theta iota kappa"), (3, "alpha beta gamma delta eps zeta eta theta other"), (4, "他说我们今天下午三点在图书馆见面好吗。"), (5, "今天三点图书馆"), (6, "ว่าสวัสดีครับผมชื่อสมชาย")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.spaced_seed_hits(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 2), (2, 3), (4, 4), (6, 5)}


def test_no_leak_escapes_the_masks():
    masks, width = [int(m, 2) for m in decontaminate.MASKS], max(map(len, decontaminate.MASKS)) - 1
    best, before = {0: 0}, None  # last tokens, equal or not, after which no mask has had a hit: the highest score so far
    while best != before and max(best.values()) < 10:
        before, best = best, {0: 0}
        for state, score in before.items():
            for equal in (0, 1):
                seen = state << 1 | equal
                if not equal or not any(seen & m == m for m in masks):
                    key = seen & ((1 << width) - 1)
                    best[key] = max(best.get(key, -1), score + (1 if equal else -1), 0 if key == 0 else -1)
    assert max(best.values()) < 10


def test_decontamination_finds_scattered_changes(spark):
    rng = random.Random(5)
    items = [(n, prose(n, rng)) for n in (10, 20, 21, 30, 59, 60)]
    docs = []
    for i, (n, text) in enumerate(items):
        for k, every in enumerate((2, 3, 4, 5)):  # every k-th word changed, from each offset
            for start in range(every):
                words = [f"x{j}" if j % every == start else w for j, w in enumerate(text.split())]
                docs.append((1000 * i + 100 * k + start, prose(3, rng) + " " + " ".join(words) + " " + prose(3, rng)))
        for r in range(30):  # as many changes as the rule allows, and one more
            off = set(rng.sample(range(n), (n - 10) // 2 + r % 2))
            docs.append((1000 * i + 500 + r, " ".join(f"y{j}" if j in off else w for j, w in enumerate(text.split()))))
    wanted = all_leaks(docs, items)
    assert {4200, 4100} <= {d for d, *_ in wanted}
    got = {tuple(r) for r in decontaminate.spaced_seed_hits(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == wanted
