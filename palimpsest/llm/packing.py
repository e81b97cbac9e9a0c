"""Best-two-fit packing of tokenised documents into sequences.

Packing needs only how many pieces have each length, a histogram of at most `size` entries whatever the
corpus. The plan is made on it: a bin is filled greedily, longest piece first, then its smallest piece
gives way to the two unpacked ones that fill the expanded gap best. Equal bins follow each other until a
length runs short, so one step of the plan stands for many bins. Pieces find their places by their rank
among the pieces of their length, counted per partition and summed over partitions.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored, texts

#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 2
SIZE = 1024
LONG_WORD = 1 << 16  # texts without a blank for so many characters take the slower library


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def encoder(path: str) -> Callable[[list[str]], Iterable[list[int]]]:
    """Ids as the tokenizers library gives them for the file at path, with add_special_tokens=False.

    A byte-level BPE file whose ids are in merge order, with nothing before or after the merges, is run by
    tiktoken from the same file (five times as fast, equal ids); any other file by the library itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", ())]
    vocab, to_byte, pre = spec["model"]["vocab"], _bytes_of_characters(), spec.get("pre_tokenizer") or {}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    alike = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and all(vocab.get("".join(m)) == 256 + i for i, m in enumerate(merges))

    def slowly(some: list[str]) -> list[list[int]]:
        return [slow.encode(t, add_special_tokens=False).ids for t in some]

    if not alike or not merges:
        return slowly
    import re

    import tiktoken

    ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join([*map(re.escape, special), rf"\S{{{LONG_WORD}}}"]))

    def run(some: list[str]) -> Iterable[list[int]]:
        for t in some:
            yield slowly([t])[0] if odd.search(t) else fast.encode_ordinary(t)

    return run


def _pieces(path: str, size: int, end: int, with_ids: bool):
    @lean
    def run(batches):
        encode, seen, part = encoder(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            held = 0
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids = np.array([*ids, end], "<u4")
                cut = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    for column, value in zip(rows, (doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), part, seen[hi - lo], ids[lo:hi].astype("<i4") if with_ids else None), strict=True):
                        column.append(value)
                    seen[hi - lo] += 1
                held += len(ids)
                if held > 4_000_000:
                    yield _piece_batch(rows)
                    rows, held = [[] for _ in range(8)], 0
            yield _piece_batch(rows)

    return run


def _piece_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"])


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces a bin, offset in the bin) of runs of equal bins."""
    left = dict(counts)
    rank = dict.fromkeys(left, 0)
    bits = sum(1 << n for n, c in left.items() if c)  # lengths at hand
    mirror = sum(1 << (size - n) for n, c in left.items() if c)
    out, bins = [], 0
    while bits:
        use: dict[int, int] = {}
        gap, now, turned = size, bits, mirror
        while gap and (fit := now & ((1 << (gap + 1)) - 1)):
            n = fit.bit_length() - 1
            use[n] = min(gap // n, left[n])
            gap -= use[n] * n
            if use[n] == left[n]:
                now, turned = now ^ 1 << n, turned ^ 1 << (size - n)
        peak = dict(use)
        if gap and sum(use.values()) > 1:
            small = min(use)
            for total in range(gap + small, small, -1):
                both = now & (turned >> (size - total)) & ((1 << (total // 2 + 1)) - 1)
                while both:
                    a = both.bit_length() - 1
                    if 2 * a != total or left[a] - use.get(a, 0) > 1:
                        break
                    both ^= 1 << a
                if both:
                    use[small] -= 1
                    for n in (a, total - a):
                        use[n] = use.get(n, 0) + 1
                        peak[n] = max(peak.get(n, 0), use[n])
                    break
        use = {n: u for n, u in use.items() if u}
        times = max(1, min((left[n] - peak[n] - 2) // u + 1 for n, u in use.items()))
        at = 0
        for n in sorted(use, reverse=True):
            u = use[n]
            out.append((n, rank[n], rank[n] + times * u, bins, u, at))
            at += n * u
            rank[n] += times * u
            left[n] -= times * u
            if not left[n]:
                bits, mirror = bits ^ 1 << n, mirror ^ 1 << (size - n)
        bins += times
    return out


def _places(plan):
    def run(batches):
        length, first, bins, each, offset, key = plan.value
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, (n << 44) + r, "right") - 1
            k = r - first[i]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bins[i] + k // each[i]), pa.array(offset[i] + k % each[i] * length[i])], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row a piece.

    A document is its text's ids and then `end`, so a null or empty text is one token. Only documents of
    more than `size` ids are cut, into pieces of `size`, of which the first may be shorter. Null ids and
    repeated rows are packed like any other row; an empty table gives no rows. tokenizer is the path of a
    file of the tokenizers library that every executor can read.
    """
    docs = texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>"
    pieces = stored(docs.mapInArrow(_pieces(tokenizer, size, end, with_ids), schema), "pieces", kernel=True)
    by_part = pieces.groupBy("part", "length").count()
    plan = sorted(best_two_fit({r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}, size))
    length, first, _, bins, each, offset = (np.array(c, np.int64) for c in zip(*plan, strict=True)) if plan else (np.zeros(0, np.int64),) * 6
    table = docs.sparkSession.sparkContext.broadcast((length, first, bins, each, offset, (length << 44) + first))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    placed = ranked.select(*columns, "rank").mapInArrow(_places(table), f"{types}, sequence_id long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
