"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

Plan, per document unless said otherwise:

1. one pass over the texts gives each document's set size and 128-bit set fingerprint, and a fixed-width
   table of how often each hash bucket of shingles occurs in the whole corpus;
2. documents with equal sets are one class, represented by their least id;
3. a second pass orders each representative's set rare-first and keeps the prefix that any partner must hit;
4. prefix shingles are joined. First only neighbours by place in the prefix and the first of each shingle's
   documents are paired, so a group of n near copies costs about n pairs. Verified links give components.
   The entries of a shingle that the table calls common are dealt over SALTS parts, and each meets the first of all;
5. the shingles that still join different components are joined in full, but for the entries of a shingle's
   largest component with each other; every pair across components that passes the filters is verified once,
   and the components are completed.

So no link between different sets is lost, and pairs inside a component that is already known are never made.
Texts are read where they lie and never shuffled: which of them a pass needs is told by a bitmap of hashed ids of
bounded size, whose false hits cost time and nothing else. There is one plan for any number of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lean, stored, texts
from .components import components
from .shingles import mix, shingle_sets

#: Buckets of the frequency table. More tell more of the rare shingles apart; any number gives the same links.
BUCKETS = 1 << 20
BLOCK = 1 << 14
#: Bits of the bitmap that says which documents a pass needs: 64 an id, 16 MB at most whatever their number.
LEAST_BITS_LOG2, MOST_BITS_LOG2 = 15, 27
#: A shingle's entries are dealt over so many parts if its bucket holds COMMON more than eight times the mean.
SALTS, COMMON = 256, 1024
#: The suffix filter bounds the overlap of two sets by their counts in 256 parts of the hash range: one level of the
#: recursive halving by pivots of the published filter, taken over the whole set so that one row a document serves all pairs.
PARTS_LOG2 = 8


def _profile(n: int, buckets: int):
    @lean
    def run(batches):
        seen = np.zeros(buckets, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("hist", pa.list_(pa.int32())), ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            size, fa, fb = (np.zeros(len(batch), np.int64) for _ in range(3))
            held, held_n, hist = [], 0, np.zeros((len(batch), 1 << PARTS_LOG2), np.int32)
            with np.errstate(over="ignore"):
                for i, h in shingle_sets(batch, "text", n):
                    if len(h):
                        hist[i] = np.bincount((h >> np.uint64(64 - PARTS_LOG2)).view(np.int64), minlength=1 << PARTS_LOG2)
                        size[i], fa[i] = len(h), int(np.add.reduce(mix(h ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))
                        fb[i] = int(np.add.reduce(mix(h * np.uint64(0x2545F4914F6CDD1D) + np.uint64(len(h)))).view(np.int64))
                        held.append(h)
                        held_n += len(h)
                    if held_n > 1 << 19:
                        seen += np.bincount((np.concatenate(held) & np.uint64(buckets - 1)).view(np.int64), minlength=buckets).astype(np.uint32)
                        held, held_n = [], 0
            if held:
                seen += np.bincount((np.concatenate(held) & np.uint64(buckets - 1)).view(np.int64), minlength=buckets).astype(np.uint32)
            none = len(batch)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(none + 1) << PARTS_LOG2, pa.int32()), pa.array(hist.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(fa), pa.array(fb), parts, pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], schema=schema)
        if seen.any():
            blocks = [(b, seen[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-buckets // BLOCK))]
            rows = [(b, zlib.compress(x.tobytes(), 1)) for b, x in blocks if x.any()]
            empty = [pa.nulls(len(rows), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*empty, pa.nulls(len(rows), pa.list_(pa.int32())), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=schema)

    return run


def _summed(batches):
    """Adds up the blocks of one partition as they come; the memory is a fixed number of blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, x in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
            total[b] = total.get(b, np.zeros(len(part), np.int64)) + part
    levels = {b: np.minimum(255, 8 * np.log2(x + 1.0)).astype(np.uint8) for b, x in total.items()}
    yield pa.RecordBatch.from_arrays([pa.array(levels.keys(), pa.int32()), pa.array([x.tobytes() for x in levels.values()], pa.binary())], names=["block", "levels"])


def _levels(spark: SparkSession, profile: DataFrame, buckets: int):
    """The frequency table, a byte a bucket: the logarithm of the corpus count. BUCKETS bytes whatever the corpus. And
    the level from which a bucket is common."""
    blocks = profile.where("block is not null").select("block", "counts").repartition(min(16, -(-buckets // BLOCK)), "block")
    table = np.zeros(-(-buckets // BLOCK) * BLOCK, np.uint8)
    for row in blocks.mapInArrow(_summed, "block int, levels binary").collect():
        table[row.block * BLOCK :][: len(row.levels)] = np.frombuffer(row.levels, np.uint8)
    mean = float((2.0 ** (table[:buckets] / 8) - 1).mean())
    return spark.sparkContext.broadcast((table, 8 * np.log2(COMMON + 8 * mean)))


class _Members:
    """A bitmap of hashed ids; small ones are as small as their ids allow."""

    def __init__(self, ids: DataFrame) -> None:
        n = ids.count()
        log2 = min(MOST_BITS_LOG2, max(LEAST_BITS_LOG2, (64 * n).bit_length()))
        self.bits = 1 << log2
        bit = ids.select(self.bit("doc_id").alias("bit"))
        parts = bit.groupBy(F.shiftright("bit", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << 15) - 1))).alias("part"))
        flat = np.zeros(self.bits // 8, np.uint8)
        for row in parts.collect():  # 4 KB each, self.bits / 2 ** 15 of them
            flat[row.k << 12 : (row.k << 12) + (1 << 12)] = np.frombuffer(row.part, np.uint8)
        self.flat = ids.sparkSession.sparkContext.broadcast(flat)

    def bit(self, column: str):
        return F.xxhash64(column).bitwiseAND(F.lit(self.bits - 1))

    def of(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """(doc_id, column, bit) of docs, for a kernel that calls _some()."""
        return docs.select("doc_id", column, self.bit("doc_id").alias("bit"))


def _some(flat: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose bit is set."""
    bit = batch.column("bit").to_numpy()
    return batch.filter(pa.array((flat[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))


def _prefixes(n: int, num: int, den: int, buckets: int, levels, members):
    """The lowest bit of a token says whether its shingle is common."""

    @lean
    def run(batches):
        (table, common), flat = levels.value, members.value
        for batch in batches:
            batch = _some(flat, batch)
            sizes, parts = np.zeros(len(batch), np.int64), []
            lengths = np.zeros(len(batch) + 1, np.int64)
            for i, h in shingle_sets(batch, "text", n):
                if size := len(h):
                    p = size - -(-num * size // den) + 1
                    level = table[(h & np.uint64(buckets - 1)).view(np.int64)]
                    order = np.argsort(level, kind="stable")[:p]  # of equal levels the smaller hash is first; h is sorted
                    sizes[i], lengths[i + 1] = size, len(order)
                    parts.append(h[order] & ~np.uint64(1) | (level[order] > common).astype(np.uint64))
            flat_tokens = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat_tokens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), tokens], names=["doc", "n", "tokens"])

    return run


def _sets(n: int, members):
    @lean
    def run(batches):
        flat_bits = members.value
        for batch in batches:
            batch = _some(flat_bits, batch)
            parts, lengths = [], np.zeros(len(batch) + 1, np.int64)
            for i, h in shingle_sets(batch, "text", n):
                lengths[i + 1] = len(h)
                parts.append(h)
            flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            sets = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), sets], names=["doc", "tokens"])

    return run


def _members_only(members):
    @lean
    def run(batches):
        flat = members.value
        for batch in batches:
            yield _some(flat, batch).drop_columns(["bit"])

    return run


def _passes(num: int, den: int):
    """Length and positional filters of a pair x, y that share the shingle at px and py of their order."""
    length = f"least(nx, ny) * {den} >= greatest(nx, ny) * {num}"
    position = f"least(nx - px, ny - py) * {num + den} >= (nx + ny) * {num}"
    return F.expr(f"x != y and {length} and {position}")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _verified(docs: DataFrame, sized: DataFrame, pairs: DataFrame, n: int, num: int, den: int, into: list[str]) -> DataFrame:
    """The pairs (a, b) that link. The suffix filter goes first, on the counts in parts of the hash range: shingles
    in common are at most the smaller counts' sum. Sets are made again from the texts of what remains."""
    members = _Members(_ids(pairs))
    hists = members.of(sized, "hist").mapInArrow(_members_only(members.flat), "doc_id long, hist array<int>")
    hists = stored(hists, "hists", into, kernel=True)
    x, y = (hists.select(F.col("doc_id").alias(k), F.col("hist").alias(f"h{k}")) for k in "ab")
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)
    most = total(F.zip_with("ha", "hb", lambda p, q: F.least(p, q)))
    suffix = most * (num + den) >= (total("ha") + total("hb")) * num
    near = stored(pairs.join(x, "a").join(y, "b").where(suffix).select("a", "b"), "near", into)

    members = _Members(_ids(near))
    sets = stored(members.of(docs).mapInArrow(_sets(n, members.flat), "doc long, tokens array<long>"), "sets", into, kernel=True)
    x, y = (sets.select(F.col("doc").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    size, same = F.size("ta") + F.size("tb"), F.size(F.array_intersect("ta", "tb"))
    return near.join(x, "a").join(y, "b").where(same * den >= (size - same) * num).select("a", "b")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (75, 100), buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs, whatever its other columns.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; the set of a document holds its distinct
    n-word shingles. Documents link when intersection / union >= threshold, given as a fraction (num, den).
    component_id is the least doc_id that links reach. A null or blank text has size 0 and links with nothing.
    A null doc_id keeps its size, gets a null component_id and links with nothing. Repeated rows each come
    back; a doc_id with several texts links where any of them does. An empty table gives no rows.
    """
    num, den = threshold
    spark, docs = docs.sparkSession, texts(docs, id_col, text_col)
    profile = stored(docs.mapInArrow(_profile(n, buckets), "doc_id long, n long, fa long, fb long, hist array<int>, block int, counts binary"), "profile", kernel=True)
    sized = profile.where("block is null").select("doc_id", "n", "fa", "fb", "hist")
    classes = sized.where("n > 0 and doc_id is not null").groupBy("n", "fa", "fb").agg(F.min("doc_id").alias("doc_id"))
    levels = _levels(spark, profile, buckets)

    known = docs.where("doc_id is not null")
    members = _Members(classes.select("doc_id").distinct())
    prefixes = members.of(known).mapInArrow(_prefixes(n, num, den, buckets, levels, members.flat), "doc long, n long, tokens array<long>")
    # a place and its document's size are one number, which sorts by place
    entries = prefixes.select("doc", "n", F.posexplode("tokens").alias("p", "token"))
    entries = entries.select("token", "doc", F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.col("n")).alias("pn"))
    common = F.col("token").bitwiseAND(F.lit(1)) == 1
    entries = entries.withColumn("salt", F.when(common, F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(-1))
    # first the documents with the fewest rarer shingles: of near copies those closest to the original
    closest = Window.partitionBy("token", "salt").orderBy("pn", "doc")
    this = F.struct("doc", "pn")
    before = [F.lag(this).over(closest).alias("prev"), F.first(this).over(closest).alias("first")]
    entries = entries.select("token", "doc", "pn", *before, F.lead("doc").over(closest).alias("next"))
    first_round: list[str] = []
    entries = stored(entries.where((F.col("prev").isNotNull()) | (F.col("next").isNotNull()) | common), "entries", first_round, kernel=True)
    # and of a common shingle's entries each meets the first of all parts, which near copies share with each other less than with it
    firsts = entries.where(common).groupBy("token").agg(F.min(F.struct("pn", "doc")).alias("o"))
    whole = entries.where(common).select("token", "doc", "pn").join(firsts, "token").where("doc != o.doc")

    near = entries.where("prev is not null").select("doc", "pn", F.explode(F.array("prev", "first")).alias("o"))
    parts = lambda o, d: f"{o}.doc x, {o}.pn & 4294967295 nx, {o}.pn >> 32 px, {d}doc y, {d}pn & 4294967295 ny, {d}pn >> 32 py".split(", ")
    few = near.selectExpr(*parts("o", "")).union(whole.selectExpr(*parts("o", "")))
    few = stored(few.where(_passes(num, den)).selectExpr("least(x, y) a", "greatest(x, y) b").distinct(), "pairs")
    links = _verified(known, sized, few, n, num, den, first_round)
    stars = stored(components(links), "stars")

    placed = entries.select("token", "doc", "pn").join(stars.selectExpr("node doc", "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = stored(placed, "placed", first_round)
    by_token = Window.partitionBy("token")
    rare = placed.where(~common).select("*", F.min("component").over(by_token).alias("least"), F.max("component").over(by_token).alias("most")).where("least != most").select(*placed.columns)
    torn = placed.where(common).groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("token")
    mixed = rare.union(placed.where(common).join(torn, "token", "left_semi"))
    second_round: list[str] = []
    mixed = stored(mixed.selectExpr("token", "doc", "pn & 4294967295 n", "pn >> 32 p", "component"), "mixed", second_round)
    discard(spark, first_round)
    largest = mixed.groupBy("token", "component").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    index = lambda k: f"p{k} < n{k} - (2 * {num} * n{k} + {num + den - 1}) div {num + den} + 1"  # noqa: E731  of the shorter of two
    x = mixed.join(largest, "token").where("component != main").selectExpr("token", "main", "doc x", "n nx", "p px", "component cx")
    y = mixed.selectExpr("token", "doc y", "n ny", "p py", "component cy")
    met = x.join(y, "token").where(f"cx != cy and (cy = main or x < y) and if(nx < ny or nx = ny and x < y, {index('x')}, {index('y')})").where(_passes(num, den))
    rest = met.selectExpr("least(x, y) a", "greatest(x, y) b").distinct().join(few, ["a", "b"], "left_anti")
    more = _verified(known, sized, stored(rest, "pairs", second_round), n, num, den, second_round)
    whole = stored(components(stars.selectExpr("node a", "component b").union(more)), "components")
    discard(spark, second_round)

    classes = classes.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("n", "fa", "fb", F.coalesce("component", "doc_id").alias("component_id"))
    out = sized.drop("hist").join(classes, ["n", "fa", "fb"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
