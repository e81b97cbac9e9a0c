"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables cuts HASHES Gaussian projections of a vector into cells of width WIDTH times the data's
scale. A query visits its own bucket and then perturbed ones, one step up or down in some projections, in
the order of their estimated success (Lv et al., 2007); the rows of the visited buckets of all tables are
merged and ranked by exact distance.

Equal vectors are one entry with the few least ids that can ever be returned, and equal queries are asked once,
so a vector that a third of all rows share costs what any other does. Entries are indexed where they lie: a task
keeps, for a block of them, the members of each table's buckets, and lets the distinct queries, written once to
the shared folder, stream past. Distances are measured for the members of visited buckets alone, in double
precision on the original components, and only each block's best entries a query are shuffled.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_store, stored

TABLES, HASHES, PROBES, WIDTH = 28, 10, 300, 1.25
SAMPLE = 512  # rows, those whose ids have the least hashes, whose median distance is the scale
ROWS, QUERIES = 1 << 17, 256  # entries indexed and queries read at a time


def probe_order(hashes: int, probes: int) -> np.ndarray:
    """The first `probes` perturbations as 0/1 rows over 2 * hashes steps, the steps sorted by a query's
    distance to the cell walls: sets of steps by their expected squared distance, never both ways at once."""
    m = hashes
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, steps = heapq.heappop(heap)
        if not any(2 * m - 1 - s in steps for s in steps):
            out.append(steps)
        last = steps[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*steps[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*steps, last + 1)))
    rows = np.zeros((len(out), 2 * m), np.int64)
    for i, steps in enumerate(out):
        rows[i, list(steps)] = 1
    return rows


class Index:
    """The hash functions; picklable and small."""

    def __init__(self, dim: int, scale: float, tables: int, hashes: int, probes: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.width = (scale or 1.0) * WIDTH
        self.lines = rng.standard_normal((tables, dim, hashes))
        self.shift = rng.uniform(0, self.width, (tables, hashes))
        self.factor = rng.integers(1, 1 << 62, (tables, hashes)) | 1
        self.order = probe_order(hashes, probes)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.lines[table] + self.shift[table]) / self.width

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        return (np.floor(self.cells(x, table)).astype(np.int64) * self.factor[table]).sum(1)

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """[query, probe] buckets, the likeliest first."""
        at = self.cells(x, table)
        cell = np.floor(at)
        down = at - cell
        rank = np.argsort(np.concatenate([down, 1 - down], axis=1), axis=1, kind="stable")
        step = np.concatenate([-self.factor[table], self.factor[table]])[rank]
        return (cell.astype(np.int64) * self.factor[table]).sum(1)[:, None] + step @ self.order.T


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _query_blocks(files: list[str]):
    for path in files:
        fs, where = open_store(path)
        with fs.open_input_file(where) as f:
            for batch in pq.ParquetFile(f).iter_batches(QUERIES, columns=["qkey", "v"]):
                if len(batch):
                    yield batch.column("qkey").to_numpy(), _matrix(batch, "v")


class Block:
    """Entries x, each with its ascending ids, and for every table their order by bucket."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, starts: np.ndarray, index: Index | None) -> None:
        self.x, self.ids, self.starts, self.index, self.tables = x, ids, starts, index, []
        for t in range(len(index.lines) if index else 0):
            bucket = index.buckets(x, t)
            order = np.argsort(bucket, kind="stable")
            keys, first = np.unique(bucket[order], return_index=True)
            self.tables.append((keys, np.append(first, len(x)), order.astype(np.int32)))

    def members(self, probes: list[np.ndarray]) -> np.ndarray:
        """Entries in the buckets that one query visits, probes[t] in table t."""
        if self.index is None:
            return np.arange(len(self.x))
        near = np.zeros(len(self.x), bool)
        for (keys, first, order), wanted in zip(self.tables, probes, strict=True):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = np.unique(at[keys[at] == wanted])
            sizes = first[hit + 1] - first[hit]
            near[order[np.arange(sizes.sum()) + np.repeat(first[hit] - np.cumsum(sizes) + sizes, sizes)]] = True
        return np.flatnonzero(near)

    def best(self, q: np.ndarray, probes: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances): the k nearest ids found, ties to the smaller id, each once."""
        some = self.members(probes)
        if not len(some):
            return self.ids[:0], np.zeros(0)
        score = np.sqrt(((self.x[some] - q) ** 2).sum(axis=1))
        most = k
        while True:
            part = np.arange(len(some)) if len(some) <= most else np.flatnonzero(score <= np.partition(score, most - 1)[most - 1])
            lengths = (self.starts[1:] - self.starts[:-1])[some[part]]
            ids = np.concatenate([self.ids[self.starts[e] : self.starts[e + 1]] for e in some[part]])
            scores = np.repeat(score[part], lengths)
            order = np.lexsort((ids, scores))
            ids, scores = ids[order], scores[order]
            _, once = np.unique(ids, return_index=True)
            if len(once) >= k or len(part) == len(some):  # an id may stand for several vectors
                keep = np.sort(once)[:k]
                return ids[keep], scores[keep]
            most *= 4


def _search(index: Index | None, files: list[str], k: int):
    def found(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = [b.column("ids") for b in batches]
        starts = np.cumsum([0, *(n for c in ids for n in c.value_lengths().to_pylist())])
        block = Block(np.concatenate([_matrix(b, "v") for b in batches]), np.concatenate([c.flatten().to_numpy() for c in ids]), starts, index)
        rows = []
        for keys, q in _query_blocks(files):
            probes = [index.probes(q, t) for t in range(len(index.lines))] if index else []
            for i, key in enumerate(keys.tolist()):
                rows.append((key, *block.best(q[i], [p[i] for p in probes], k)))
        sizes = [len(near) for _, near, _ in rows]
        query = np.repeat([key for key, *_ in rows], sizes).astype(np.int64)
        flat = lambda i, kind: np.concatenate([r[i] for r in rows]).astype(kind) if rows else np.zeros(0, kind)
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(flat(1, np.int64)), pa.array(flat(2, np.float64))], names=["qkey", "vec_id", "score"])

    def run(batches):
        held, n = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo in range(0, len(batch), ROWS):
                    held.append(batch.slice(lo, ROWS))
                    n += len(held[-1])
                    if n >= ROWS:
                        yield found(held)
                        held, n = [], 0
            if n:
                yield found(held)

    return run


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors[vector_col]
    if dict(vectors.dtypes)[vector_col] != "array<float>":
        v = v.cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))
    return rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): every different vector with the k least of its ids, ascending. Of a vector's ids only k a task travel."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def scale_of(held: DataFrame) -> float:
    """The median distance between the SAMPLE entries whose first ids have the least hashes."""
    some = np.array([r.v for r in held.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0], "v").limit(SAMPLE).collect()], float)
    apart = np.sqrt(((some[:, None] - some[None]) ** 2).sum(-1))[np.triu_indices(len(some), 1)]
    return float(np.median(apart[apart > 0])) if (apart > 0).any() else 1.0


def nearest(vectors: DataFrame, queries: str = "pmod(vec_id, 100) = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row that the condition `queries` on vec_id selects, the k
    found rows at the smallest Euclidean distance, nearest first, ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors
    of different lengths are searched apart, each length among its own (lengths are expected to be few). A row is no
    candidate of its own vec_id; of rows that repeat a vec_id the nearest counts, and as a query the least vector.
    Without valid rows the result is empty. Queries for which hashing finds fewer than k rows are held against
    all rows.
    """
    spark, rows = vectors.sparkSession, _valid(vectors, id_col, vector_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sorted(r.dim for r in rows.groupBy(F.size("v").alias("dim")).count().collect())
    # as a query, a vec_id with several vectors counts with its least one, whatever the lengths
    asked_all = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    if len(lengths) > 1:
        asked_all = stored(asked_all, "asked")
    for n, dim in enumerate(lengths):
        one = _nearest(rows.where(F.size("v") == dim), asked_all.where(F.size("v") == dim), dim, k, tables, hashes, probes)
        out = out.union(one) if n else one
    return out


def _nearest(rows: DataFrame, asked: DataFrame, dim: int, k: int, tables: int, hashes: int, probes: int) -> DataFrame:
    held = stored(entries(rows, k + 1), "entries")
    asked = stored(asked, "queries")
    keys = stored(asked.groupBy("v").agg(F.min("vec_id").alias("qkey")), "keys")
    index = Index(dim, scale_of(held), tables, hashes, probes)

    def found(index: Index | None, some: DataFrame) -> DataFrame:
        hits = held.mapInArrow(_search(index, sorted(some.inputFiles()), k + 1), "qkey long, vec_id long, score double")
        nth = F.row_number().over(Window.partitionBy("qkey").orderBy("score", "vec_id"))
        best = hits.groupBy("qkey", "vec_id").agg(F.min("score").alias("score")).withColumn("nth", nth).where(F.col("nth") <= k + 1)
        return best.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))

    hashed = stored(found(index, keys), "found")
    short = stored(keys.join(hashed.where(F.size("near") > k), "qkey", "left_anti"), "short")
    if short.limit(1).count():  # too few were hashed together: all entries are compared
        hashed = hashed.where(F.size("near") > k).unionByName(found(None, short))
    of = asked.join(keys, "v").select(F.col("vec_id").alias("query_id"), "qkey")
    near = of.join(hashed, "qkey").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    ranked = near.select("query_id", F.posexplode("near").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
