"""Delta operators over DataFrames: encode, parse, cursors, and two independent ways to apply.

The kernel path handles whole images in Arrow batches. The relational path explodes triples to the base
blocks they touch and meets those by an equi-join, so one huge image is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import delta as D

BLOCK = 4096


def _grouped(batches, most: int = 64, most_bytes: int = 4 << 20) -> Iterator[list[dict]]:
    """The rows of batches in groups that end at `most` rows or `most_bytes` of blobs, whichever comes first."""
    rows, held = [], 0
    for batch in batches:
        names, columns = batch.schema.names, batch.columns
        for i in range(len(batch)):
            rows.append({name: c[i].as_py() for name, c in zip(names, columns, strict=True)})
            held += sum(len(v) for v in rows[-1].values() if isinstance(v, bytes))
            if len(rows) >= most or held >= most_bytes:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def rowwise(fn: Callable[[dict], Iterator[dict] | list[dict]] | Callable[[list[dict]], Iterator[dict]], schema: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20, together: bool = False):
    """A mapInArrow kernel from a function of a row to rows, or (together) of a group of rows. Input rows are taken one or a
    group at a time; output batches end at `most` rows or `most_bytes` of blobs, whichever comes first."""
    wide = [f.name for f in schema if f.type in (pa.binary(), pa.string())]

    def run(batches):
        rows, held = [], 0
        for group in _grouped(batches, *(() if together else (1,))):
            for out in fn(group if together else group[0]):
                rows.append(out)
                held += sum(len(out.get(w) or b"") for w in wide)
                if len(rows) >= most or held >= most_bytes:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def mapped(df: DataFrame, fn: Callable[[dict], list[dict]] | Callable[[list[dict]], Iterator[dict]], keep: list[str], added: str, together: bool = False) -> DataFrame:
    """df through a row function, or (together) one of groups of rows; the result has the columns `keep` and those of the
    DDL `added`."""
    fields = [(c, t) for c, t in df.dtypes if c in keep] + [tuple(x.split()) for x in added.split(", ")]
    schema = pa.schema([(c, _KINDS[t]) for c, t in fields])
    return df.mapInArrow(rowwise(fn, schema, together=together), ", ".join(f"`{c}` {t}" for c, t in fields))


def encode_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, old, new) -> (pair_id, new_size, delta). A null image counts as empty."""

    def one(row):
        new = row["new"] or b""
        return [{"pair_id": row["pair_id"], "new_size": len(new), "delta": D.encode(row["old"] or b"", new)}]

    return mapped(pairs.select("pair_id", "old", "new"), one, ["pair_id"], "new_size bigint, delta binary")


def parse_triples(deltas: DataFrame) -> DataFrame:
    """(pair_id, new_size, delta) -> one row a triple: pair_id, n, x, y, z, diff, extra. A stream that does not
    parse gives one row with n null and its status and site."""

    def one(row):
        try:
            found = D.triples(row["delta"] or b"", row["new_size"] or 0)
        except D.BadDelta as e:
            return [{"pair_id": row["pair_id"], "status": e.status, "site": e.site}]
        return [{"pair_id": row["pair_id"], "n": n, "x": len(t.diff), "y": len(t.extra), "z": t.seek, "diff": t.diff, "extra": t.extra, "status": 0, "site": 0} for n, t in enumerate(found)]

    return mapped(deltas.select("pair_id", "new_size", "delta"), one, ["pair_id"], "n bigint, x bigint, y bigint, z bigint, diff binary, extra binary, status int, site int")


def cursors(triples: DataFrame) -> DataFrame:
    """triples with newpos and oldpos, where each begins: running sums over those before."""
    before = Window.partitionBy("pair_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return triples.withColumn("newpos", F.coalesce(F.sum(F.col("x") + F.col("y")).over(before), F.lit(0))).withColumn("oldpos", F.coalesce(F.sum(F.col("x") + F.col("z")).over(before), F.lit(0)))


def blocks(images: DataFrame, id_col: str, bytes_col: str, size: int = BLOCK) -> DataFrame:
    """(id_col, block_no, bytes): images cut into blocks."""
    data = F.col(bytes_col)
    last = F.floor((F.octet_length(data) - 1) / size).cast("int")
    cut = images.where(F.octet_length(data) > 0).select(id_col, data.alias("_data"), F.explode(F.sequence(F.lit(0), last)).alias("block_no"))
    return cut.select(id_col, "block_no", F.substring("_data", F.col("block_no") * size + 1, F.lit(size)).alias("bytes"))


def byte_at(data: Column, at: Column) -> Column:
    """The byte at an offset from 0, as a number."""
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def apply_relational(triples: DataFrame, base_blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """(pair_id, image): images rebuilt by joins. triples: as cursors returns them; base_blocks: (pair_id,
    block_no, bytes). Base bytes that no block holds are zero."""
    run = triples.where("x > 0").select("pair_id", "newpos", "oldpos", "x", "diff")
    lowest, highest = F.floor(F.col("oldpos") / size).cast("int"), F.floor((F.col("oldpos") + F.col("x") - 1) / size).cast("int")
    part = run.withColumn("block_no", F.explode(F.sequence(lowest, highest)))
    part = part.withColumn("lo", F.greatest(F.lit(0), F.col("block_no") * size - F.col("oldpos")))
    part = part.withColumn("hi", F.least(F.col("x"), (F.col("block_no") + 1) * size - F.col("oldpos")))
    part = part.withColumn("diff", F.substring("diff", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    met = part.join(base_blocks, ["pair_id", "block_no"], "left")
    start = F.col("oldpos") + F.col("lo") - F.col("block_no") * size
    base = F.coalesce(F.substring("bytes", (start + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), F.lit(b""))
    met = met.withColumn("base", base)
    zero = F.hex("diff").rlike("^0*$") & (F.octet_length("base") == F.octet_length("diff"))
    added = F.transform(F.sequence(F.lit(0), F.octet_length("diff") - 1), lambda i: F.lpad(F.hex((byte_at(F.col("diff"), i) + F.coalesce(byte_at(F.col("base"), i), F.lit(0))) % 256), 2, "0"))
    changed = met.select("pair_id", (F.col("newpos") + F.col("lo")).alias("pos"), F.when(zero, F.col("base")).otherwise(F.unhex(F.array_join(added, ""))).alias("piece"))
    plain = triples.where("y > 0").select("pair_id", (F.col("newpos") + F.col("x")).alias("pos"), F.col("extra").alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("text"))))
    return changed.union(plain).groupBy("pair_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda p: p["text"]), "")).alias("image"))


def apply_kernel(rows: DataFrame) -> DataFrame:
    """(pair_id, old, delta, new_size) -> (pair_id, image, status, site); image is null where status is not 0."""

    def one(row):
        try:
            return [{"pair_id": row["pair_id"], "image": D.apply(row["old"] or b"", row["delta"] or b"", row["new_size"] or 0), "status": 0, "site": 0}]
        except D.BadDelta as e:
            return [{"pair_id": row["pair_id"], "image": None, "status": e.status, "site": e.site}]

    return mapped(rows.select("pair_id", "old", "delta", "new_size"), one, ["pair_id"], "image binary, status int, site int")


def gram_index(images: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(id_col, gram, first_pos): the first place of every gram of an image, as the encoder looks it up: the gram's bytes
    in hex. A kernel a row; nothing is shuffled."""
    kind = dict(images.dtypes)[id_col]
    schema = pa.schema([(id_col, _KINDS[kind]), ("gram", pa.string()), ("first_pos", pa.int64())])
    digits = np.frombuffer("".join(f"{b:02X}" for b in range(256)).encode(), "S2")

    def run(batches):
        for batch in batches:
            ids, blobs = batch.columns
            for i in range(len(batch)):
                keys, first = D.first_grams(blobs[i].as_py() or b"")
                for lo in range(0, len(keys), 1 << 18):
                    part = keys[lo : lo + (1 << 18)]
                    text = digits[part.astype("<u8").view(np.uint8)].tobytes()
                    grams = pa.StringArray.from_buffers(len(part), pa.py_buffer(np.arange(len(part) + 1, dtype=np.int32) * 2 * D.GRAM), pa.py_buffer(text))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * len(part), schema[0].type), grams, pa.array(first[lo : lo + (1 << 18)].astype(np.int64))], schema=schema)

    return images.select(id_col, bytes_col).mapInArrow(run, f"`{id_col}` {kind}, gram string, first_pos bigint")
