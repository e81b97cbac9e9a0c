"""Sessions on streams.

advance() keeps one state a device, of the eleven that sessions have, and how many bytes of output it has made. Header,
validate and alloc are passed within a begin, apply and writeback within a step, commit within a finish: a micro-batch
ends between calls, so a device rests in idle, decode, verify, done or failed.
publish_once() runs whole sessions on each micro-batch of offers and appends to a ledger what is new there, so
that a batch that is replayed after a failure publishes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "device_id long, state string, position long, status int, site int, passed array<string>"
STATE = "state string, position long, new_size long, block long, status int, site int"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events in order of seq: begin (new_size, block; n other than 0: the status that its checks end in), step (n blocks),
    abort, finish (n other than 0: the commit hook refuses). Begin is valid in idle, done and failed. Steps and finish
    in done change nothing; anything else out of turn fails with -2 at site 32. Abort fails with -15 at site 29,
    a refusal with -16 at site 31. A failed session stays failed until it begins anew. passed: the states that the events
    went through, in order, a round of steps once."""
    now, position, new_size, block, status, site = state.get if state.exists else ("idle", 0, 0, 1, 0, 0)
    events = pd.concat(list(batches)).sort_values("seq", kind="stable")
    passed: list[str] = []

    def to(*states: str) -> str:
        passed.extend(states)
        return states[-1]

    for kind, n, size, width in zip(events["kind"], events["n"], events["new_size"], events["block"], strict=True):
        if kind == "begin" and now not in ("decode", "verify"):
            position, new_size, block, status, site = 0, int(size), max(int(width), 1), int(n), 0
            now = to("header", "validate", "failed") if status else to("header", "validate", "alloc", "decode")
        elif now == "failed" or now == "done" and kind in ("step", "finish"):
            continue
        elif kind == "abort" and now == "decode":
            now, status, site = to("failed"), -15, 29
        elif kind == "step" and now == "decode":
            position = min(position + int(n) * block, new_size)
            now = to("apply", "writeback", "verify" if position == new_size else "decode")
        elif kind == "finish" and now == "verify":
            now, status, site = (to("commit", "failed"), -16, 31) if n else (to("commit", "done"), 0, 0)
        else:
            now, status, site = to("failed"), -2, 32
    state.update((now, position, new_size, block, status, site))
    yield pd.DataFrame({"device_id": [key[0]], "state": [now], "position": [position], "status": [status], "site": [site], "passed": [passed]})


def advance(events: DataFrame) -> DataFrame:
    """A stream of (device_id, seq, kind, n, new_size, block) -> the state of each device that had events."""
    filled = events.select("device_id", "seq", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("new_size", F.lit(0)).alias("new_size"), F.coalesce("block", F.lit(1)).alias("block"))
    return filled.groupBy("device_id").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def publish_once(run: Callable[[DataFrame], DataFrame], ledger: str, key: tuple[str, ...] = ("device_id", "session_id")) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: run(batch) gives session rows with status; those that ended well and are not in the
    ledger (a Parquet path) are appended to it under the batch's number, which is overwritten on a replay."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = run(rows).where("status = 0").dropDuplicates(list(key))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(ledger)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(root):
            before = spark.read.option("basePath", ledger).parquet(ledger).where(F.col("batch") != number)
            done = done.join(before.select(*key), list(key), "left_anti")
        done.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return batch
