"""Files of codec vectors: a count, then for each vector three lengths and properties, data and plain text, little-endian."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from ..operators.delta import mapped


def vector_file(vectors: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """The bytes of a file of (props, data, plain)."""
    parts = [struct.pack("<III", *map(len, v)) + b"".join(v) for v in vectors]
    return struct.pack("<I", len(vectors)) + b"".join(parts)


def read_vectors(files: DataFrame) -> DataFrame:
    """files (path, blob) -> (path, n, props, data, plain, sound): a row a vector. Where a file ends too soon a last row with
    sound false and nulls says so; bytes after the last vector are ignored."""

    def one(row):
        blob, path = row["blob"] or b"", row["path"]
        bad = {"path": path, "sound": False}
        if len(blob) < 4:
            return [bad | {"n": 0}]
        at, out = 4, []
        for n in range(int.from_bytes(blob[:4], "little")):
            if at + 12 > len(blob) or at + 12 + sum(sizes := struct.unpack_from("<III", blob, at)) > len(blob):
                return [*out, bad | {"n": n}]
            a = at + 12
            b, c, at = a + sizes[0], a + sizes[0] + sizes[1], a + sum(sizes)
            out.append({"path": path, "n": n, "props": blob[a:b], "data": blob[b:c], "plain": blob[c:at], "sound": True})
        return out

    return mapped(files.select("path", "blob"), one, ["path"], "n bigint, props binary, data binary, plain binary, sound boolean")
