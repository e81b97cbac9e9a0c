"""Dictionary-compressed WARC archives (.warc.zst): a writer and a reader.

An archive begins with a skippable frame that holds a Zstandard dictionary built from the records at the
head of that archive; every record follows as a frame of its own, so any one can be read alone by its
offset. Equal payloads are stored once: the record with the least id is a response, the others are
revisits without payload that name it.

Archives are written by the executors straight to shared storage, one at a time per task, under names that
no other attempt uses; only those listed by tasks that ended count, so lost executors and speculative
attempts leave no trace in the result.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_store, scratch, stored

SKIPPABLE = 0x184D2A5D  # fixed value: the magic number of a dictionary frame
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # the dictionary is built from this much of an archive's first records
ARCHIVE_BYTES = 256 << 20  # an archive that has grown past this is closed
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, intact boolean"


def _record_id(digest: str, page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{digest}/{page_id}/{row}')}>"


def record(page_id: int | None, url: str | None, row: int, payload: bytes | None, size: int, digest: str, first: tuple[int | None, int] | None) -> bytes:
    """One WARC/1.1 record. A response holds the HTTP head and the payload; a revisit, which names the
    (page_id, row) of its response as first, the head alone. size is the payload's in both."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if first else payload)
    head = {
        "WARC-Type": "revisit" if first else "response",
        "WARC-Record-ID": _record_id(digest, page_id, row),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if first else None,
        "WARC-Refers-To": _record_id(digest, *first) if first else None,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": first[0] if first else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """One archive. Records are held until there is enough of them to build the dictionary from."""

    def __init__(self, path: str) -> None:
        fs, where = open_store(path)
        fs.create_dir(posixpath.dirname(where), recursive=True)
        self.out, self.held, self.size, self.written, self.compress = fs.open_output_stream(where, compression=None), [], 0, 0, None

    def _begin(self) -> None:
        samples = [x[:SAMPLE_BYTES] for x in self.held]
        try:
            words = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: the records themselves are the dictionary
            words = b"".join(samples)[-DICTIONARY_BYTES:]
        packed = zstandard.ZstdCompressor(level=19).compress(words)
        self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
        for x in self.held:
            self._put(self.compress.compress(x))
        self.held = []

    def _put(self, x: bytes) -> None:
        self.out.write(x)
        self.written += len(x)

    def add(self, x: bytes) -> None:
        if self.compress:
            self._put(self.compress.compress(x))
            return
        self.held.append(x)
        self.size += len(x)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> None:
        if not self.compress:
            self._begin()
        self.out.close()


def records(path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive, one frame in memory at a time."""
    fs, where = open_store(path)
    with fs.open_input_stream(where, compression=None, buffer_size=1 << 20) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame")
        words, at = zstandard.ZstdDecompressor().decompress(f.read(n)), 8 + n
        expand, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), b""
        while rest or (rest := f.read(1 << 20)):
            frame, parts, used = expand.decompressobj(), [], 0
            while True:
                parts.append(frame.decompress(rest))
                used += len(rest)
                if frame.eof:
                    rest = frame.unused_data
                    used -= len(rest)
                    break
                if not (rest := f.read(1 << 20)):
                    raise ValueError(f"{path}: the frame at {at} is cut off")
            yield at, b"".join(parts)
            at += used


def parsed(x: bytes) -> dict:
    """What a record says, and whether it holds together: lengths, and of a response the digest."""
    head, _, rest = x.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    said = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(said["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, revisit = said["WARC-Payload-Digest"].removeprefix("sha1:"), said["WARC-Type"] == "revisit"
    sound = first == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and (payload == b"" if revisit else len(payload) == size and _base32(hashlib.sha1(payload).digest()) == digest)
    number = lambda k: int(said[k]) if k in said else None
    return {"page_id": number("X-Page-ID"), "url": said.get("WARC-Target-URI"), "record_type": said["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload, "intact": sound}


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _write(folder: str):
    def run(batches):
        made, writer = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    made.append(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                    writer = Writer(made[-1])
                first = (row["refers_to"], row["refers_row"]) if row["revisit"] else None
                writer.add(record(row["page_id"], row["url"], row["row"], row["payload"], row["size"], _base32(bytes.fromhex(row["digest"])), first))
                if writer.written >= ARCHIVE_BYTES:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes one record a row under folder and returns (archive), the paths written.

    The payload is the column in UTF-8, null meaning empty. Of equal payloads of at least least_bytes bytes
    the one with the least id is the response (a null id comes last; of repeated rows one is); the others
    are revisits of it. Shorter payloads are all responses. An empty table writes no archive.
    """
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id())  # the scan deals rows alike each time
    least = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")).alias("first")
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(least)
    joined = rows.join(first, "digest", "left")
    revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    out = joined.select("page_id", "url", "row", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "digest", revisit.alias("revisit"), F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row"))
    return stored(out.mapInArrow(_write(folder), "archive string"), "archives")


def _read(batches):
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[c.split(" ")[1]]) for n, c in zip(names, RECORD.split(", "), strict=True)])
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            rows, held = [], 0
            for at, x in records(path):
                rows.append(parsed(x) | {"archive": path, "offset": at})
                held += len(x)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(archives: DataFrame) -> DataFrame:
    """All records of the archives (a column of paths): page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (null for a revisit), archive, offset, and whether lengths and digest agree."""
    return archives.select("archive").mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives pages in the shared folder and reads the records back."""
    return read_warc(write_warc(pages, scratch(pages.sparkSession, "warc"), **options))
