"""Dictionary-compressed WARC archives.

A file begins with a skippable Zstandard frame that holds the dictionary; each record follows as a frame of its own,
compressed with that dictionary, so that any record can be read from its offset. The dictionary is built for each file
from its first `SAMPLE_BYTES` of records; a file whose sample is too small for one has no dictionary frame.

Of records with equal payloads (at least `min_bytes` long) the one with the smallest id is a response, the others are
revisits that refer to it and carry no payload. Payloads are compared by SHA-1 and length; only narrow rows are
shuffled by digest, the payloads go once to the task that writes them, by id.

Each task writes through pyarrow's file systems into one shared folder, under a name of its own attempt, and returns
the file's name in a manifest. Files of attempts that failed stay out of the manifest, so a lost executor leaves no
wrong record. A file ends at `FILE_BYTES`.

Defined results: null payload is empty; records of equal id and payload are one response and revisits to that id; null
ids come last; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, scratch_path, table

SKIPPABLE = 0x184D2A5D
DICT_BYTES = 32_768
SAMPLE_BYTES = 1_000_000
FILE_BYTES = 256_000_000
LEVEL = 3
MANIFEST = "path string, records long, bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(rid: int | None, uri: str, payload: bytes, sha1: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit's block is empty; its digest and length are those of the full payload."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{rid} {uri} {sha1} {revisit}')}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-ID: {rid}"] if rid is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        *([f"X-Refers-To-Page-ID: {refers}"] if revisit and refers is not None else []),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its block")
    return fields, rest[:n]


def build_dictionary(records: list[bytes]) -> bytes | None:
    """None if there is too little to learn from."""
    if len(records) < 8 or sum(map(len, records)) < 8 * 1024:
        return None
    try:
        return zstd.train_dictionary(min(DICT_BYTES, sum(map(len, records)) // 8), records, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return None


class Writer:
    """One archive file."""

    def __init__(self, out):
        self.out, self.held, self.held_bytes, self.coder, self.records, self.bytes = out, [], 0, None, 0, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.coder:
            self._put(self.coder.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        words = build_dictionary(self.held)
        if words:
            self._put(struct.pack("<II", SKIPPABLE, len(words)) + words)
        known = zstd.ZstdCompressionDict(words) if words else None
        self.coder = zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        for data in self.held:
            self._put(self.coder.compress(data))
        self.held = []

    def close(self) -> None:
        if not self.coder:
            self._begin()
        self.out.close()


def read(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    data, known, first = b"", None, True
    coder = None
    while True:
        if first:
            data = stream.read(8)
            magic, n = struct.unpack("<II", data) if len(data) == 8 else (0, 0)
            if magic == SKIPPABLE:
                known, data = zstd.ZstdCompressionDict(stream.read(n)), b""
            first = False
            maker = zstd.ZstdDecompressor(dict_data=known)
        coder, parts = coder or maker.decompressobj(), []
        while not coder.eof:
            data = data or stream.read(block)
            if not data:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(coder.decompress(data))
            data = coder.unused_data if coder.eof else b""
        yield b"".join(parts)
        coder = None


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(rows: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """rows: id, uri, payload, refers, revisit, by task and in order of id. Returns the manifest, already computed."""

    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/{TaskContext.get().taskAttemptId():012d}-{uuid.uuid4().hex[:8]}"
        done: list[tuple[str, int, int]] = []
        w, path, last = None, "", None
        for batch in batches:
            for rid, uri, payload, refers, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w is None:
                    path = f"{name}-{len(done):05d}.warc.zst"
                    w = Writer(store.open_output_stream(path))
                sha1 = digest(payload)
                again = last == (rid, sha1) and len(payload) >= min_bytes  # a repeated row of the first one
                last = (rid, sha1)
                revisit = revisit or again
                w.add(record(rid, (uri or "").replace("\r", "%0D").replace("\n", "%0A"), payload, sha1, refers if refers is not None else rid, revisit))
                if w.bytes >= FILE_BYTES:
                    w.close()
                    done.append((path, w.records, w.bytes))
                    w = None
        if w:
            w.close()
            done.append((path, w.records, w.bytes))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return checkpointed(rows.mapInArrow(write_batches, MANIFEST))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records in the manifest's files."""

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, n, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, got = [], 0
                with store.open_input_stream(path) as stream:
                    for data in read(stream):
                        f, body = parse(data)
                        sha1 = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = f["WARC-Type"] == "revisit"
                        if not revisit and (digest(body) != sha1 or len(body) != int(f["X-Payload-Length"])):
                            raise ValueError(f"a payload of {path} differs from its digest")
                        whole = lambda k: int(f[k]) if k in f else None
                        rows.append((whole("X-Page-ID"), int(f["X-Payload-Length"]), sha1, "revisit" if revisit else "response", whole("X-Refers-To-Page-ID")))
                        got += 1
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                            rows = []
                if got != n:
                    raise ValueError(f"{path} has {got} records of {n}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    spread = manifest.repartition(max(manifest.count(), 1), "path")  # one row a file
    return spread.mapInArrow(read_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, page_id: str, uri: str, payload: str, min_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages to archives; returns their manifest and the folder (a new one beside the checkpoints if none is
    named)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    html: Column = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    df = pages.select(F.col(page_id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), html.alias("payload"))
    df = df.withColumn("sha1", F.sha1("payload"))
    df = df.withColumn("k", F.coalesce("id", F.lit(2**63 - 1)))  # null ids come last
    narrow = df.filter(F.length("payload") >= min_bytes).select("id", "k", "sha1", F.length("payload").alias("n"))
    first = narrow.groupBy("sha1", "n").agg(F.min("id").alias("refers"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    later = narrow.join(first, ["sha1", "n"]).filter("k > refers").select("k", "sha1", "refers").distinct()
    rows = df.repartition("k", "sha1").join(later, ["k", "sha1"], "left").sortWithinPartitions("k", "sha1")
    rows = rows.select("id", "uri", "payload", "refers", F.col("refers").isNotNull().alias("revisit"))
    return write_archives(rows, folder, min_bytes), folder


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(*archive(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
