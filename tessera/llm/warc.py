"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A bundle ends with two skippable frames:
a record index (record identifier -> frame, offset in the frame, length) and the seek table of the
seekable format (compressed and plain size of each frame, then a footer), so one record costs one
frame to read. Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the
largest identifier is the response and the others are revisits of it.

Executors write bundles to the shared folder under names of their task attempt; only bundles in
the manifest, a table of what committed tasks wrote, are read back.

Defined results: a null payload is empty; a null url leaves the target out; a null identifier is
archived under "null" and is never the response that others refer to; repeated rows of one
identifier with equal payloads are each response; an empty table gives no bundle and no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, fresh_dir, sliced, written

#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")

MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("frames", pa.int64()), ("bytes", pa.int64())])
RECORDS = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RECORDS_DDL = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(number: int | None, url: str | None, payload: bytes, digest: str, size: int, head: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit of ``head`` with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if head is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if head is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if number is None else number}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if head is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{head}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class BundleWriter:
    """Writes records to one seekable bundle."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.sizes, self.index, self.bytes = bytearray(), [], [], 0

    def add(self, key: str, data: bytes) -> None:
        if self.frame and len(self.frame) + len(data) > self.frame_bytes:
            self.flush()
        self.index.append((key, len(self.sizes), len(self.frame), len(data)))
        self.frame += data

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def flush(self) -> None:
        if self.frame:
            packed = self.compressor.compress(bytes(self.frame))
            self.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        index = zstandard.ZstdCompressor(level=3).compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 4) + index + struct.pack("<I", len(index)))
        self.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.sizes), 0, SEEKABLE))
        self.out.close()


class BundleReader:
    """Reads records of a seekable bundle by way of its footer."""

    def __init__(self, file, size: int):
        self.file = file
        frames, _, magic = FOOTER.unpack(self.at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = size - FOOTER.size - 8 * frames
        sizes = [struct.unpack_from("<II", self.at(table, 8 * frames), 8 * k) for k in range(frames)]
        end = table - 8
        (length,) = struct.unpack("<I", self.at(end - 4, 4))
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(self.at(end - 4 - length, length)))
        self.places, start = [], 0
        for packed, plain in sizes:
            self.places.append((start, packed, plain))
            start += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            start, packed, plain = self.places[k]
            self.last = k, zstandard.ZstdDecompressor().decompress(self.at(start, packed), max_output_size=plain)
        return self.last[1]

    def records(self) -> Iterator[bytes]:
        for _, k, offset, length in self.index:
            yield self.frame(k)[offset : offset + length]

    def fetch(self, key: str) -> bytes | None:
        """One record by its identifier, with one frame read."""
        for name, k, offset, length in self.index:
            if name == key:
                return self.frame(k)[offset : offset + length]
        return None


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record, and its HTTP body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    headers |= {f"http:{k}": v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return headers, body


def opened(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where, inner


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, bundle_bytes: int = 256 << 20, frame_bytes: int = 1 << 18, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives every row; gives the manifest: path, records, frames, bytes of each bundle."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # payloads that several rows share, by digest: counted before anything meets
    heads = rows.where(f"size >= {int(revisit_bytes)} and id is not null").select("digest", "id").groupBy("digest").agg(F.max("id").alias("head"), F.min("id").alias("least")).where("head > least").select("digest", "head")
    # null ids may copy a payload too
    marked = rows.join(heads, "digest", "left").select("id", "url", F.when(F.col("head").isNull() | (F.col("head") == F.col("id")), F.col("payload")).alias("payload"), "digest", "size", F.when(F.col("head") != F.coalesce("id", F.lit(-(2**63))), F.col("head")).alias("refers_to"))
    folder = fresh_dir(spark, "warc")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        where, inner = opened(folder)
        done, writer, path = [], None, ""
        def close() -> None:
            writer.close()
            done.append((path, len(writer.index), len(writer.sizes), writer.bytes))
        for b in batches:
            for number, url, payload, digest, size, head in zip(*(c.to_pylist() for c in b.columns)):
                if writer is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.zst"
                    path, writer = f"{folder}/{name}", BundleWriter(where.open_output_stream(f"{inner}/{name}", compression=None), frame_bytes)
                writer.add(str(number), record(number, url, (payload or "").encode("utf-8", "surrogatepass"), digest, size, head, date))
                if writer.bytes > bundle_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield batch(MANIFEST, **{f.name: x for f, x in zip(MANIFEST, zip(*done))})

    return written(marked.mapInArrow(run, "path string, records long, frames long, bytes long"), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per archived record: id, payload_bytes, payload_digest, record_type, refers_to, read from the bundles.
    The payload of a response is hashed again and must have the digest that its header states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, inner = opened(path)
                rows: list[tuple] = []
                with where.open_input_file(inner) as file:
                    for data in BundleReader(file, file.size()).records():
                        headers, body = parse(data)
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {path}")
                        number = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                        refers = headers.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                        rows.append((None if number == "null" else int(number), int(headers["http:Content-Length"]), digest, kind, int(refers) if refers else None))
                        if len(rows) >= 4096:
                            yield batch(RECORDS, **{f.name: x for f, x in zip(RECORDS, zip(*rows))})
                            rows = []
                if rows:
                    yield batch(RECORDS, **{f.name: x for f, x in zip(RECORDS, zip(*rows))})

    return manifest.select("path").mapInArrow(run, RECORDS_DDL)


def fetch(path: str, key: str) -> tuple[dict[str, str], bytes] | None:
    """Headers and body of one record of a bundle, by one seek."""
    where, inner = opened(path)
    with where.open_input_file(inner) as file:
        data = BundleReader(file, file.size()).fetch(key)
    return parse(data) if data is not None else None
