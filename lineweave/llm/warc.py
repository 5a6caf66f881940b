"""Seekable Zstandard WARC bundles: independent frames, a seek table in the footer, offsets within frames.

A bundle is a file of Zstandard frames, each of about FRAME_BYTES of records, and a skippable frame that holds the
seek table of the published seekable format (compressed and uncompressed size of every frame), so that any reader can
find a frame without reading those before it. The index maps each record to (file, frame, offset within the frame).

Equal payloads of at least `least` bytes: the record with the smallest id is the response, the others are revisits
that refer to it and carry no payload, but its digest and length.

Defined cases: a null payload is empty; a null url is empty; rows that repeat an id and its payload are all
responses if the id is the smallest; a row without an id is a revisit if any row with an id has its payload, else a
response; a very long payload is a frame of its own, held in memory whole by one task; an empty table gives no files.
Columns other than the three named ones are ignored, whatever their names. Files of failed attempts are in no index; they
go with the folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

FRAME_BYTES = 1 << 18
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Records are dated by the caller, so that reruns write equal bytes.
DATE = "2024-01-01T00:00:00Z"
URN = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record: a response, or a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """(WARC headers, HTTP head, payload, end) of the record at an offset within an uncompressed frame."""
    stop = frame.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in frame[at:stop].decode().split("\r\n")[1:])
    block = frame[stop + 4 : stop + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, http, payload, stop + 4 + len(block) + 4


class BundleWriter:
    """Groups records into frames; `add` returns (frame, offset within it), `close` appends the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes, self.table, self.records = out, frame_bytes, [], io.BytesIO()
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        if self.records.tell() >= self.frame_bytes:
            self._flush()
        place = len(self.table), self.records.tell()
        self.records.write(data)
        return place

    def _flush(self) -> None:
        if raw := self.records.getvalue():
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw)))
            self.records = io.BytesIO()

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of every frame, read from the footer of an open file."""
    size = file.size() if hasattr(file, "size") else file.seek(0, 2)
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    sizes, at, out = struct.iter_unpack("<II", file.read(8 * n)), 0, []
    for packed, raw in sizes:
        out.append((at, packed, raw))
        at += packed
    return out


def _writer(folder: str):
    def run(batches):
        out = writer = name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:  # a name of its own for every attempt: the index of the attempt that counts names its file
                name = f"{uuid.uuid4().hex}.warc.zst"
                fs, path = pafs.FileSystem.from_uri(folder)
                fs.create_dir(path, recursive=True)
                writer = BundleWriter(out := fs.open_output_stream(f"{path}/{name}", compression=None))
            places = [writer.add(record(i, u or "", (h or "").encode(), r)) for i, u, h, r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([name] * len(places)), pa.array([f for f, _ in places], pa.int32()), pa.array([o for _, o in places], pa.int64())], ["page_id", "file", "frame", "offset"])
        if writer is not None:
            writer.close()

    return run


def write_bundles(spark: SparkSession, pages: DataFrame, folder: str, s: Scratch, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the bundles into folder and returns their index: page_id, file, frame, offset.

    The first id of a payload comes from a partial aggregation over (SHA-256, length); the join back is a skew join
    that Spark may split, and only carries payloads in one direction. Payloads that occur once need no join partner.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("key", F.sha2(body, 256))
    first = rows.filter(F.octet_length(body) >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = s.write(first, "first")  # written first, so that the rows of a very common payload can be split over tasks
    named = rows.join(first, "key", "left").withColumn("first_id", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    index = s.write(named.select("page_id", "url", "html", "first_id").mapInArrow(_writer(folder), "page_id long, file string, frame int, offset long"), "index")
    s.keep(index)
    return index


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(text) if text else None


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        zstd = zstandard.ZstdDecompressor()
        file = opened = None
        for batch in batches:
            for name, frame, offsets in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "offsets"))):
                if name != opened:  # rows come sorted by file, whose seek table is read once
                    if file is not None:
                        file.close()
                    file, opened = fs.open_input_file(f"{path}/{name}"), name
                    table = seek_table(file)
                at, packed, raw = table[frame]
                file.seek(at)
                data = zstd.decompress(file.read(packed), max_output_size=raw)
                rows = []
                for offset in sorted(offsets):
                    head, http, payload, _ = parse(data, offset)
                    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(http.decode().rsplit("Content-Length: ", 1)[1])
                    if kind == "response" and (len(payload) != length or digest(payload) != stated):
                        raise ValueError(f"{name}: record at frame {frame}, offset {offset} is damaged")
                    rows.append((_number(head["WARC-Record-ID"]), length, stated, kind, _number(head.get("WARC-Refers-To")), head["WARC-Target-URI"]))
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))), schema)
        if file is not None:
            file.close()

    return run


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Reads the indexed records back, file by file and frame by frame: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url. Responses are checked against their stated digest and length. A file is what one task
    wrote, so that files are of about one size."""
    frames = index.repartition("file").groupBy("file", "frame").agg(F.collect_list("offset").alias("offsets"))  # as many as fit in one frame
    frames = frames.sortWithinPartitions("file", "frame")
    return frames.mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages to bundles in the shared folder and reads them back by their index."""
    s = Scratch(spark, "warc")
    folder = f"{s.path}/bundles"
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    return read_bundles(write_bundles(spark, pages, folder, s), folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, upper(sha1(body)) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    list_sum(list_transform(range(5 * i, 5 * i + 5), lambda b: ((strpos('0123456789ABCDEF', substr(hex, 1 + b // 4, 1)) - 1) >> (3 - b % 4)::INT & 1) << (4 - b % 5)::INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""
