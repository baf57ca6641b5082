"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a
footer: a skippable frame with the seek table of the public seekable format (compressed and
uncompressed size of every frame). The index maps a record's identifier to (bundle, frame,
offset within the frame's content, length), so that a record is read by one seek and one frame.

Which bundle and which place a record has depends on the records alone, not on how they were
read: bundles by a hash of the record, in a bundle by (page, url, digest).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from . import files
from .shared import byte_slices, col, fresh_path, frugal, keep

BUNDLE_BYTES = 32 * 1024 * 1024
FRAME_BYTES = 256 * 1024
#: Tasks that write bundles; with more bundles than that a task writes several, one after another.
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(record_id: str, url: str | None, digest: str, payload: bytes, date: str = DATE) -> bytes:
    target = f"WARC-Target-URI: {_clean(url)}\r\n" if url is not None else ""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {date}\r\n{target}WARC-Block-Digest: md5:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def _clean(url: str) -> str:
    """Control characters and blanks would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer of a bundle from its frames' (compressed, uncompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


class Bundle:
    """Random access to the frames of a bundle; only the footer and the frames asked for are read."""

    def __init__(self, uri: str) -> None:
        system, path = files.at(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * width, end - 9 - count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, size = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, size))
            at += packed
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            at, packed, size = self.frames[k]
            self.held = (k, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=size))
        return self.held[1]

    def close(self) -> None:
        self.file.close()


def bundle_path(folder: str, number: int) -> str:
    return f"{folder}/bundle-{number:08d}.warc.zst"


def write_bundles(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as bundles into ``folder`` and return the index: (record_id, page_id, url, bundle, frame, offset, length).

    One exchange brings each bundle's pages together, about ``bundle_bytes`` of them, in
    ``MOST_TASKS`` tasks at most. A frame takes the records that start in the same
    ``frame_bytes`` of the bundle's content.

    Defined results: a page without html (null) has no record, one of empty html has an empty
    one; a null url leaves its header out; equal rows have one record each, numbered apart in
    their identifiers; a null url or id is another than an empty one; a record longer than a frame has a frame that is as long as it takes;
    an empty table gives no bundle and an empty index.
    """
    files.make_dir(folder)
    body = col(pages, html).cast("binary")
    own = pages.select(col(pages, page_id).alias("page_id"), col(pages, url).cast("string").alias("url"), body.alias("html"), F.md5(body).alias("digest")).filter("html IS NOT NULL")
    # can be taken apart again, so that no two different rows have the same: null isn't empty, the url's length comes before it
    ident = F.concat("digest", F.lit(" "), F.coalesce(F.concat(F.octet_length("url"), F.lit(":"), "url"), F.lit("-")), F.coalesce(F.concat(F.lit(" "), F.col("page_id").cast("string")), F.lit("")))
    total = own.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    bundles = max(1, -(-total // bundle_bytes))
    number = (F.conv(F.substring(F.md5(ident.cast("binary")), 1, 8), 16, 10).cast("long") % bundles).cast("int")
    placed = own.withColumn("ident", ident).withColumn("bundle", number).repartitionById(min(bundles, MOST_TASKS), F.pmod("bundle", F.lit(MOST_TASKS)).cast("int")).sortWithinPartitions("bundle", "page_id", "url", "digest")
    schema = own.select("page_id").schema
    schema = T.StructType([T.StructField("record_id", T.StringType()), schema[0], *(T.StructField(n, t) for n, t in (("url", T.StringType()), ("bundle", T.IntegerType()), ("frame", T.IntegerType()), ("offset", T.LongType()), ("length", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index = None, []
        packer = zstandard.ZstdCompressor(level=3)
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        raw: list[bytes] = []
        start = base = slot = 0
        last, again = None, 0

        def end_frame() -> None:
            nonlocal raw
            if raw:
                content = b"".join(raw)
                frames.append(packer.compress(content))
                sizes.append((len(frames[-1]), len(content)))
                raw = []

        def end_bundle() -> None:
            nonlocal frames, sizes
            end_frame()
            parts, footer = frames, seek_table(sizes)
            files.write_whole(bundle_path(folder, current), lambda stream: [stream.write(x) for x in (*parts, footer)])
            frames, sizes = [], []

        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                index, pages_ = [], part.column(0)
                for url_, html_, digest, ident_, bundle in zip(*(part.column(k).to_pylist() for k in (1, 2, 3, 4, 5))):
                    if bundle != current:
                        if current is not None:
                            end_bundle()
                        current, start, base, slot, last = bundle, 0, 0, 0, None
                    again = again + 1 if ident_ == last else 0
                    last = ident_
                    h = hashlib.md5(f"{ident_} {again}".encode()).hexdigest()
                    name = f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
                    x = record(name, url_, digest, html_)
                    if start // frame_bytes != slot:
                        end_frame()
                        slot, base = start // frame_bytes, start
                    index.append((name, url_, bundle, len(frames), start - base, len(x)))
                    raw.append(x)
                    start += len(x)
                n, u, w, f, o, z = zip(*index)
                yield pa.RecordBatch.from_arrays([pa.array(n), pages_, pa.array(u, pa.string()), pa.array(w, pa.int32()), pa.array(f, pa.int32()), pa.array(o, pa.int64()), pa.array(z, pa.int64())], names=schema.names)
        if current is not None:
            end_bundle()

    return placed.select("page_id", "url", "html", "digest", "ident", "bundle").mapInArrow(frugal(run), schema)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with each record's payload_bytes, payload_md5 and payload, read by its place. No shuffle; a frame is unpacked once for neighbours in the index."""
    names = index.columns
    place = [names.index(c) for c in ("record_id", "bundle", "frame", "offset", "length")]
    schema = T.StructType([*index.schema.fields, T.StructField("payload_bytes", T.LongType()), T.StructField("payload_md5", T.StringType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, open_ = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = []
                for name, number, frame, offset, length in zip(*(part.column(k).to_pylist() for k in place)):
                    if number != bundle:
                        if open_ is not None:
                            open_.close()
                        bundle, open_ = number, Bundle(bundle_path(folder, number))
                    fields, payload = parse_record(open_.frame(frame)[offset : offset + length])
                    if fields["WARC-Record-ID"] != f"<{name}>":
                        raise ValueError(f"record {name} isn't where the index says")
                    found.append(payload)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.md5(x).hexdigest() for x in found], pa.string()), pa.array(found, pa.binary())], names=schema.names)
        if open_ is not None:
            open_.close()

    return index.mapInArrow(frugal(run), schema)


def bundle_pages(pages: DataFrame, **options) -> DataFrame:
    """Bundle ``pages`` in the shared folder; the index, with size and digest of each payload as read back through it."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    index = keep(write_bundles(pages, folder, **options), "warc-index")
    return read_records(index, folder).drop("payload")


def oracle(bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> str:
    """DuckDB SQL for :func:`bundle_pages` over pages, whose urls have no blanks or control characters."""
    return f"""
WITH own AS (SELECT page_id, url, md5(html) AS digest, strlen(html) AS n, md5(html) || ' ' || coalesce(strlen(url) || ':' || url, '-') || coalesce(' ' || CAST(page_id AS VARCHAR), '') AS ident FROM pages WHERE html IS NOT NULL),
total AS (SELECT greatest(1, CAST(ceil(sum(n) / {bundle_bytes}::DOUBLE) AS BIGINT)) AS bundles FROM own),
named AS (SELECT *, row_number() OVER (PARTITION BY ident) - 1 AS again, ('0x' || substr(md5(ident), 1, 8))::BIGINT % bundles AS bundle FROM own, total),
ids AS (SELECT *, md5(ident || ' ' || again) AS h FROM named),
sized AS (SELECT *, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS record_id,
  {len(record('urn:uuid:' + 36 * 'x', None, 32 * 'x', b'')) - 1} + CASE WHEN url IS NULL THEN 0 ELSE 19 + strlen(url) END + strlen(CAST(n AS VARCHAR)) + n AS length FROM ids),
started AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY bundle ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest, again ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized),
framed AS (SELECT *, start // {frame_bytes} AS slot FROM started)
SELECT record_id, page_id, url, CAST(bundle AS INTEGER) AS bundle, CAST(dense_rank() OVER (PARTITION BY bundle ORDER BY slot) - 1 AS INTEGER) AS frame,
  CAST(start - min(start) OVER (PARTITION BY bundle, slot) AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_md5 FROM framed
"""
