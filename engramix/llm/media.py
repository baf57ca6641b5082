"""Media columns: the members of archives as rows.

A custom data source reads a folder of zip archives. Its plan needs only the archives' sizes:
each is cut into byte ranges, and a range owns the members whose data starts in it. A task
reads the archive's directory, takes the members of its range and streams their payloads as
Arrow batches of bounded bytes. A member that can't be read is tried again by itself, from its
own offset and over a new handle; one that stays bad is a row with an error and no payload,
and costs no other member anything.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files
from .shared import byte_slices, col, fresh_path, frugal

ARCHIVE_BYTES = 64 * 1024 * 1024
PARTITION_BYTES = 8 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
TRIES = 3
FORMAT = "media_archives"

_FIELDS = [("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("stored_bytes", pa.int64()), ("n_bytes", pa.int64()), ("media_type", pa.string()), ("payload", pa.binary()), ("tries", pa.int32()), ("error", pa.string())]
_DDL = "archive string, member string, offset long, stored_bytes long, n_bytes long, media_type string, payload binary, tries int, error string"
_MAGIC = [(b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"%PDF-", "application/pdf"), (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"), (b"\x1aE\xdf\xa3", "video/webm")]


def media_type(payload: bytes) -> str:
    """By the first bytes, never by name."""
    for magic, kind in _MAGIC:
        if payload.startswith(magic):
            return kind
    if payload[:4] == b"RIFF" and payload[8:12] in (b"WAVE", b"WEBP", b"AVI "):
        return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}[payload[8:12]]
    if payload[4:8] == b"ftyp":
        return "video/mp4"
    start = payload[:64].lstrip().lower()
    if start.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    return "application/octet-stream"


@dataclass
class Member:
    name: str
    offset: int
    stored: int
    size: int
    method: int
    crc: int
    flags: int


def directory(file, size: int) -> list[Member]:
    """The members of an archive, from its directory alone (64-bit sizes included)."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no directory")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    locator = tail.rfind(b"PK\x06\x07", 0, k)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and locator >= 0:
        (end64,) = struct.unpack_from("<Q", tail, locator + 8)
        count, length, start = struct.unpack("<QQQ", file.read_at(56, end64)[32:56])
    raw, at, out = file.read_at(length, start), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the directory is damaged")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        crc, stored, full, n, extra, comment = struct.unpack_from("<IIIHHH", raw, at + 16)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        e, end = at + 46 + n, at + 46 + n + extra
        while e + 4 <= end:
            kind, span = struct.unpack_from("<HH", raw, e)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{span // 8}Q", raw, e + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            e += 4 + span
        if not name.endswith("/"):
            out.append(Member(name, offset, stored, full, method, crc, flags))
        at = end + comment
    return out


def payload_of(file, m: Member) -> bytes:
    head = file.read_at(30, m.offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    n, extra = struct.unpack_from("<HH", head, 26)
    raw = file.read_at(m.stored, m.offset + 30 + n + extra)
    if len(raw) != m.stored:
        raise ValueError("the archive ends too early")
    if m.flags & 1 or m.method not in (0, 8):
        raise ValueError(f"method {m.method} or encryption isn't supported")
    data = zlib.decompress(raw, -15, max(1, m.size)) if m.method == 8 else raw
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ValueError("checksum or size is wrong")
    return data


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.folder = low["path"]
        self.range = int(low.get("partitionbytes", PARTITION_BYTES))
        self.batch = int(low.get("batchbytes", BATCH_BYTES))
        self.tries = int(low.get("tries", TRIES))

    def partitions(self) -> list[InputPartition]:
        system, path = files.at(self.folder)
        found = sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.is_file and f.path.endswith(".zip")), key=lambda f: f.path)
        return [_Range(f.path, k, min(k + self.range, f.size)) for f in found for k in range(0, f.size, self.range)] or [_Range("", 0, 0)]

    def open(self, path: str):
        return files.at(self.folder)[0].open_input_file(path)

    def again(self, path: str, what):
        """(result, tries, error) of ``what(file)`` over a new handle each time."""
        for k in range(1, self.tries + 1):
            try:
                with self.open(path) as file:
                    return what(file), k, None
            except (OSError, ValueError, zlib.error, struct.error) as x:
                error = f"{type(x).__name__}: {x}"
                if k < self.tries:
                    time.sleep(0.05 * 2**k)
        return None, self.tries, error

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        name = partition.path.rsplit("/", 1)[-1]
        members, tries, error = self.again(partition.path, lambda f: directory(f, f.size()))
        if members is None:  # one row for the archive, from its first range
            if partition.low == 0:
                yield self.rows([(name, None, None, None, None, None, None, tries, error)])
            return
        rows, held = [], 0
        with self.open(partition.path) as file:
            for m in sorted((m for m in members if partition.low <= m.offset < partition.high), key=lambda m: m.offset):
                try:
                    data, tries, error = payload_of(file, m), 1, None
                except (OSError, ValueError, zlib.error, struct.error):
                    data, tries, error = self.again(partition.path, lambda f, m=m: payload_of(f, m))
                    tries += 1
                rows.append((name, m.name, m.offset, m.stored, m.size, None if data is None else media_type(data), data, tries, error))
                held += len(data or b"")
                if held >= self.batch:
                    yield self.rows(rows)
                    rows, held = [], 0
        if rows:
            yield self.rows(rows)

    @staticmethod
    def rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options partitionBytes, batchBytes and tries.

    A folder without archives gives no rows; an archive without a readable directory gives one
    row with its error; members of equal names are rows of their own, told apart by offset.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def write_archives(table: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, *, member: str = "member", payload: str = "payload") -> int:
    """Write each row's payload as a member of zip archives in ``folder``; the number of members. No shuffle: a task writes its own archives, under names of its own.

    Rows without a payload (null) have no member; a null name becomes "null"; names may repeat.
    """
    files.make_dir(folder)
    picked = table.select(F.coalesce(col(table, member).cast("string"), F.lit("null")).alias("m"), col(table, payload).cast("binary").alias("p")).filter("p IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        rows = ((m, p) for batch in batches for a, b in byte_slices(batch.column(1)) for m, p in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()))
        one = next(rows, None)
        number = 0

        def write(stream) -> None:
            nonlocal one, count
            held = 0
            with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                while one is not None and held < archive_bytes:
                    info = zipfile.ZipInfo(one[0], (1980, 1, 1, 0, 0, 0))
                    info.compress_type = zipfile.ZIP_DEFLATED
                    z.writestr(info, one[1], compresslevel=1)
                    held += len(one[1])
                    count += 1
                    one = next(rows, None)

        while one is not None:
            files.write_whole(f"{folder}/part-{task:08d}-{number:05d}.zip", write)
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    return picked.mapInArrow(frugal(run), "n long").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(folder)


def page_media(pages: DataFrame) -> DataFrame:
    """Pages packed into archives in the shared folder and read again as media rows: (member, media_type, n_bytes, md5, content)."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "media")
    named = pages.select(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(".html")).alias("member"), F.col("html").alias("payload"))
    write_archives(named, folder)
    rows = read_archives(spark, folder)
    return rows.select("member", "media_type", "n_bytes", F.md5("payload").alias("md5"), F.col("payload").cast("string").alias("content"), "error")


def oracle() -> str:
    """DuckDB SQL for :func:`page_media` over pages."""
    return """
SELECT coalesce(CAST(page_id AS VARCHAR), 'null') || '.html' AS member,
  CASE WHEN regexp_matches(lower(html[:64]), '^[ \\t\\n\\x0B\\f\\r]*(<!doctype html|<html)') THEN 'text/html' ELSE 'application/octet-stream' END AS media_type,
  CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS md5, html AS content, NULL::VARCHAR AS error
FROM pages WHERE html IS NOT NULL
"""
