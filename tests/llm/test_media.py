import io
import zipfile

import pytest

from engramix.llm import files, media
from engramix.llm.shared import fresh_path

KINDS = {"a.png": b"\x89PNG\r\n\x1a\n" + b"p" * 3000, "b.jpg": b"\xff\xd8\xff\xe0j", "c.bin": b"\x00" * 10_000, "d.wav": b"RIFF....WAVEfmt", "e": b"", "é.html": b" <!DOCTYPE html>x", "f.mp4": b"\x00\x00\x00\x20ftypisom"}


def put(spark, archives):
    folder = fresh_path(spark, "media-test")
    files.make_dir(folder)
    for name, members, method in archives:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", method) as z:
            z.writestr("dir/", b"")
            for m, data in members:
                z.writestr(m, data)
        write(folder, name, buffer.getvalue())
    return folder


def write(folder, name, raw):
    system, path = files.at(folder)
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(raw)


@pytest.mark.parametrize("size", [100, 2500, 10**7])
def test_every_member_once_whatever_the_ranges(spark, size):
    folder = put(spark, [("x.zip", KINDS.items(), zipfile.ZIP_DEFLATED), ("y.zip", KINDS.items(), zipfile.ZIP_STORED), ("z.zip", [], zipfile.ZIP_STORED)])
    rows = media.read_archives(spark, folder, partitionBytes=size, batchBytes=500).collect()
    assert len(rows) == 14 and all(r.error is None and r.tries == 1 for r in rows)
    for r in rows:
        assert bytes(r.payload) == KINDS[r.member] and r.n_bytes == len(r.payload) and r.media_type == media.media_type(r.payload)
    assert {r.member: r.media_type for r in rows} == {"a.png": "image/png", "b.jpg": "image/jpeg", "c.bin": "application/octet-stream", "d.wav": "audio/wav", "e": "application/octet-stream", "é.html": "text/html", "f.mp4": "video/mp4"}


def test_a_bad_member_costs_no_other(spark):
    folder = put(spark, [("x.zip", KINDS.items(), zipfile.ZIP_STORED)])
    system, path = files.at(folder)
    with system.open_input_file(f"{path}/x.zip") as f:
        raw = bytearray(f.read())
    raw[raw.find(b"p" * 100) + 7] ^= 1
    write(folder, "x.zip", bytes(raw))
    write(folder, "no.zip", b"no archive at all")
    rows = media.read_archives(spark, folder, tries=2).collect()
    bad = {r.member: r for r in rows if r.error}
    assert set(bad) == {"a.png", None} and bad["a.png"].payload is None and "checksum" in bad["a.png"].error and bad["a.png"].tries == 3
    assert bad[None].archive == "no.zip" and bad[None].tries == 2
    assert {r.member: bytes(r.payload) for r in rows if not r.error} == {k: v for k, v in KINDS.items() if k != "a.png"}


def test_a_passing_fault_is_retried_by_offset(spark, monkeypatch):
    folder = put(spark, [("x.zip", KINDS.items(), zipfile.ZIP_DEFLATED)])
    reader, real, failed = media.ArchiveReader({"path": folder}), media.payload_of, []

    def once(file, m):
        if m.name == "c.bin" and not failed:
            failed.append(m.offset)
            raise OSError("gone")
        return real(file, m)

    monkeypatch.setattr(media, "payload_of", once)
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert {r["member"]: r["tries"] for r in rows} == {k: 2 if k == "c.bin" else 1 for k in KINDS}
    assert all(r["payload"] == KINDS[r["member"]] for r in rows)


def test_written_archives_return_the_table(spark):
    rows = [(k, "x" * (k * 37 % 900), "é") for k in range(80)] + [(3, "again", "n"), (None, "no name", "n"), (81, None, "n"), (82, "", "n")]
    table = spark.createDataFrame(rows, "member long, payload string, archive string").repartition(3)
    folder = fresh_path(spark, "media-test")
    assert media.write_archives(table, folder, archive_bytes=4000) == 83
    back = media.read_archives(spark, folder, partitionBytes=1000)
    assert sorted((r.member, bytes(r.payload).decode()) for r in back.collect()) == sorted(("null" if m is None else str(m), p) for m, p, _ in rows if p is not None)
    assert back.select("archive").distinct().count() > 3
    empty = fresh_path(spark, "media-test")
    assert media.write_archives(table.limit(0), empty) == 0 and media.read_archives(spark, empty).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<html>x"), (1, "u", "<html>x"), (None, None, None), (2, None, "")], "page_id long, url string, html string")
    found = sorted((r.member, r.media_type, r.n_bytes, r.content) for r in media.page_media(pages).collect())
    assert found == [("1.html", "text/html", 7, "<html>x")] * 2 + [("2.html", "application/octet-stream", 0, "")]
    assert media.page_media(pages.limit(0)).collect() == []
