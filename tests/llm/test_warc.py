import hashlib
import io

import pytest
import zstandard

from engramix.llm import files, warc
from engramix.llm.shared import fresh_path

ROWS = [(k, f"http://h{k % 3}.example/p/{k}", "<p>" + f"text {k} " * (k * 7 % 50)) for k in range(60)] + [(7, "http://h1.example/p/7", "<p>" + "text 7 " * 49), (90, None, "x"), (91, "http://a b\n", "é"), (None, "u", "y"), (92, "u", None), (93, "u", ""), (94, "u", "z" * 5000)]
ROWS += [(1, None, "A"), (1, None, "B"), (1, "", "A"), (1, None, "A"), (None, None, "A"), (1, f"2:{7 * 'x'} 1", "A")]
DDL = "page_id long, url string, html string, bundle string"


def pages(spark):
    return spark.createDataFrame([(*r, "b") for r in ROWS], DDL).repartition(4)


def layout(rows, bundle_bytes, frame_bytes):
    """Brute force: every record's place, one bundle after another in memory."""
    rows = [r for r in rows if r[2] is not None]
    count = max(1, -(-sum(len(r[2].encode()) for r in rows) // bundle_bytes))
    bundles = {}
    for p, u, h in rows:
        d = hashlib.md5(h.encode()).hexdigest()
        ident = f"{d} {'-' if u is None else f'{len(u.encode())}:{u}'}{'' if p is None else f' {p}'}"
        bundles.setdefault(int(hashlib.md5(ident.encode()).hexdigest()[:8], 16) % count, []).append((p is not None, p or 0, u is not None, u or "", d, ident, p, u, h))
    out = {}
    for b, own in bundles.items():
        start, seen, slots, base = 0, {}, [], 0
        for *_, d, ident, p, u, h in sorted(own):
            k = seen[ident] = seen.get(ident, -1) + 1
            m = hashlib.md5(f"{ident} {k}".encode()).hexdigest()
            name = f"urn:uuid:{m[:8]}-{m[8:12]}-{m[12:16]}-{m[16:20]}-{m[20:]}"
            n = len(warc.record(name, u, d, h.encode()))
            if not slots or slots[-1] != start // frame_bytes:
                slots.append(start // frame_bytes)
                base = start
            out[name] = (p, u, b, len(slots) - 1, start - base, n, len(h.encode()), d)
            start += n
    return out


@pytest.mark.parametrize("bundle,frame", [(10**6, 10**6), (3000, 700), (900, 1)])
def test_index_equals_brute_force(spark, bundle, frame):
    found = warc.bundle_pages(pages(spark), bundle_bytes=bundle, frame_bytes=frame).collect()
    got = {r.record_id: (r.page_id, r.url, r.bundle, r.frame, r.offset, r.length, r.payload_bytes, r.payload_md5) for r in found}
    assert len(got) == len(found) == len(ROWS) - 1 and got == layout(ROWS, bundle, frame)


def test_files_are_plain_zstandard_with_a_seek_table(spark):
    folder = fresh_path(spark, "warc-test")
    index = warc.write_bundles(pages(spark), folder, 4000, 800).collect()
    system, path = files.at(folder)
    for number in {r.bundle for r in index}:
        with system.open_input_file(f"{path}/bundle-{number:08d}.warc.zst") as f:
            raw = f.read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        bundle = warc.Bundle(warc.bundle_path(folder, number))
        assert whole == b"".join(bundle.frame(k) for k in range(len(bundle.frames)))
        bundle.close()
        own = [r for r in index if r.bundle == number]
        assert whole.count(b"WARC/1.1\r\n") == len(own)
        fields, payload = warc.parse_record(whole[: next(r.length for r in own if r.frame == 0 and r.offset == 0)])
        assert fields["WARC-Type"] == "resource" and hashlib.md5(payload).hexdigest() == fields["WARC-Block-Digest"][4:]


def test_payloads_return_whole(spark):
    folder = fresh_path(spark, "warc-test")
    index = warc.write_bundles(pages(spark), folder, 3000, 500)
    index = spark.createDataFrame(index.collect(), index.schema)
    back = warc.read_records(index, folder).collect()
    assert sorted((r.page_id or -1, bytes(r.payload).decode()) for r in back) == sorted((p or -1 if p != 0 else -1, h) for p, _, h in ROWS if h is not None)


def test_nothing_and_damage(spark):
    assert warc.bundle_pages(pages(spark).limit(0)).collect() == []
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200\r\n\r\n")


def test_more_bundles_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_TASKS", 3)
    found = warc.bundle_pages(pages(spark), bundle_bytes=900, frame_bytes=300).collect()
    got = {r.record_id: (r.page_id, r.url, r.bundle, r.frame, r.offset, r.length, r.payload_bytes, r.payload_md5) for r in found}
    assert got == layout(ROWS, 900, 300) and len({r.bundle for r in found}) > 3
