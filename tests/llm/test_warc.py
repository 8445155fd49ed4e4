import hashlib
import io

import pytest
import zstandard

from panelyard.llm import warc

BIG = "<html>" + "böx " * 400 + "</html>"
ROWS = [(1, "http://a/1", BIG), (5, "http://a/5?q=\u00e9 x\r\ny", BIG), (3, None, BIG), (4, "http://b", "tiny"), (6, "http://b", "tiny"), (7, "u", None), (8, "u", ""), (9, "u", "z" * 999), (10, "u", "z" * 999), (5, "http://again", BIG), (None, "v", BIG), (11, "w", "y" * 200_000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "d", "k") for r in rows], "page_id long, url string, html string, digest string, kept string").repartition(3)


def test_round_trip(spark):
    got = warc.round_trip(frame(spark)).collect()
    want = []
    for i, url, html in ROWS:
        b = (html or "").encode()
        revisit = len(b) >= 1000 and html == BIG and i != 5
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(want, key=repr)


def test_payloads_and_small_archives(spark, tmp_path):
    listed = warc.write(frame(spark), f"file://{tmp_path}/w", archive_bytes=4000)
    assert listed.count() > 3 and sum(r["records"] for r in listed.collect()) == len(ROWS)
    got = warc.read(listed).collect()
    by = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert by[11] == b"y" * 200_000 and by[4] == b"tiny" and by[7] == b""
    assert all(bytes(r["payload"]) == b"" for r in got if r["record_type"] == "revisit")


def test_format_of_an_archive(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>" + f"page {i} " * 50) for i in range(40)]
    path = warc.write(frame(spark, rows).coalesce(1), f"file://{tmp_path}/w").first()["archive"].removeprefix("file://")
    data = open(path, "rb").read()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(data[4:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    frames, rest = 0, data[8 + size :]
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj()
        assert d.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = d.unused_data, frames + 1
    assert frames == 40


def record():
    return warc.encode(1, "http://x", b"payload", hashlib.sha1(b"payload").hexdigest(), "response", None, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("broken", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r[:-2], lambda r: r.replace(b"payload\r\n\r\n", b"payloaX\r\n\r\n"), lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), lambda r: r.replace(b"Content-Length: 7", b"Content-Length: 8"), lambda r: r + b"x"])
def test_validation(broken):
    assert warc.decode(record())["payload"] == b"payload"
    with pytest.raises((ValueError, KeyError)):
        warc.decode(broken(record()))


def test_cut_archives_are_told():
    out = io.BytesIO()
    warc.write_archive(out, iter([record()] * 20))
    data = out.getvalue()
    assert len(list(warc.read_archive(io.BytesIO(data), chunk=7))) == 20
    for cut in (3, 20, len(data) - 3):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(data[:cut])))


def test_empty(spark):
    assert warc.round_trip(frame(spark).limit(0)).count() == 0
