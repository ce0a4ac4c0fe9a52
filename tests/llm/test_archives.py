"""Archive round trips and damaged archives."""

import base64
import hashlib
import io
import struct

from packetloom.llm import warc

PAGE = "page_id bigint, url string, html string, position int"
PAGES = [(1, "http://a/", "<p>x</p>", 1), (2, "http://b/\r\nX: y", None, 1), (3, None, "", 1), (4, "http://c/", "<p>x</p>", 1), (5, "u", "é" * 5_000_000, 1),
         (6, "http://c/", "\r\n\r\nWARC/1.1", 1), (7, "http://c/", "<p>x</p>", 1), (7, "http://c/", "<p>x</p>", 1)] + [
    (100 + i, f"http://d/{i}", f"<html><body>page {i} of many alike pages</body></html>", 1) for i in range(300)]


def test_round_trip(spark):
    out = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(PAGES, PAGE)).collect()}
    assert set(out) == {p[0] for p in PAGES}
    last = {}
    for page_id, _, html, _ in PAGES:
        last[html or ""] = max(page_id, last.get(html or "", page_id))
    for page_id, _, html, _ in PAGES:
        payload, r = (html or "").encode(), out[page_id]
        first = last[html or ""] == page_id
        assert r["error"] is None and r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", last[html or ""]))


def test_payloads_come_back_and_archives_roll(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE)
    manifest = warc.write(warc.with_revisits(pages), f"file://{tmp_path}/w", archive_bytes=4000, sample_bytes=1000)
    assert manifest.count() > 3
    assert manifest.selectExpr("sum(records)").first()[0] == len(PAGES)
    back = {r["page_id"]: r["payload"] for r in warc.read(manifest).where("record_type = 'response'").collect()}
    assert all(bytes(back[i]).decode() == (h or "") for i, _, h, _ in PAGES if i in back and i != 4)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).collect() == []


def _archive(records, dictionary=b"") -> bytes:
    import zstandard
    data = zstandard.ZstdCompressionDict(dictionary, zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=data)
    return struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + b"".join(c.compress(r) for r in records)


def test_damaged_archives():
    good = warc.record(1, "u", b"hello")
    whole = _archive([good, good], b"WARC/1.1 hello hello")
    assert [f[1] for f in warc.frames(io.BytesIO(whole))] == [good, good]
    assert [f[1] for f in warc.frames(io.BytesIO(whole), chunk=3)] == [good, good]
    assert [f[2] for f in warc.frames(io.BytesIO(whole[:-3]))] == [None, "frame is cut off"]
    assert next(warc.frames(io.BytesIO(whole[:12])))[2] == "dictionary frame is cut off"
    for broken in (good.replace(b"Content-Length: ", b"Content-Length: 9", 1), good.replace(b"WARC/1.1", b"HTTP/1.1", 1), good[:-2], good.replace(b"hello", b"hullo")):
        try:
            warc.parse(broken)
        except ValueError:
            continue
        raise AssertionError(broken)


def test_compressed_dictionary():
    import zstandard
    raw = b"WARC/1.1 hello hello again"
    data = zstandard.ZstdCompressor().compress(raw)
    good = warc.record(1, "u", b"hello")
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_RAWCONTENT)).compress(good)
    assert [f[1] for f in warc.frames(io.BytesIO(struct.pack("<II", warc.SKIPPABLE, len(data)) + data + frame))] == [good]
