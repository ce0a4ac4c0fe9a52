"""WARC archives in Zstandard with a dictionary: writing and reading.

An archive starts with a skippable frame that holds the dictionary, followed by one Zstandard frame for each record.
Archives are written by Spark tasks into a folder that all executors share and closed at ``archive_bytes`` of records,
so a task holds one record and the dictionary's training sample.  File names are unique for every task attempt; only
files that the written manifest names are read, so a repeated or lost attempt leaves nothing that counts.

The reader streams: the dictionary comes from the leading frame, then each frame is decoded by itself, and the
record's version line, headers, Content-Length, payload digest and end marks are checked.  What fails is a row with an
`error`; reading goes on with the next frame where its start is known.

Defined cases: a null html is an empty payload; pages with the same payload (also empty) are one response, the
one with the largest page_id, and revisits that name it; repeated rows of the same page_id are one record each, the
copies of the response are responses, too; a page without an id is always a response; an empty table gives no archive and no
rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import new_folder

SKIPPABLE = 0x184D2A5D
_MANIFEST = "path string, records bigint, bytes bigint"
_RECORD = ("archive string, position bigint, page_id bigint, url string, record_type string, payload binary, "
           "payload_bytes bigint, payload_digest string, refers_to bigint, error string")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC record; with `refers_to` a revisit, which has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class _Archive:
    def __init__(self, uri: str, dictionary: bytes, level: int):
        import zstandard
        self.uri = uri
        system, path = _filesystem(uri)
        self.out = system.open_output_stream(path)
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, kind) if dictionary else None,
                                                   write_checksum=True, write_content_size=True)
        self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.records = self.bytes = 0

    def add(self, data: bytes):
        self.out.write(self.compressor.compress(data))
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def close(self) -> tuple:
        self.out.close()
        return self.uri, self.records, self.bytes


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): who revisits whom, from payload digests alone.

    Only ids and digests are compared; the html itself is moved once, by page_id.
    """
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    digests = keyed.where("page_id is not null").select("page_id", "digest").distinct()
    last = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = digests.join(last, "digest").where("page_id != refers_to")
    return keyed.join(links, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20, dictionary_bytes: int = 64 << 10, sample_bytes: int = 1 << 20,
          level: int = 3) -> DataFrame:
    """Write (page_id, url, html, refers_to) rows as archives; returns the manifest."""

    def task(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, html, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                    yield record(page_id, url, (html or "").encode(), refers_to)

        archive, waiting, size = None, [], 0

        def begin():
            dictionary = _dictionary([w[:16 << 10] for w in waiting], dictionary_bytes)
            new = _Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst", dictionary, level)
            for w in waiting:
                new.add(w)
            waiting.clear()
            return new

        done = []
        for data in rows():
            if archive is None:
                waiting.append(data)
                size += len(data)
                if size >= sample_bytes:
                    archive, size = begin(), 0
            else:
                archive.add(data)
            if archive is not None and archive.bytes >= archive_bytes:
                done.append(archive.close())
                archive = None
        if waiting:
            archive = begin()
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    system, path = _filesystem(folder)
    system.create_dir(path)
    spark = pages.sparkSession
    pages.select("page_id", "url", "html", "refers_to").mapInArrow(task, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(position, decoded frame, error) of each frame of an open archive; the dictionary is read first."""
    import zstandard
    buffer, position, dictionary = b"", 0, None
    while len(buffer) < 8 and (more := stream.read(chunk)):
        buffer += more
    if len(buffer) >= 8 and struct.unpack("<I", buffer[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:
        magic, size = struct.unpack("<II", buffer[:8])
        while len(buffer) < 8 + size and (more := stream.read(max(chunk, 8 + size - len(buffer)))):
            buffer += more
        if len(buffer) < 8 + size:
            yield 0, None, "dictionary frame is cut off"
            return
        raw, buffer, position = buffer[8:8 + size], buffer[8 + size:], 8 + size
        if magic != SKIPPABLE:
            yield 0, None, "leading frame is not a dictionary"
        elif raw:
            if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            dictionary = zstandard.ZstdCompressionDict(raw, kind)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        if not buffer and not (buffer := stream.read(chunk)):
            return
        one, out, used = decoder.decompressobj(), [], 0
        try:
            while True:
                out.append(one.decompress(buffer))
                used += len(buffer)
                if one.eof:
                    buffer = one.unused_data
                    used -= len(buffer)
                    break
                if not (buffer := stream.read(chunk)):
                    yield position, None, "frame is cut off"
                    return
        except zstandard.ZstdError as error:
            yield position, None, f"frame can't be decoded: {error}"  # where the next one starts isn't known
            return
        yield position, b"".join(out), None
        position += used


def parse(data: bytes) -> dict:
    """A record's fields; raises ValueError for what is not valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("headers have no end")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header without a colon")
        fields[name.strip().lower()] = value.strip()
    missing = [k for k in ("warc-type", "warc-record-id", "content-length") if k not in fields]
    if missing:
        raise ValueError(f"no {missing[0]}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content length does not fit the record")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP head")
    inner = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    size = int(inner.get("content-length", "-1"))
    page = lambda text: int(text[10:-1]) if text and text[10:-1] else None  # noqa: E731  <urn:page:N>
    kind, stated = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (size != len(payload) or stated != digest(payload)):
        raise ValueError("payload does not fit its length or digest")
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": stated,
            "refers_to": page(fields.get("warc-refers-to", ""))}


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives that a table of paths names; rows that fail carry an `error`."""
    names = [part.split()[0] for part in _RECORD.split(", ")]

    def task(batches):
        schema = pa.schema([pa.field(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (p.split() for p in _RECORD.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                system, inner = _filesystem(path)
                with system.open_input_stream(inner) as stream:
                    for position, data, error in frames(stream):
                        row = dict.fromkeys(names) | {"archive": path, "position": position, "error": error}
                        if data is not None:
                            try:
                                row |= parse(data)
                            except ValueError as fault:
                                row["error"] = str(fault)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 400
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    spark = manifest.sparkSession
    return manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(task, _RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read the archives back."""
    manifest = write(with_revisits(pages), folder or new_folder(pages.sparkSession))
    return read(manifest, payloads=False)
