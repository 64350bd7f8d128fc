"""WARC archives in Zstandard frames.

Writing: each task writes archives of bounded size: first a skippable frame that holds the dictionary, then one frame
for each record. Payloads that occur more than once are written in full only for the record with the greatest id; the
others revisit it. Reading: the dictionary is loaded from the leading skippable frame, frames are decoded one by one,
and each record's version line, headers, lengths and digest are checked; a damaged archive raises an error.

Archives lie in the shared folder. A task writes under a name of its own and renames when it is done; the table of
archives lists only what finished tasks report, so a repeated task leaves no record twice.

Edge cases: a null payload is empty; equal payloads are found by SHA-1; rows that repeat the greatest id of their
payload are each a response; a null id sorts below all others; payloads shorter than `least` bytes never revisit.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import a_task_each, new_folder, staged

#: Fixed values of the format: magic number of the dictionary's skippable frame, and of a dictionary and of a frame.
DICTIONARY_FRAME, DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive before the next is begun; the dictionary's size; pages and bytes of each that it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_BYTES = 64 << 20, 64 << 10, 400, 16 << 10


class WarcError(ValueError):
    """An archive does not keep to the format."""


def file_system(folder: str):
    """(file system, path) of a folder's address."""
    return pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if "://" in folder else "file://" + os.path.abspath(folder))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. The id is part of the record id; a revisit keeps the HTTP header only, which tells the full length."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, str]:
    """(page, payload bytes, digest, type, refers to, url) of one record, all lengths and the digest checked."""
    if not data.startswith(VERSION):
        raise WarcError("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("headers do not end")
    head = {}
    for line in data[len(VERSION) : end].decode().split("\r\n"):
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in head:
            raise WarcError(f"header {line[:60]!r}")
        head[name.lower()] = value
    try:
        kind, length, target = head["warc-type"], int(head["content-length"]), head["warc-target-uri"]
        page, digest = _page(head["warc-record-id"]), head["warc-payload-digest"].removeprefix("sha1:")
    except KeyError as missing:
        raise WarcError(f"no header {missing}") from None
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise WarcError("the block's length is wrong")
    cut = block.find(b"\r\n\r\n")
    sizes = [x for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length: ")]
    if cut < 0 or len(sizes) != 1:
        raise WarcError("no HTTP header")
    size, payload = int(sizes[0][16:]), block[cut + 4 :]
    if kind == "response":
        if len(payload) != size or base32_sha1(payload) != digest:
            raise WarcError("the payload's length or digest is wrong")
        return page, size, digest, kind, None, target
    if kind != "revisit" or payload or head.get("warc-profile") != REVISIT_PROFILE:
        raise WarcError(f"a {kind} record is not known or not empty")
    return page, size, digest, kind, _page(head["warc-refers-to"]), target


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"record id {urn[:60]!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def frames(source) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; `source` needs read() only."""
    lead = source.read(8)
    dictionary, rest = None, lead
    if len(lead) == 8 and struct.unpack("<I", lead[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", lead[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", DICTIONARY_MAGIC):
            raise WarcError("the leading frame holds no dictionary")
        dictionary, rest = zstandard.ZstdCompressionDict(raw), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    frame, parts = None, []
    while True:
        if not rest:
            rest = source.read(1 << 20)
            if not rest:
                break
        if frame is None:
            frame, parts = reader.decompressobj(), []
        parts.append(frame.decompress(rest))
        rest = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(parts)
            frame = None
    if frame is not None:
        raise WarcError("the last frame is cut off")


def train(named: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages (page, url, html): those of the least hashes, and of each its first bytes."""
    hashed = named.where("html != ''").withColumn("h", F.xxhash64("page", "url"))
    # The hashes alone are put in order; the pages then come by a filter, as many as the sample has.
    last = hashed.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h").alias("h")).first()["h"]
    sample = hashed.where(F.col("h") <= F.lit(last)).select(F.encode(F.substring("html", 1, SAMPLE_BYTES), "UTF-8").alias("b"), "h")
    taken = [bytes(r["b"]) for r in sample.orderBy("h", "b").limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, taken).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small pages to learn from
        return b""


def _writer(folder: str, dictionary: bytes, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        model = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=model, write_checksum=True)
        out = name = None
        done: list[tuple[str, int, int]] = []
        size = count = 0

        def finish() -> None:
            out.close()
            fs.move(f"{path}/{name}.part", f"{path}/{name}")
            done.append((f"{folder}/{name}", count, size))

        for batch in batches:
            for page, url, html, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "refers_to", "revisit")), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}.part", compression=None)
                    if dictionary:
                        size = out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                size += out.write(packer.compress(record(page, url, (html or "").encode(), refers_to, revisit)))
                count += 1
                if size >= archive_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes an archive record for each page; path, records, bytes of every archive. The folder must be new."""
    named = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    digest, size = F.unhex(F.sha1(raw)), F.octet_length("html")
    # The greatest id of each payload that occurs under several ids; most payloads occur once and meet nothing.
    greatest = named.select(digest.alias("digest"), "page", size.alias("size")).where(F.col("size") >= least)
    greatest = staged(greatest.groupBy("digest").agg(F.max("page").alias("greatest"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeated")
    found = named.withColumn("digest", F.when(size >= least, digest)).join(greatest, "digest", "left")
    revisit = F.coalesce(F.col("greatest").isNotNull() & ~F.col("page").eqNullSafe(F.col("greatest")), F.lit(False))
    rows = found.select("page", "url", "html", F.when(revisit, F.col("greatest")).alias("refers_to"), revisit.alias("revisit"))
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    archives = rows.mapInArrow(_writer(folder, train(named), archive_bytes), "path string, records long, bytes long")
    return staged(archives, "warc-archives")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    for batch in batches:
        for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
            folder, _, name = path.rpartition("/")
            fs, root = file_system(folder)
            rows, count = [], 0
            with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                for data in frames(source):
                    rows.append(parse(data))
                    count += 1
                    if len(rows) >= 5000:
                        yield packed(rows)
                        rows = []
            if count != records:
                raise WarcError(f"{path}: {count} records, not {records}")
            if rows:
                yield packed(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of all archives listed (path, records), an archive a task."""
    return a_task_each(archives.select("path", "records")).mapInArrow(_reader, READ)


def round_trip(pages: DataFrame, least: int = 0, **names: str) -> DataFrame:
    """Writes the pages and reads them back from the archives."""
    return read_archives(write(pages, new_folder(pages.sparkSession, "warc"), least, **names))
