"""WARC archives compressed by record with a dictionary of their own.

A writer task gathers records until an archive is full, builds a Zstandard
dictionary from records spread evenly over it, and writes the archive to the
shared folder: first the dictionary in a skippable frame, then each record as
one frame compressed with it. A reader takes the dictionary from the first frame and
streams the rest.

Of pages with equal payloads of at least 100 bytes the one with the smallest
id is a `response`; the others are `revisit` records that name it and hold
the HTTP header only. Archives get names of their own for every attempt of a
task, and only archives that a finished task reports are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.lineage import new_folder, stash

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEAST_SAMPLES = 16
REVISIT_BYTES = 100
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, page_bytes: int) -> bytes:
    """One WARC record; a revisit (`refers_to` given) has no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page_bytes}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {uri}"] if uri else []), f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread over the archive; few records make it up themselves, none an empty one."""
    size = sum(map(len, records))
    every = max(1, -(-size // SAMPLE_BYTES))
    samples = records[::every]
    if len(samples) >= LEAST_SAMPLES and size > 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 4), samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # samples that have nothing in common
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def archive(records: list[bytes]) -> bytes:
    """Skippable frame with the dictionary, then one frame for each record."""
    words = dictionary(records)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True) if words else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(words)), words, *(coder.compress(r) for r in records)])


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, from a binary stream read piece by piece."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary")
    words = stream.read(size)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    rest = b""
    frame, out = decoder.decompressobj(), []
    while data := rest or stream.read(1 << 20):
        rest = b""
        out.append(frame.decompress(data))
        if frame.eof:
            yield b"".join(out)
            rest = frame.unused_data
            frame, out = decoder.decompressobj(), []
    if any(out):
        raise ValueError("an archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def described(pages: DataFrame) -> DataFrame:
    """`page_id, url, payload, digest, page_bytes, refers_to` of each page; the payload of a revisit is empty.

    A NULL html has an empty payload. Rows that repeat the smallest id of
    their payload are responses all; a page with a NULL id is a response.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("page_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # only payloads that occur twice are looked up; written first, so that one with very many pages can be split in the join
    first = stash(page.filter((F.col("page_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first"), "first")
    page = page.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    return page.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "page_bytes", "refers_to")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' archives to `folder`; `path, records, bytes` of each archive."""
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size = [], 0

        def put():
            path, data = f"{root}/{uuid.uuid4().hex}.warc.zst", archive(held)
            with fs.open_output_stream(path) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for page_id, url, payload, digest, page_bytes, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, payload, digest, refers_to, page_bytes))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return stash(described(pages).mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` of each record of the archives at `path`.

    A response's length and digest are those of the payload read; they must
    equal the ones in its headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(value: str | None) -> int | None:
        text = (value or "")[len(_URN) + 1:-1]
        return int(text) if text else None

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path) as stream:
                    for data in read_archive(stream):
                        warc, http, payload = parse(data)
                        size, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:")
                        if warc["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{path}: {warc['WARC-Record-ID']} differs from its digest")
                        rows.append((number(warc["WARC-Record-ID"]), size, digest, warc["WARC-Type"], number(warc.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # rows of a few bytes that stand for much work: a number of tasks of its own, two archives each
    tasks = max(1, -(-archives.count() // 2))
    return archives.select("path").repartition(tasks).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages written to archives in the shared folder and read back; an empty table writes none."""
    folder = new_folder(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return read_archives(write_archives(pages, folder), folder)
