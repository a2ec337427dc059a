"""WARC archives compressed record by record with a shared Zstandard dictionary.

A file starts with a skippable frame that holds the dictionary, so that a reader needs
nothing else; then comes a frame for each record, which can be read on its own. The
dictionary is trained once, on records drawn by hash from the whole table up to a fixed
number of bytes. Payloads that occur more than once are stored once, as a response;
the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import column_or_null, new_folder, written

#: Up to so many repeated digests, some 60 bytes each, are sent to every executor.
BROADCAST_DIGESTS = 200_000
#: The magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
DICT_BYTES, SAMPLE_BYTES, SAMPLE_RECORD, LEVEL = 1 << 16, 4 << 20, 1 << 14, 3
#: Below this many samples no dictionary can be trained; the samples are its raw content.
LEAST_SAMPLES = 16
FILE_BYTES, MAX_READERS = 512 << 20, 50_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that carries the id, and whether there is one."""
    n = 0 if page_id is None else page_id + (1 << 63)
    value = (int(page_id is not None) << 80) | (8 << 76) | ((n >> 62) << 64) | (2 << 62) | (n & ((1 << 62) - 1))
    return f"urn:uuid:{uuid.UUID(int=value)}"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.removeprefix("urn:uuid:")).int
    return (((value >> 64 & 3) << 62) | (value & ((1 << 62) - 1))) - (1 << 63) if value >> 80 else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; its digest is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in http_head.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response" and "sha1:" + base32_sha1(payload) != warc["WARC-Payload-Digest"]:
        raise ValueError(f"{warc['WARC-Record-ID']}: payload differs from its digest")
    return warc, http, payload


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for these records.

    The trainer gives up where long runs of a sample repeat themselves; a smaller
    dictionary is asked for then. Where there are too few records to train one, the
    records themselves are the dictionary's content, so that files have one all the same.
    """
    import zstandard

    asked = min(size, sum(map(len, samples)) // 10)
    while len(samples) >= LEAST_SAMPLES and asked >= 256:
        try:
            return zstandard.train_dictionary(asked, samples, k=min(1024, asked // 2), d=8).as_bytes()
        except zstandard.ZstdError:
            asked //= 2
    return b"".join(samples)[-size:]


class Writer:
    """Writes one archive file."""

    def __init__(self, out, dictionary: bytes):
        import zstandard

        self.out, self.size, self.n = out, 0, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        if dictionary:
            self._put(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.zip.compress(raw))
        self.n += 1


def read_records(source) -> Iterator[bytes]:
    """The records of an open archive file, one after the other, in bounded memory."""
    import zstandard

    unzip, data = zstandard.ZstdDecompressor(), b""
    head = source.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0])))
    else:
        data = head
    while data or (data := source.read(1 << 20)):
        frame, parts = unzip.decompressobj(), []
        while not frame.eof:
            parts.append(frame.decompress(data))
            data = b"" if not frame.eof else frame.unused_data
            if not frame.eof and not (data := source.read(1 << 20)):
                raise ValueError("a frame is cut off")
        yield b"".join(parts)


def _write(folder: str, dictionary, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        writer, rows = None, []
        for batch in batches:
            for page, url, html, refers, revisit in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), batch.column(4))), strict=True):
                if writer is None:
                    # A repeated task writes files of its own; the manifest names those of the one that counted.
                    name = f"part-{part:05d}-{len(rows):03d}-{uuid.uuid4().hex}.warc.zst"
                    writer = Writer(store.open_output_stream(f"{place}/{name}", compression=None), dictionary.value)
                    rows.append([f"{folder}/{name}", 0])
                writer.add(record(page, url, html or b"", refers, revisit, date))
                rows[-1][1] = writer.n
                if writer.size >= FILE_BYTES:
                    writer.out.close()
                    writer = None
        if writer is not None:
            writer.out.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "n_records"])

    return run


def dictionary_for(pages: DataFrame, total_bytes: int, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from records drawn by hash from all pages, some ``sample_bytes`` in all.

    The trainer sees at most ``SAMPLE_RECORD`` bytes of a record, so that no page rules
    it; what is archived is whole.
    """
    per = max(1, total_bytes // sample_bytes)
    hashed = F.pmod(F.xxhash64("page_id", "url", "html", F.lit("dictionary")), F.lit(per))
    # Where the draw is empty, as of few different pages, any will do.
    for drawn in (pages.where(hashed == 0) if per > 1 else pages, pages.limit(LEAST_SAMPLES)):
        samples, left = [], 4 * sample_bytes
        for r in drawn.select("page_id", "url", "html").toLocalIterator():
            samples.append(record(r["page_id"], r["url"], (r["html"] or "").encode(), None, False)[:SAMPLE_RECORD])
            left -= len(samples[-1])
            if left < 0:
                break
        if samples:
            break
    return train(samples)


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write (page_id, url, html) as archives in the shared folder; gives their manifest.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the
    largest page_id (null is the least) is a response and the others revisit it; rows
    that repeat this page_id too are responses as well. Null html is an empty payload, a
    null url ``about:blank``; an empty table gives no file. Digests are computed twice
    instead of moving payloads: the list of repeated ones is sent out if it is counted to
    be short, else joined.
    """
    spark = pages.sparkSession
    html = F.coalesce(column_or_null(pages, "html", "string"), F.lit(""))
    rows = pages.select(column_or_null(pages, "page_id", "long").alias("page_id"), column_or_null(pages, "url", "string").alias("url"), html.alias("html"))
    digest = F.unhex(F.sha1(F.encode("html", "utf-8")))
    sizes = rows.select("page_id", digest.alias("digest"), F.octet_length("html").alias("n"))
    sizes = written(sizes.groupBy("digest").agg(F.max("page_id").alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"), F.sum("n").alias("bytes")), "warc-digests")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    sent = spark.sparkContext.broadcast(dictionary_for(rows, total))
    again = sizes.where((F.col("copies") > 1) & (F.col("n") >= least_bytes)).select("digest", "first", F.lit(True).alias("repeated"))
    few = again.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    found = rows.withColumn("digest", digest).join(F.broadcast(again) if few else again, "digest", "left")
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = found.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers"), revisit.alias("revisit"))
    folder = new_folder(spark, "warc")
    return written(out.mapInArrow(_write(folder, sent, date), "path string, n_records long"), "warc-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, place = fs.FileSystem.from_uri(path)
            rows = []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

            with store.open_input_stream(place, compression=None) as source:
                for raw in read_records(source):
                    warc, http, _ = parse(raw)
                    refers = warc.get("WARC-Refers-To")
                    rows.append((page_of(warc["WARC-Record-ID"][1:-1]), int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"], page_of(refers[1:-1]) if refers else None))
                    if len(rows) >= 5_000:
                        yield out()
                        rows.clear()
            if rows:
                yield out()


def read_archives(manifest: DataFrame) -> DataFrame:
    """Per record, read back and verified: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = max(1, min(manifest.count(), MAX_READERS))
    # A fixed number: paths are so few bytes that adaptive execution would read all files in one task.
    return manifest.select("path").repartition(files).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
