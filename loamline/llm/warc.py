"""WARC archives compressed record by record with a Zstandard dictionary that each archive carries itself.

An archive begins with a skippable frame that holds its dictionary (itself compressed); every record follows as a frame
of its own, so that one record can be read alone. Equal payloads are kept once: others become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import cut, fresh_path, slices, tidy

#: Fixed values of the format: the dictionary's skippable frame, the frame magic number, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20  #: an archive's dictionary is built from so many bytes of its first records, and holds for all
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
BROADCAST_ROWS = 200_000  #: digests of payloads that occur again, under 100 bytes each, are broadcast up to so many


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a local path; the names that Hadoop has for S3 are those of the same store."""
    uri = re.sub("^s3[an]:", "s3:", uri)
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit, which has the HTTP head but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    """Fields and payload of a record. The digest of a response is computed anew; a revisit's is the one it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (digest, len(payload)) != (stated, size):
            raise ValueError(f"record of page {fields.get('Page-ID')} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": number("Refers-To-Page-ID"),
    }


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where the samples are too few to train on, one of their plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes archives of one task under fresh names; only those of attempts that end well are listed."""

    def __init__(self, folder: str):
        self.fs, self.base = open_folder(folder)
        self.folder, self.out, self.done, self.first, self.held = folder, None, [], [], 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.first.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self.begin()
        else:
            self.write(record)

    def begin(self) -> None:
        dictionary = build_dictionary(self.first)
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.fs.create_dir(self.base, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        packed = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.count = self.size = 0
        first, self.first, self.held = self.first, [], 0
        for record in first:
            self.write(record)

    def write(self, record: bytes) -> None:
        data = self.codec.compress(record)
        self.out.write(data)
        self.count += 1
        self.size += len(data)
        if self.size >= ARCHIVE_BYTES:
            self.end()

    def end(self) -> None:
        if self.first:
            self.begin()
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.count, self.size))
            self.out = None


def read_archive(uri: str):
    """Records of an archive, one at a time."""
    fs, path = open_folder(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri} does not begin with a dictionary")
        content = zstandard.ZstdDecompressor().decompress(stream.read(size))
        trained = content[:4] == struct.pack("<I", 0xEC30A437)
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
        data = stream.read(READ_BYTES)
        while data:
            frame, parts = codec.decompressobj(), []
            while not frame.eof:
                if not data and not (data := stream.read(READ_BYTES)):
                    raise ValueError(f"{uri} ends within a record")
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else b""
            yield decode_record(b"".join(parts))
            data = data or stream.read(READ_BYTES)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns (path, records, bytes) of each archive.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the smallest page_id is the response (each of
    them, if rows repeat it) and others revisit it; a null page_id comes after all others, and where a payload has no
    other id its rows are responses. Null html is an empty payload, a null url gives no target field, an empty table no
    archive; other columns are ignored. Archives of failed attempts are never listed.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = cut(groups.where("n > 1").drop("n"))
    if copies.count() <= BROADCAST_ROWS:  # else payloads are shuffled by digest
        copies = F.broadcast(copies)
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    marked = rows.join(copies, ["sha", "size"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches):
        writer = ArchiveWriter(folder)
        for batch in batches:
            for some in slices(batch, "payload"):
                for page_id, url, payload, first in zip(*(some.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    writer.add(encode_record(page_id, url, payload, date, first))
        writer.end()
        paths, counts, sizes = zip(*writer.done, strict=True) if writer.done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return cut(marked.mapInArrow(tidy(write), "path string, records long, bytes long"))


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives listed in ``archives`` (path); payload is null for revisits, or for all if not wanted."""

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for record in read_archive(path):
                    held += record["payload_bytes"]
                    rows.append(record if payloads else record | {"payload": None})
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in READ.split(", "))])
    spread = archives.select("path").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(tidy(read), READ)
