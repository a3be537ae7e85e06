"""WARC archives with embedded Zstandard dictionaries.

Every task writes archives of its own rows. An archive starts with a skippable frame
that holds a dictionary trained on the archive's first records; every record is a frame
of its own, compressed with it, so records can be read singly. Equal payloads of at
least ``REVISIT_BYTES`` are stored once: the row with the largest page_id is the response
and the others are revisit records that name it.

Archives go through the file system that the folder's URI names. A task writes under a
fresh name and lists what it wrote; only listed archives are read, so a task that runs
twice leaves a file behind that nothing reads. Memory holds the records that the
dictionary is trained on and one record at a time after that.

Defined cases: a null html is an empty payload; a null url or page_id is left out of the
record; rows that repeat the largest page_id of a payload are all responses; no pages
make no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.tables import Batches, narrow, stored
from boxloom.session import shared_folder

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of records a dictionary is trained on, its size, and bytes of payload after
#: which a task starts another archive.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 1 << 30
LEVEL = 3

#: Frame types (fixed values of the formats).
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
_DATE = "1970-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "path string, records bigint, bytes bigint"
_RECORDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
            "refers_to bigint, payload binary")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    header = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
    ]
    if url is not None:
        header.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~.-_' + chr(39))}")
    if refers_to is not None:
        header += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    header.append(f"Content-Length: {len(block)}")
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The parts of a record that :func:`record` wrote."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = lambda name: int(fields[name][10:-1]) if fields.get(name, "").startswith("<urn:page:") else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "refers_to": page("WARC-Refers-To"), "payload": None if revisit else payload,
    }


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records. Too few or too short ones to train on become the
    dictionary as they are."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """An archive being written: records wait until there are enough to train on. The
    stream is opened without the compression that pyarrow would guess from the name."""

    def __init__(self, files: fs.FileSystem, path: str) -> None:
        self.path, self.records, self.bytes, self.payload = path, 0, 0, 0
        self.out = files.open_output_stream(path, compression=None)
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        dictionary = train(self.waiting)
        content = dictionary.as_bytes()
        self._write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        for raw in self.waiting:
            self._write(self.compressor.compress(raw))
        self.waiting = []

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.payload += len(raw)
        if self.compressor is not None:
            self._write(self.compressor.compress(raw))
            return
        self.waiting.append(raw)
        self.waiting_bytes += len(raw)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self._start()

    def close(self) -> tuple[str, int, int]:
        if self.compressor is None:
            self._start()
        self.out.close()
        return self.path, self.records, self.bytes


def _write(batches: Batches, folder: str) -> Batches:
    """Write rows (page_id, url, html, refers_to) to archives; list the archives."""
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    done, archive = [], None
    for batch in batches:
        for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
            if archive is None:
                archive = _Archive(files, f"{root}/{uuid.uuid4().hex}.warc.zst")
            archive.add(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
            if archive.payload >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive = None
    if archive is not None:
        done.append(archive.close())
    yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d, strict=True)) for d in done],
                                     pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


def read_archive(stream) -> Iterator[bytes]:
    """The records of an open archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive starts with a dictionary frame")
    content = stream.read(size)
    trained = content[:4] == struct.pack("<I", 0xEC30A437)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    opened = zstandard.ZstdDecompressor(dict_data=dictionary)
    frame, parts, data = opened.decompressobj(), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(frame.decompress(data))
        data = b""
        if frame.eof:
            yield b"".join(parts)
            data = frame.unused_data
            frame, parts = opened.decompressobj(), []


def _read(batches: Batches, folder: str, payloads: bool) -> Batches:
    files, _ = fs.FileSystem.from_uri(folder)
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    rows: list[dict] = []
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with files.open_input_stream(path, compression=None) as stream:
                for raw in read_archive(stream):
                    parsed = parse(raw)
                    rows.append({n: parsed[n] if payloads or n != "payload" else None for n in names})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def deduplicated(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``, the page whose record holds the
    payload, where that is another one."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = narrow(pages, page_id="page_id", url="url", html="html", digest=F.sha1(payload), size=F.octet_length(payload))
    groups = (
        own.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "kept")
    )
    joined = own.join(stored(groups), "digest", "left")
    refers = F.when(F.col("kept") > F.coalesce("page_id", F.col("kept") - 1), F.col("kept"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below a folder that all executors share.
    Returns the list of archives: path, records, bytes."""
    return stored(deduplicated(pages).mapInArrow(partial(_write, folder=folder), _MANIFEST))


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of listed archives."""
    spark = archives.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return archives.repartition(parts, "path").mapInArrow(partial(_read, folder=folder, payloads=payloads), _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, read back, and report every record."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if ":/" in folder else f"file://{folder}"
    archives = write_archives(pages, folder)
    return read_archives(archives, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
