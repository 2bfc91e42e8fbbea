"""WARC archives, each record a Zstandard frame, with a dictionary in a leading skippable frame.

A file begins with a skippable frame that holds a dictionary trained from the file's own first
records; every record then is a frame of its own, compressed with that dictionary, so a reader needs
nothing but the file and can start at any record. A file of too few records to train has no such
frame. Of records with equal payloads, that with the smallest id holds it (``response``); the others
are ``revisit`` records that refer to it.

Which record is which is settled by narrow rows (id and SHA-1) before any payload moves; the
payloads are joined with that by id, so a payload that very many pages share doesn't meet in a task.

Defined results: a null payload is empty; a null url gives a record without a target; rows without an id
are ``response`` records; rows that repeat id and payload of a response are responses too; rows that
repeat an id with another payload are told apart by the payload. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stored, utf8
from shelfcast.llm.files import Writer, chunks, task_file
from shelfcast.session import new_scratch

#: Fixed values of the format: the skippable frame for a dictionary, and the line end.
SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"

FILE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
#: Records, and bytes of them, that a file's dictionary is trained from.
TRAIN_RECORDS = 512
TRAIN_BYTES = 2 << 20
LEAST_RECORDS = 16
LEVEL = 3
MOST_TASKS = 20_000
DATE = "2020-01-01T00:00:00Z"


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str | None
    payload: bytes
    payload_bytes: int
    sha1: bytes
    refers_to: int | None

    def digest(self) -> str:
        return base64.b32encode(self.sha1).decode()

    def serialised(self, number: int) -> bytes:
        """The record's WARC bytes. number: makes the record id of a page without an id."""
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(self.payload)
        block = head if self.refers_to is not None else head + self.payload
        name = f"urn:page:{self.page_id}" if self.page_id is not None else f"urn:page-without-id:{number}"
        fields = [
            ("WARC-Type", "response" if self.refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<{name}>"),
            ("WARC-Date", DATE),
            ("WARC-Payload-Digest", f"sha1:{self.digest()}"),
            ("X-Payload-Length", str(self.payload_bytes)),
        ]
        if self.url is not None:
            fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in self.url)))
        if self.refers_to is not None:
            fields.append(("WARC-Refers-To", f"<urn:page:{self.refers_to}>"))
            fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
        text = "".join(f"{k}: {v}\r\n" for k, v in fields)
        return b"WARC/1.1" + CRLF + utf8(text) + CRLF + block + CRLF + CRLF


def parse(raw: bytes) -> Record:
    """A record from its bytes; the payload of a revisit is empty. Raises if a payload doesn't fit its digest."""
    head, _, rest = raw.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.decode("utf-8", "surrogatepass").split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(CRLF + CRLF)[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    name = fields["WARC-Record-ID"].strip("<>")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(fields["X-Payload-Length"])
    if not revisit and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
        raise ValueError(f"payload of {name} doesn't fit its digest")
    return Record(
        int(name.removeprefix("urn:page:")) if name.startswith("urn:page:") else None,
        fields.get("WARC-Target-URI"),
        payload,
        size,
        digest,
        int(fields["WARC-Refers-To"].strip("<>").removeprefix("urn:page:")) if revisit else None,
    )


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the first records, or None if they are too few."""
    if len(samples) < LEAST_RECORDS:
        return None
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:  # too little in common, or too short
        return None


class ArchiveWriter:
    """One archive; records wait until there are enough for the dictionary."""

    def __init__(self, path: str) -> None:
        self.out = Writer(path)
        self.waiting: list[bytes] = []
        self.held, self.records = 0, 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: Record) -> None:
        raw = record.serialised(self.records)
        self.records += 1
        if self.compressor:
            self.out.write(self.compressor.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if len(self.waiting) >= TRAIN_RECORDS or self.held >= TRAIN_BYTES:
            self._start()

    def _start(self) -> None:
        dictionary = train(self.waiting)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
        for raw in self.waiting:
            self.out.write(self.compressor.compress(raw))
        self.waiting.clear()

    def close(self) -> tuple[str, int, int]:
        with self.out:
            if not self.compressor:
                self._start()
        return self.out.path, self.records, self.out.size


def read_archive(path: str) -> Iterator[Record]:
    """All records of an archive, frame by frame, by a stream."""
    decompressor: zstandard.ZstdDecompressor | None = None
    pending = b""
    source = chunks(path)
    current = None
    parts: list[bytes] = []
    while True:
        if current is None:
            while len(pending) < 8 and (more := next(source, b"")):
                pending += more
            if not pending:
                return
            if decompressor is None:
                dictionary = None
                magic, size = struct.unpack("<II", pending[:8])
                if magic == SKIPPABLE:
                    while len(pending) < 8 + size:
                        pending += next(source)
                    raw = zstandard.ZstdDecompressor().decompress(pending[8 : 8 + size])
                    dictionary, pending = zstandard.ZstdCompressionDict(raw), pending[8 + size :]
                decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
                continue
            current = decompressor.decompressobj()
        parts.append(current.decompress(pending))
        pending = b""
        if current.eof:
            pending = current.unused_data
            yield parse(b"".join(parts))
            current, parts = None, []
        else:
            pending = next(source, b"")
            if not pending:
                raise ValueError(f"{path} ends within a record")


def _write(folder: str, file_bytes: int):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        archive: ArchiveWriter | None = None
        done = []
        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or ArchiveWriter(task_file(folder, ".warc.zst"))
                payload = utf8(html)
                archive.add(Record(page, url, payload, len(payload), hashlib.sha1(payload).digest(), refers_to))
                if archive.out.size >= file_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes every row as a record; (path, records, bytes) of the archives.

    Payloads of fewer than ``least_bytes`` are never revisits. folder: by default in the session's shared folder.
    """
    folder = folder or new_scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = rows.withColumn("sha", F.sha1(payload))
    narrow = stored(keyed.where((F.octet_length(payload) >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha"), "warc-digests")
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    firsts = stored(firsts.where("refers_to <> last").drop("last"), "warc-firsts")
    revisits = stored(narrow.join(firsts, "sha").where("page_id > refers_to").distinct(), "warc-revisits")
    placed = keyed.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")
    return stored(placed.mapInArrow(_write(folder, file_bytes), "path string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; url and payload if asked for."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in read_archive(path):
                    kind = "response" if r.refers_to is None else "revisit"
                    row = {"page_id": r.page_id, "payload_bytes": r.payload_bytes, "payload_digest": r.digest(), "record_type": kind, "refers_to": r.refers_to}
                    rows.append(row | ({"url": r.url, "payload": r.payload} if payloads else {}))
                    held += len(r.payload)
                    if len(rows) >= 10_000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("url", pa.string()), ("payload", pa.binary())] if payloads else []
    schema = pa.schema(fields)
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if payloads else "")
    # About one archive a task; the number is given, since by their few bytes the paths would all go to one.
    files = archives.select("path").repartition(min(MOST_TASKS, max(1, archives.count())), "path")
    return files.mapInArrow(run, ddl)
