"""WARC archives: one gzip member for each record, written by Spark tasks and read back as streams.

Equal payloads of at least ``min_revisit`` bytes are stored once, in the record with the largest id; the others
are ``revisit`` records that name it. The reader goes through an archive from front to end in bounded memory: it
inflates piece by piece, frames each block by Content-Length, and checks block and payload digests.

Cases: a null html is an empty payload; a null url leaves the target out; rows without an id are always
responses; rows that tie for the largest id are all responses; repeated rows give a record each; an empty table
gives no archive and no rows; extra columns are not stored. A damaged archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
#: Repeated payloads up to this number are sent to every task (about 60 bytes each).
BROADCAST_ROWS = 1_000_000
END = b"\r\n\r\n"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _digest(hasher) -> str:
    return "sha1:" + base64.b32encode(hasher.digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record as a gzip member: a response, or a revisit if it refers to another page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_digest(hashlib.sha1(payload))}",
        f"WARC-Block-Digest: {_digest(hashlib.sha1(block))}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            f"X-Payload-Length: {len(payload)}",
        ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block + END) + z.flush()


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the pages below ``path``; returns (path, records, bytes) of each archive.

    A task names its archives anew on each attempt, and only those of finished tasks are in the returned table.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha1(html).alias("digest"))
    digests = pages.where((F.octet_length("html") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest")
    last = stage(digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    # payloads of so many pages go to every task, so none of them meets in one; there are at most BROADCAST_ROWS of them
    n = last.count()
    often = last.agg(F.sum("n")).first()[0] // BROADCAST_ROWS + 1 if n > BROADCAST_ROWS else 2
    refs = digests.join(F.broadcast(last.where(F.col("n") >= often)), "digest")
    if often > 2:
        refs = refs.unionByName(digests.join(last.where(F.col("n") < often), "digest"))
    refs = refs.where("page_id < refers_to").select("digest", "page_id", "refers_to").distinct()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        done, out = [], None
        for batch in batches:
            for page_id, url, text, ref in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    done.append([name := f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0])
                    out = store.open_output_stream(name, compression=None)
                data = record(page_id, url, text.encode(), ref, date)
                out.write(data)
                done[-1][1:] = done[-1][1] + 1, done[-1][2] + len(data)
                if done[-1][2] >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    # by id, not by digest: a payload that many pages share would land in one task
    joined = pages.join(refs, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return stage(joined.mapInArrow(write, "path string, records long, bytes long"))


class _Block:
    """One record while its bytes come in."""

    def __init__(self, header: bytes, keep: bool):
        lines = header.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left = int(self.fields["content-length"])
        self.block, self.payload, self.size = hashlib.sha1(), hashlib.sha1(), 0
        self.http, self.body, self.keep, self.tail = b"", [], keep, b""

    def feed(self, data: bytes) -> None:
        mine, rest = data[: self.left], data[self.left :]
        self.left -= len(mine)
        self.tail += rest
        self.block.update(mine)
        if self.http is not None:
            self.http += mine
            head, mark, mine = self.http.partition(END)
            if not mark:
                return
            self.http = None
        self.payload.update(mine)
        self.size += len(mine)
        if self.keep:
            self.body.append(mine)

    def row(self) -> tuple:
        f = self.fields
        number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
        if self.left or self.tail != END:
            raise ValueError(f"{f.get('warc-record-id')}: the block doesn't end where Content-Length says")
        if f["warc-block-digest"] != _digest(self.block):
            raise ValueError(f"{f.get('warc-record-id')}: block digest differs")
        revisit = f["warc-type"] == "revisit"
        if not revisit and f["warc-payload-digest"] != _digest(self.payload):
            raise ValueError(f"{f.get('warc-record-id')}: payload digest differs")
        return (
            number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"],
            int(f["x-payload-length"]) if revisit else self.size,
            base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex(),
            number(f.get("warc-refers-to")), b"".join(self.body) if self.keep and not revisit else None,
        )


def read_archive(stream, keep: bool) -> Iterator[tuple]:
    """The records of one archive, member by member."""
    data = stream.read(CHUNK)
    while data:
        z, head, block = zlib.decompressobj(31), b"", None
        while not z.eof:
            if not data and not (data := stream.read(CHUNK)):
                raise ValueError("the archive ends inside a record")
            piece = z.decompress(data, CHUNK)
            data = z.unconsumed_tail if not z.eof else z.unused_data
            if block is None:
                head += piece
                top, mark, piece = head.partition(END)
                if not mark:
                    continue
                block = _Block(top, keep)
            block.feed(piece)
        if block is None:
            raise ValueError("a record without header")
        yield block.row()
        data = data or stream.read(CHUNK)


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives in column ``path``; ``payloads`` also returns what responses hold."""
    folder = shared_dir(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in read_archive(stream, payloads):
                        rows.append(row)
                        held += 200 + (row[3] if payloads else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(read, RECORD)


def broken_revisits(rows: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, records) of revisits whose response is missing or holds another payload."""
    asked = rows.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("records"))
    there = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return asked.join(there, ["refers_to", "payload_digest"], "left_anti")
