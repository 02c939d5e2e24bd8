"""WARC archives: records of web pages, a normaliser for whole-file gzip, a sidecar index, and a reader.

An archive that was compressed as one gzip stream can only be read from its start.  The
normaliser inflates such a file once, as a stream; every record is deflated again as a
gzip member of its own, and a line of the sidecar index (JSON) says where that member
begins and how long it is.  With the index, records are read by place, and the records
of one file are shared out over tasks.

``write_archives`` turns pages into records and writes them as such monolithic files.  Of
pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the least key
(then the least address) is a response; the others are revisits, which refer to it and
leave the payload out.  Equal payloads combine in every task and one of them moves, so a
payload of a third of all pages is no burden; revisits are counted rows without a payload,
and adaptive execution splits what their join leaves.

Files are opened by ``pyarrow.fs`` from the folder's address, which every executor must
reach.  Each attempt of a task writes files under new names and only those of the
attempts that count are listed (``stored``), so a lost executor leaves at most files that
no list names.  A stream holds one piece of a record at a time; a record's header, and
where payloads are asked for, its payload, are held whole.

Defined cases: a null payload is empty; a null key has no key field and sorts last; a
null address has no address field; equal rows are one record each; small payloads are
responses even if equal; line breaks in an address are written as %0D and %0A; archives
with one or several gzip members are read alike; an empty archive has no records; one
that ends inside a record or has a record without a length is refused (ValueError);
empty tables give no files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BufferedReader
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
PIECE = 1 << 18
RANGE = 4 << 20
COPIES = 4096
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = "WARC/1.1"
GZIP = 31
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"


# --- one record ---------------------------------------------------------------------


def record_id(page: str | None, url: str | None, digest: str, copy: int) -> str:
    name = json.dumps([page, url, digest, copy])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def header_of(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [VERSION, *[f"{k}: {one_line(v)}" for k, v in fields if v is not None], "", ""]
    return "\r\n".join(lines).encode()


def page_record(
    page: str | None, url: str | None, payload: bytes | None, size: int, digest: str, date: str, copy: int = 0,
    original: tuple[str | None, str | None] | None = None,
) -> Iterator[bytes]:
    """A response record, or with the key and address of ``original`` a revisit record, in pieces; ``size`` is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = b"" if original else payload
    fields = [
        ("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", record_id(page, url, digest, copy)),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page),
    ]
    if original:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*original, digest, 0)),
            ("WARC-Refers-To-Target-URI", original[1]), ("X-Refers-To-Page-ID", original[0]),
        ]
    yield header_of([*fields, ("Content-Type", HTTP_TYPE), ("Content-Length", str(len(http) + len(body)))])
    yield http
    for at in range(0, len(body), PIECE):
        yield body[at : at + PIECE]
    yield b"\r\n\r\n"


class Inflated:
    """The inflated bytes of a gzip file of any number of members, read once from the front."""

    def __init__(self, source: BinaryIO, name: str):
        self.source, self.name = source, name
        self.inflater, self.compressed, self.held = zlib.decompressobj(GZIP), b"", b""
        self.begun = False

    def more(self) -> bool:
        """Inflate another piece; whether there was one."""
        while True:
            if not self.compressed:
                self.compressed = self.source.read(PIECE)
                if not self.compressed:
                    if self.begun and not self.inflater.eof:
                        raise ValueError(f"{self.name} ends inside a gzip member")
                    return False
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(GZIP)
            self.begun = True
            try:
                piece = self.inflater.decompress(self.compressed, PIECE)
            except zlib.error as error:
                raise ValueError(f"{self.name} is no whole gzip file: {error}") from error
            self.compressed = self.inflater.unconsumed_tail or self.inflater.unused_data
            if piece:
                self.held += piece
                return True

    def line(self) -> bytes:
        """The bytes up to and with the next line feed; empty at the end."""
        searched = 0
        while (at := self.held.find(b"\n", searched)) < 0:
            searched = len(self.held)
            if not self.more():
                at = len(self.held) - 1
                break
        out, self.held = self.held[: at + 1], self.held[at + 1 :]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes."""
        while size:
            if not self.held and not self.more():
                raise ValueError(f"{self.name} ends inside a record")
            out, self.held = self.held[:size], self.held[size:]
            size -= len(out)
            yield out


@dataclass
class Record:
    """A record's header; its block is what ``block`` yields, and must be read before the next record."""

    version: str
    fields: dict[str, str]
    head: bytes
    length: int
    stream: Inflated = field(repr=False)

    def get(self, name: str) -> str | None:
        return self.fields.get(name.lower())

    def block(self) -> Iterator[bytes]:
        return self.stream.pieces(self.length)


def records(source: BinaryIO, name: str) -> Iterator[Record]:
    """The records of a gzip archive, in order."""
    stream = Inflated(source, name)
    while True:
        line = stream.line()
        while line in (b"\r\n", b"\n"):
            line = stream.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name} has no record where one should begin: {line[:40]!r}")
        head, fields, last = [line], {}, None
        while (line := stream.line()).strip(b"\r\n"):
            head.append(line)
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:
                fields[last] += " " + text.strip()
            else:
                key, _, value = text.partition(":")
                last = key.strip().lower()
                fields[last] = value.strip()
        if not line or not fields.get("content-length", "").isdigit():
            raise ValueError(f"{name} has a record without a length or an end of its header")
        record = Record(head[0].decode("ascii", "replace").strip(), fields, b"".join(head) + line, int(fields["content-length"]), stream)
        yield record


def payload_pieces(record: Record) -> Iterator[bytes]:
    """The payload of a record: its block, less the HTTP header where it is an HTTP message."""
    if not (record.get("content-type") or "").startswith("application/http"):
        yield from record.block()
        return
    held, inside = b"", False
    for piece in record.block():
        if inside:
            yield piece
            continue
        held += piece
        at = held.find(b"\r\n\r\n")
        if at >= 0:
            inside = True
            yield held[at + 4 :]
            held = b""


def normalise_stream(source: BinaryIO, target: BinaryIO, name: str) -> Iterator[dict]:
    """Write every record of ``source`` as a gzip member of its own to ``target``; an index entry for each."""
    offset = 0
    for record in records(source, name):
        deflater, length = zlib.compressobj(LEVEL, wbits=GZIP), 0

        def put(piece: bytes) -> int:
            target.write(piece)
            return len(piece)

        length += put(deflater.compress(record.head))
        for piece in record.block():
            length += put(deflater.compress(piece))
        length += put(deflater.compress(b"\r\n\r\n"))
        length += put(deflater.flush())
        yield {
            "offset": offset, "length": length, "type": record.get("warc-type"), "record_id": record.get("warc-record-id"),
            "uri": record.get("warc-target-uri"), "digest": record.get("warc-payload-digest"),
        }
        offset += length


# --- on Spark -----------------------------------------------------------------------


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _new_file(folder: str, kind: str) -> tuple[str, fs.FileSystem, str]:
    system, at = opened(folder)
    system.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex}.{kind}"
    return f"{folder}/{name}", system, f"{at}/{name}"


def page_rows(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """The records to write: a page with the numbers ``start`` to ``stop`` of its copies, and for revisits the key and address of the response.

    A payload moves once, to the one response that has it; revisits are counted rows without one.
    """
    payload = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    taken = pages.select(
        F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    order = F.struct(F.col("page").isNull().alias("no_page"), "page", F.col("url").isNull().alias("no_url"), "url")
    large, one = taken.filter(F.col("size") >= least), F.lit(1).cast("long")

    def parts(rows: DataFrame) -> DataFrame:
        """Rows whose copies are numbered, cut into runs that are dealt out anew."""
        starts = F.explode(F.sequence("start", F.col("copies") - 1, F.lit(COPIES).cast("long")))
        runs = rows.filter("copies > start").withColumn("start", starts).withColumn("stop", F.least(F.col("start") + COPIES, "copies"))
        return runs.drop("copies").repartition("digest", "page", "url", "start")

    nobody = [F.lit(None).cast("string").alias("first_page"), F.lit(None).cast("string").alias("first_url")]
    firsts = large.groupBy("digest").agg(F.min(order).alias("first"), F.first("payload").alias("payload"), F.first("size").alias("size"))
    responses = firsts.select(
        F.col("first.page").alias("page"), F.col("first.url").alias("url"), "payload", "size", "digest", (one - 1).alias("start"), one.alias("stop"), *nobody
    )
    small = taken.filter(F.col("size") < least).groupBy("page", "url", "payload", "size", "digest").agg(F.count(F.lit(1)).alias("copies"))
    small = parts(small.select("*", (one - 1).alias("start"), *nobody))
    repeated = large.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    copies = large.groupBy("page", "url", "size", "digest").agg(F.count(F.lit(1)).alias("copies"))
    is_first = F.col("page").eqNullSafe(F.col("first.page")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisits = parts(copies.join(repeated, "digest").select(
        "page", "url", F.lit(None).cast("binary").alias("payload"), "size", "digest", "copies", F.when(is_first, one).otherwise(one - 1).alias("start"),
        F.col("first.page").cast("string").alias("first_page"), F.col("first.url").alias("first_url"),
    ))
    rows = responses.withColumn("revisit", F.lit(False)).unionByName(small.withColumn("revisit", F.lit(False))).unionByName(
        revisits.withColumn("revisit", F.lit(True))
    )
    return rows.withColumn("page", F.col("page").cast("string"))


def _tasks(spark: SparkSession, pieces: int) -> int:
    """Tasks for so many pieces of work, each much longer than its row: adaptive execution would put them together."""
    return max(1, min(2 * pieces, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)))


def write_archives(rows: DataFrame, folder: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``page_rows`` as monolithic gzip archives of about ``file_bytes``; (path, records) of each, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = deflater = None
        count = size = 0

        def closed() -> pa.RecordBatch:
            out.write(deflater.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            for r in batch.to_pylist():
                for copy in range(r["start"], r["stop"]):
                    if out is None:
                        path, system, at = _new_file(folder, "warc.gz")
                        out, deflater = system.open_output_stream(at, compression=None), zlib.compressobj(LEVEL, wbits=GZIP)
                        count = size = 0
                    original = (r["first_page"], r["first_url"]) if r["revisit"] else None
                    for piece in page_record(r["page"], r["url"], r["payload"], r["size"], r["digest"], date, copy, original):
                        out.write(deflater.compress(piece))
                        size += len(piece)
                    count += 1
                    if size >= file_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return stored(rows.mapInArrow(run, "path string, records bigint"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives named by ``path``, each with a sidecar index; (source, path, index, records), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                system, at = opened(source)
                path, out_system, out_at = _new_file(folder, "warc.gz")
                with (
                    system.open_input_stream(at, compression=None) as reads, out_system.open_output_stream(out_at, compression=None) as writes,
                    out_system.open_output_stream(f"{out_at}.index", compression=None) as index,
                ):
                    count = 0
                    for entry in normalise_stream(reads, writes, source):
                        index.write(json.dumps(entry).encode() + b"\n")
                        count += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source]), pa.array([path]), pa.array([f"{path}.index"]), pa.array([count], pa.int64())],
                    names=["source", "path", "index", "records"],
                )

    files = archives.select("path").repartition(_tasks(archives.sparkSession, archives.count()), "path")
    return stored(files.mapInArrow(run, "source string, path string, index string, records bigint"))


INDEX = "path string, offset bigint, length bigint, type string, record_id string, uri string, digest string"


def index_entries(normalised: DataFrame) -> DataFrame:
    """The entries of all sidecar indexes."""
    entry = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *[(c, pa.string()) for c in ("type", "record_id", "uri", "digest")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(*[c.to_pylist() for c in batch.columns]):
                system, at = opened(index)
                with system.open_input_stream(at, compression=None) as source:
                    entries = []
                    for line in BufferedReader(source):
                        entries.append(json.loads(line) | {"path": path})
                        if len(entries) == 4096:
                            yield pa.RecordBatch.from_pylist(entries, schema=entry)
                            entries = []
                    yield pa.RecordBatch.from_pylist(entries, schema=entry)

    return normalised.select("path", "index").mapInArrow(run, INDEX)


def read_records(entries: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the index entries: header fields, size and SHA-256 of the payload, and the payload itself if asked for.

    A revisit has no payload of its own; its digest is the one it names and its size that of the HTTP header.
    """
    names = ["path", "offset", "type", "record_id", "uri", "page", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    schema = "path string, offset bigint, type string, record_id string, uri string, page string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_path = source = None
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            rows = []
            for path, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if path != at_path:
                    if source is not None:
                        source.close()
                    system, at = opened(path)
                    at_path, source = path, system.open_input_file(at)
                source.seek(offset)
                record = next(records(pa.BufferReader(source.read_buffer(length)), f"{path} at {offset}"))
                digest, size, kept = hashlib.sha256(), 0, []
                for piece in payload_pieces(record) if record.get("warc-type") != "revisit" else ():
                    digest.update(piece)
                    size += len(piece)
                    if payloads:
                        kept.append(piece)
                known = digest.hexdigest()
                if record.get("warc-type") == "revisit":
                    http = dict(x.lower().split(b":", 1) for x in b"".join(record.block()).split(b"\r\n")[1:] if b":" in x)
                    known, size = (record.get("warc-payload-digest") or "").rpartition(":")[2], int(http[b"content-length"])
                rows.append((
                    path, offset, record.get("warc-type"), record.get("warc-record-id"), record.get("warc-target-uri"), record.get("x-page-id"),
                    record.get("x-refers-to-page-id"), size, known, b"".join(kept) if payloads and record.get("warc-type") != "revisit" else None,
                ))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if source is not None:
            source.close()

    pieces = entries.select(F.ceil(F.sum("length") / RANGE)).head()[0] or 0
    piece = F.floor(F.col("offset") / RANGE)
    dealt = entries.select("path", "offset", "length").repartition(_tasks(entries.sparkSession, pieces), "path", piece).sortWithinPartitions("path", "offset")
    done = dealt.mapInArrow(run, schema)
    return done if payloads else done.drop("payload")
