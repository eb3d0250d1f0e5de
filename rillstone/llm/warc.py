"""WARC archives as a Spark data source, written and read in Python.

Reading: the driver plans partitions from file sizes (small files share one, large files
written here are split at record bounds), record-type and header predicates are pushed down
to the reader, which parses a record's headers first and decodes its payload only where the
predicates hold. A gzip member written here carries its own compressed length in an extra
field, so an unwanted record is skipped by a seek; members without it are inflated and
discarded, uncompressed records are skipped by their content length.

Predicates travel as an option of the scan that ``read`` makes for its ``where`` argument.
The source takes none from filters put on a frame later: Spark keeps what was pushed down
to a relation for every other use of it, so a frame filtered twice would lose rows.

Writing: each task writes files under names of its own, a new one after ``ROLL_BYTES``, and
reports them with places where they can be split; the commit writes a manifest of the
reported files, and readers follow the manifest. What a lost or repeated task leaves behind
is never read.

Defined results: a null html is the empty payload; rows that repeat both page id and
payload are all responses if theirs is the largest id of its payload; a null page id is a
revisit wherever its payload has a row with an id; an empty table gives an archive without
records; columns other than page_id, url and html are not read. Page ids must be integers
for ``round_trip``, which reads them back from the record ids; others raise a TypeError.
"""

from __future__ import annotations

import base64
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO, Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rillstone.llm.common import bounded_batches, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, headers map<string,string>, payload binary"
#: Columns that are headers, by which records can be chosen before any payload is decoded.
_HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to")]
    + [("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
_MANIFEST = "_manifest.json"
_PARTITION_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20
#: A writing task begins a new file after so many bytes.
ROLL_BYTES = 1 << 30


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# -- records -------------------------------------------------------------------------------


def header_block(fields: list[tuple[str, str]]) -> bytes:
    clean = [(k, "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in v)) for k, v in fields]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode()


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that says how long it is, in an extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    extra = struct.pack("<2sHI", b"sl", 4, 12 + 8 + len(body) + 8)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(data: bytes) -> dict[str, str] | None:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _digest_hex(value: str | None) -> str | None:
    """A bare lower-case hex digest, from base32 or hex after the algorithm's name."""
    if not value:
        return None
    bare = value.split(":", 1)[-1]
    try:
        return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()
    except ValueError:
        return bare.lower()


def _column(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(_HEADER_OF[name])
    return _digest_hex(value) if name == "payload_digest" else value


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP head that responses and revisits carry."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.split(b"\r\n\r\n", 1)[1] if b"\r\n\r\n" in block else b""
    return block


class _Source:
    """Records of a file, compressed or not, in order: of a compressed one those that start in a range of bytes."""

    def __init__(self, stream: IO[bytes], wanted: Any, start: int = 0, end: int | None = None) -> None:  # noqa: ANN401
        self.stream, self.wanted, self.start, self.end = stream, wanted, start, end
        self.decoded = 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        head = self.stream.read(2)
        self.stream.seek(0)
        return self._members() if head == b"\x1f\x8b" else self._plain()

    def _plain(self) -> Iterator[tuple[dict[str, str], bytes]]:
        data, stream = b"", self.stream
        while True:
            while (end := data.lstrip(b"\r\n").find(b"\r\n\r\n")) < 0:
                more = stream.read(1 << 16)
                if not more:
                    return
                data += more
            data = data.lstrip(b"\r\n")
            headers = parse_headers(data[:end])
            if headers is None:
                raise ValueError("not a WARC record")
            data, size = data[end + 4 :], int(headers.get("content-length", "0"))
            if self.wanted(headers):
                if len(data) < size:
                    data += stream.read(size - len(data))
                self.decoded += 1
                yield headers, data[:size]
            elif len(data) < size:
                stream.seek(size - len(data), os.SEEK_CUR)
            data = data[size:] if len(data) >= size else b""

    def _members(self) -> Iterator[tuple[dict[str, str], bytes]]:
        stream, at = self.stream, self.start
        while self.end is None or at < self.end:
            stream.seek(at)
            data = stream.read(1 << 14)
            if not data:
                return
            length = None
            if data[3] & 4 and data[12:14] == b"sl":
                length = struct.unpack_from("<I", data, 16)[0]
            unpack = zlib.decompressobj(31)
            text, used = b"", 0
            while b"\r\n\r\n" not in text and not unpack.eof:
                text += unpack.decompress(data, 1 << 14)
                used += len(data) - len(unpack.unused_data if unpack.eof else unpack.unconsumed_tail)
                data = b"" if unpack.eof else unpack.unconsumed_tail or stream.read(1 << 14)
                if not data and not unpack.eof:
                    raise ValueError("a record ends early")
            end = text.find(b"\r\n\r\n")
            headers = parse_headers(text[:end]) if end >= 0 else None
            if headers is None:
                raise ValueError("not a WARC record")
            wanted = self.wanted(headers)
            if not wanted and length:
                at += length
                continue
            parts = [text[end + 4 :]]
            while not unpack.eof:
                piece = unpack.decompress(data, 1 << 20)
                used += len(data) - len(unpack.unused_data if unpack.eof else unpack.unconsumed_tail)
                if wanted:
                    parts.append(piece)
                data = b"" if unpack.eof else unpack.unconsumed_tail or stream.read(1 << 16)
                if not data and not unpack.eof:
                    raise ValueError("a record ends early")
            at += used
            if wanted:
                self.decoded += 1
                yield headers, b"".join(parts)[: int(headers.get("content-length", "0"))]


# -- the data source -----------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    """Ranges (path, first byte, end; none for the whole file) that one task reads."""

    ranges: tuple[tuple[str, int, int | None], ...]

    def __init__(self, ranges: tuple[tuple[str, int, int | None], ...]) -> None:
        super().__init__(0)
        self.ranges = ranges


@dataclass
class Written(WriterCommitMessage):
    #: Names of files, each with the places at which it can be split.
    files: tuple[tuple[str, tuple[int, ...]], ...]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, where: dict[str, list[str]] | None = None) -> None:
        self.path = path
        self.tests = {name: frozenset(values) for name, values in (where or {}).items()}

    def partitions(self) -> list[Files]:
        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Files(((root, 0, None),))]
        root = root.rstrip("/")
        listed = system.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = {f.path: f.size for f in listed if f.type == fs.FileType.File}
        if f"{root}/{_MANIFEST}" in sizes:
            with system.open_input_stream(f"{root}/{_MANIFEST}") as stream:
                files = [(f"{root}/{name}", cuts) for name, cuts in json.loads(stream.read())]
        else:
            files = [(n, ()) for n in sizes if not os.path.basename(n).startswith(("_", "."))]
        out, now, total = [], [], 0
        for path, cuts in sorted(files):
            for start, end in zip((0, *cuts), (*cuts, None), strict=True):
                size = (sizes[path] if end is None else end) - start
                if now and total + size > _PARTITION_BYTES:
                    out.append(Files(tuple(now)))
                    now, total = [], 0
                now.append((path, start, end))
                total += size
        return [*out, Files(tuple(now))]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all((_column(headers, name) if name in _HEADER_OF else headers.get(name.lower())) in values for name, values in self.tests.items())

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows: list[dict] = []
        size = 0
        for path, start, end in partition.ranges:
            with system.open_input_file(path) as stream:
                for headers, block in _Source(stream, self.wanted, start, end):
                    row = {name: _column(headers, name) for name in _HEADER_OF}
                    rows.append(row | {"content_length": int(headers.get("content-length", "0")), "headers": list(headers.items()), "payload": _payload(headers, block)})
                    size += len(block)
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceWriter):
    """Writes rows of headers (in order, as an array of name and value) and a block."""

    def __init__(self, path: str, roll: int = ROLL_BYTES, split: int = _PARTITION_BYTES) -> None:
        self.path, self.roll, self.split = path, roll, split

    def write(self, iterator: Iterator) -> Written:
        system, root = _filesystem(self.path)
        files: list[tuple[str, list[int]]] = []
        sink, size = None, 0
        for row in iterator:
            if sink is None:
                system.create_dir(root, recursive=True)
                files.append((f"part-{uuid.uuid4().hex}.warc.gz", []))
                sink, size = system.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
            cuts = files[-1][1]
            if size - (cuts[-1] if cuts else 0) >= self.split:
                cuts.append(size)
            block = bytes(row["block"])
            fields = [(h["name"], h["value"]) for h in row["headers"]] + [("Content-Length", str(len(block)))]
            record = member(header_block(fields) + block + b"\r\n\r\n")
            sink.write(record)
            size += len(record)
            if size >= self.roll:
                sink.close()
                sink = None
        if sink is not None:
            sink.close()
        return Written(tuple((name, tuple(cuts)) for name, cuts in files))

    def commit(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        if system.get_file_info(f"{root}/{_MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{_MANIFEST}") as stream:
                files += json.loads(stream.read())
        with system.open_output_stream(f"{root}/{_MANIFEST}") as sink:
            sink.write(json.dumps(sorted((name, list(cuts)) for name, cuts in files)).encode())

    def abort(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(self.options["path"], json.loads(self.options.get("where", "{}")))

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ANN001
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", ROLL_BYTES)), int(self.options.get("split_bytes", _PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


# -- pages to archives and back ------------------------------------------------------------

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id):  # noqa: ANN001, ANN202
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def page_records(pages: DataFrame, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(headers, block) of a record per page: of equal payloads of at least least_bytes, the largest page id is the response.

    Which page a payload refers to is settled on narrow rows; the pages themselves are
    shuffled once, by page id, so a payload that many pages share makes no task large.
    """
    base = pages.select(F.col("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("body"))
    keyed = base.withColumn("digest", F.sha1("body")).withColumn("size", F.length("body"))
    narrow = keyed.where(F.col("size") >= least_bytes).select("page_id", "digest")
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response")
    revisits = narrow.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("response"))).distinct()
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    marked = keyed.withColumn("key", key).join(revisits.select(key.alias("key"), "digest", F.col("response")), ["key", "digest"], "left")
    again = F.col("response").isNotNull()
    line = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    fields = [
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    extra = F.when(again, F.array(line("WARC-Refers-To", _record_id(F.col("response"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.array().cast("array<struct<name: string, value: string>>"))
    http = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")), "UTF-8")
    return marked.select(F.concat(F.array(*fields), extra).alias("headers"), F.when(again, http).otherwise(F.concat(http, F.col("body"))).alias("block"))


def write(records: DataFrame, path: str, **options: int) -> None:
    """Append records (headers, block) to the archives under a path; options roll_bytes and split_bytes."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, where: dict[str, str | list[str]] | None = None) -> DataFrame:
    """The records under a path.

    where: for header columns (record_type, target_uri and so on) or names of headers, the
    values that are wanted; it decides in the reader which records are decoded at all.
    Filters on the frame come after it and may be as many as one likes.
    """
    register(spark)
    wanted = {name: [v] if isinstance(v, str) else list(v) for name, v in (where or {}).items()}
    return spark.read.format("warc").option("where", json.dumps(wanted)).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages, then report each record from what the archives hold.

    Responses are decoded and measured; of revisits, which have no payload, only headers are read.
    """
    spark = pages.sparkSession
    if not isinstance(pages.schema["page_id"].dataType, IntegralType):
        raise TypeError("page ids must be integers")
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(page_records(pages), path)
    number = lambda name: F.try_to_number(F.regexp_extract(name, "<urn:page:(-?[0-9]+)>", 1), F.lit("S9999999999999999999")).cast("long")
    columns = lambda size, digest: [number("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("record_type"), number("refers_to").alias("refers_to")]
    full = read(spark, path, {"record_type": "response"}).select(*columns(F.length("payload"), F.sha1("payload")))
    again = read(spark, path, {"record_type": "revisit"}).select(*columns(F.col("headers")["x-payload-length"], F.col("payload_digest")))
    return full.union(again)


__all__ = ["WarcSource", "header_block", "member", "page_records", "parse_headers", "read", "register", "round_trip", "write"]
