"""WARC archives as a Spark data source, written and read in parallel.

Records are gzip members of their own whose extra field `sl` tells their length, so
a reader inflates only the start of a record to get its headers and steps over the
payloads that nobody asked for. The reader plans partitions of whole files, takes
over predicates on the record type and the other header columns, tests them as soon
as the headers are parsed, and decodes a payload only if it is wanted. Writers name
their files in a manifest on commit, so files of lost or repeated tasks don't count.

Null payloads count as empty and null or odd addresses are written without or with
escapes. Of equal payloads the smallest page_id is the response; rows that repeat it
are responses too. A null page_id is only a response where no other row has the
payload. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from tidemark.llm import text as tx

SCHEMA = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload string"
FILE_BYTES = 128 << 20
DATE = "1970-01-01T00:00:00Z"
CHUNK = 16 << 10  # compressed bytes that are read at a time while headers are looked for


#: Schemes of Spark's file systems that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _open(path: str):
    """The file system of a path and the path in it; other schemes than pyarrow's and SCHEMES are an error of its."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or not re.fullmatch(r"[a-z][a-z0-9+.-]*", scheme):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, digest: str) -> bytes:
    """A gzip member with one response or revisit; a revisit keeps the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    data = packer.compress(raw) + packer.flush()
    size = 24 + len(data) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw))
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, out, size = [], None, 0
        fs, root = _open(self.path)
        for batch in iterator:
            for page_id, url, html, digest, first in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")]):
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                revisit = first is not None and page_id != first
                data = record(page_id, url, (html or "").encode(), first, revisit, base64.b32encode(bytes.fromhex(digest)).decode())
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        mine = [f for m in messages if m is not None for f in m.files]
        before = [] if self.overwrite else manifest(self.path)
        with fs.open_output_stream(f"{root}/_files.json", compression=None) as out:
            out.write(json.dumps(before + mine).encode())

    def abort(self, messages) -> None:
        fs, root = _open(self.path)
        for f in [f for m in messages if m is not None for f in m.files]:
            fs.delete_file(f"{root}/{f}")


def manifest(path: str) -> list[str]:
    from pyarrow import fs as kinds

    fs, root = _open(path)
    if fs.get_file_info(f"{root}/_files.json").type == kinds.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/_files.json", compression=None) as f:
        return json.loads(f.read())


def parse_headers(raw: bytes) -> dict[str, str]:
    """WARC headers by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


@dataclass
class Files(InputPartition):
    files: list[str]


_COLUMNS = ("page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify = path, payload, verify
        self.tests: list[Filter] = []

    def partitions(self):
        fs, root = _open(self.path)
        names = manifest(self.path)
        sizes = [x.size for x in fs.get_file_info([f"{root}/{n}" for n in names])] if names else []
        parts, size = [], FILE_BYTES
        for n, s in sorted(zip(names, sizes)):
            if size + s > FILE_BYTES // 8 or not parts:
                parts.append([])
                size = 0
            parts[-1].append(n)
            size += s
        return [Files(p) for p in parts] or [Files([])]

    def _passes(self, row: dict) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            if v is None:
                return False
            if isinstance(f, EqualTo) and v != f.value or isinstance(f, In) and v not in f.value or isinstance(f, StringStartsWith) and not v.startswith(f.value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, root = _open(self.path)
        for name in partition.files:
            with fs.open_input_file(f"{root}/{name}") as f:
                at, size = 0, f.size()
                while at < size:
                    f.seek(at)
                    start = f.read(24)
                    if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
                        raise ValueError(f"{name}: no record with a length at {at}")
                    length, whole = struct.unpack("<II", start[16:24])
                    yield from self._record(f, length, whole)
                    at += length

    def _record(self, f, length: int, whole: int):
        left, inflate, raw = length - 32, zlib.decompressobj(-15), bytearray()

        def end_of_headers(start: int) -> int:
            """Where the empty line after start ends; inflates as much as it takes."""
            nonlocal left
            while (at := raw.find(b"\r\n\r\n", start)) < 0:
                start = max(start, len(raw) - 3)
                data = inflate.unconsumed_tail
                if not data:
                    if not left:
                        raise ValueError("no end of the headers")
                    data = f.read(min(left, CHUNK))
                    left -= len(data)
                raw.extend(inflate.decompress(data, CHUNK // 4))
            return at + 4

        block = end_of_headers(0)
        headers = parse_headers(bytes(raw[:block]))
        end = end_of_headers(block)
        http = dict(x.lower().split(b": ", 1) for x in bytes(raw[block : end - 4]).split(b"\r\n")[1:])
        number = lambda k: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", headers.get(k, ""))) else None
        row = {
            "page_id": number("warc-record-id"), "record_type": headers["warc-type"], "url": _unescaped(headers.get("warc-target-uri")),
            "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(http[b"content-length"]), "refers_to": number("warc-refers-to"),
        }
        if not self._passes(row):
            return
        payload = None
        if (self.payload or self.verify) and row["record_type"] == "response":
            rest = inflate.unconsumed_tail + (f.read(left) if left else b"")
            body = (bytes(raw[end:]) + inflate.decompress(rest) + inflate.flush())[: block + int(headers["content-length"]) - end]
            if self.verify:
                found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                if found != (row["payload_bytes"], row["payload_digest"]):
                    raise ValueError(f"payload of page {row['page_id']} doesn't match its length or digest")
                row["payload_bytes"], row["payload_digest"] = found
            payload = body.decode() if self.payload else None
        yield (*[row[c] for c in _COLUMNS], payload)


class FilteredWarcReader(WarcReader):
    """Takes over predicates. Spark keeps them with the loaded relation, so each relation serves one set of them."""

    def pushFilters(self, filters):
        for f in filters:
            simple = isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS
            if simple:
                self.tests.append(f)
            else:
                yield f


def _unescaped(url: str | None) -> str | None:
    return None if url is None else re.sub(r"%(25|[01][0-9A-F]|20|7F)", lambda m: chr(int(m[1], 16)), url)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        kind = FilteredWarcReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader
        return kind(self.options["path"], self.options.get("payload", "true").lower() == "true", self.options.get("verify", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives pages (page_id, url, html); of equal payloads of least_bytes or more all but the first are revisits."""
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = rows.join(firsts, "digest").withColumn("first", F.when(F.octet_length("payload") >= least_bytes, F.col("first")))
    joined.select("page_id", "url", "payload", "digest", "first").write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False, where: Column | str | None = None) -> DataFrame:
    """The records of an archive; `where` is pushed down to the reader as far as it tests single header columns.

    Spark pushes predicates down when it plans a query, so with `where` the session keeps
    spark.sql.python.filterPushdown.enabled on; sources without pushFilters aren't affected.
    """
    register(spark)
    if where is not None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).option("pushdown", str(where is not None)).load(path)
    return found if where is None else found.where(where)


def new_folder(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    path = f"{tx.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    return path
