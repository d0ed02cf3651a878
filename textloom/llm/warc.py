"""WARC archives as a PySpark Python data source, and storing pages in them with revisit records for equal payloads.

Reading: one partition a file; equality and IN predicates on record_type, target_uri, page_id and payload_digest are
pushed down. Headers are parsed first; a record that the predicates drop, or whose payload the schema does not ask for,
is passed by seeking over its block. Writing: a file for each task (a new one after FILE_BYTES); the commit writes a
manifest of the files of successful attempts, and readers read only these, so lost or repeated tasks leave no records.
Files are reached through pyarrow's file systems, so any store that these know will do.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from . import common
from .common import cut, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, page_id string, refers_to string, payload_digest string, payload_length long, payload binary"
FILE_BYTES = 256 << 20
MANIFEST = "_manifest.json"
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "page_id": "x-page-id", "refers_to": "x-refers-to-page", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _field(headers: dict[str, str], name: str):
    value = headers.get(_HEADERS[name])
    if value is None:
        return None
    if name == "payload_digest":
        return value.removeprefix("sha1:")
    return int(value) if name == "payload_length" else value


def _end(stream) -> None:
    """Reads the two line ends behind a block, which are missing if it was cut off, passed over or not."""
    if stream.read(4) != b"\r\n\r\n":
        raise ValueError("a record ends before its length")


def records(stream, wants_payload: bool, keep=lambda headers: True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and payload of the records that keep accepts. Other blocks are passed by seeking."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record must begin with its version")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        if not keep(headers):
            stream.seek(length, 1)
            _end(stream)
            continue
        payload = None
        if wants_payload and headers.get("warc-type") != "revisit":
            block = stream.read(length)
            head = block.find(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else -4
            payload = block[head + 4 :] if head >= -4 else block
        else:
            stream.seek(length, 1)
        _end(stream)
        yield headers, payload


class _Range(InputPartition):
    def __init__(self, file: str | None):
        self.file = file


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names, self.tests = path, schema.fieldNames(), []
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS and f.attribute[0] != "payload_length":
                self.tests.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        store, root = _open(self.path)
        info = store.get_file_info(f"{root}/{MANIFEST}")
        if info.type == pafs.FileType.File:
            with store.open_input_stream(info.path) as s:
                files = [f"{root}/{x}" for x in json.loads(s.read())]
        else:
            files = [x.path for x in store.get_file_info(pafs.FileSelector(root)) if x.path.endswith((".warc", ".warc.gz"))]
        return [_Range(x) for x in sorted(files)] or [_Range(None)]

    def read(self, partition: _Range):
        if partition.file is None:
            return
        store, _ = _open(self.path)
        keep = lambda h: all(_field(h, name) in values for name, values in self.tests)
        wants = "payload" in self.names
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_length" else pa.string()) for n in self.names])
        with store.open_input_file(partition.file) as raw:
            stream = gzip.open(raw) if partition.file.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
            rows, size = [], 0
            for headers, payload in records(stream, wants, keep):
                rows.append([payload if n == "payload" else _field(headers, n) for n in self.names])
                size += len(payload or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Done(WriterCommitMessage):
    files: list[str]


def record_bytes(kind: str, page_id, uri: str | None, digest: str, length: int, refers_to, payload: bytes) -> bytes:
    """One record; a response holds an HTTP head and the payload, a revisit no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Rows: page_id, url, html, digest, record_type, refers_to."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, root = _open(self.path)
        store.create_dir(root)
        files, out, size = [], None, 0
        for b in iterator:
            columns = [b.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "record_type", "refers_to")]
            for page, url, html, digest, kind, refers in zip(*columns, strict=True):
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc")
                    out, size = store.open_output_stream(f"{root}/{files[-1]}"), 0
                payload = (html or "").encode()
                record = record_bytes(kind, page, url, digest, len(payload), refers, payload)
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
        return _Done(files)

    def commit(self, messages):
        store, root = _open(self.path)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{MANIFEST}") as s:
            s.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages):
        store, root = _open(self.path)
        for m in messages:
            for x in m.files if m is not None else []:
                store.delete_file(f"{root}/{x}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); with .schema(...) only the columns named are decoded."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


LEAST_BYTES = 1000
#: Tasks over which the pages of one payload are spread where they have to be shuffled.
SALTS = 32


def store(pages: DataFrame, path: str) -> None:
    """Writes a record a row of pages: of rows with equal payloads of LEAST_BYTES at least, the one with the largest page_id as response, others as revisits of it.

    A null html is an empty payload. Rows without a page_id are responses of their own unless another row with their
    payload has one. Of rows that repeat the largest page_id with that payload, all are responses. Very large payloads are
    written whole. Other columns, whatever their names, are not looked at. Only digests that occur twice are joined, by
    broadcast if a count allows it; beyond that pages are shuffled once, a common page's over SALTS tasks.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    large = F.col("n") >= LEAST_BYTES
    twice = cut(rows.where(large).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("first")).where((F.col("copies") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("d"), "first"))
    if twice.count() <= common.BROADCAST_ROWS:
        both = rows.join(F.broadcast(twice), (F.col("digest") == F.col("d")) & large, "left")
    else:
        salted = twice.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # SALTS short rows for each
        rows = rows.withColumn("salt", F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")))
        both = rows.join(salted, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = both.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))
    out.write.format("warc").mode("append").save(path)


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages' records, as read back from their archives.

    Responses' payloads are read and digested anew, very large ones too; of revisits only headers are read. A null html is
    an empty payload. A repeated page gives a row each time; of equal payloads the largest page_id is the response; an
    empty table gives an empty result; other columns, whatever their names, are not looked at. The archives stay in a
    folder warc-<number> of the shared folder, as the result is read from them when it is used.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store(pages, path)
    kind = pages.schema["page_id"].dataType
    load = spark.read.format("warc")
    full = load.schema("page_id string, record_type string, payload binary").load(path).where(F.col("record_type") == "response")
    heads = spark.read.format("warc").schema("page_id string, record_type string, refers_to string, payload_digest string, payload_length long").load(path).where(F.col("record_type") == "revisit")
    a = full.select(F.col("page_id").cast(kind), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    b = heads.select(F.col("page_id").cast(kind), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(kind))
    return a.unionByName(b)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n >= 1000) ELSE page_id END AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN m IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m IS DISTINCT FROM page_id THEN m END AS refers_to
FROM r"""
