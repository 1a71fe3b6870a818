"""Deterministic sharded WARC writer and reader.

Records are range-sorted by target, page and digest. The bounds of the ranges come from a sample that hashes of the keys choose,
so the same pages give the same files on any cluster. A range's task streams its records in order into gzip members, one a
record, regenerates headers and digests, begins a new shard once ``shard_bytes`` of payload are in, and a new file once the
compressed size passes a limit. A file is written under a temporary name and renamed when whole; a task that runs again writes
the same bytes and renames over them. The list of files and their digests is the manifest, parts that the writing tasks' rows
go to; a small file that names the parts is written last, again under a temporary name, and readers go by it alone. What failed
attempts left under temporary names is deleted then.

Of records with equal payloads the one with the smallest page id is a response, the others revisit it; ids are compared by their
own type, so numbers by value. Page ids and targets come back as they were: what a header can't hold is percent-encoded. A null
html is an empty payload; a null url is written as ``about:blank``; a null page id is left out and sorts last. Rows with equal
page, target and payload are records of their own, streamed by one task. A very long page passes through a task whole, alone in
its batch. Columns but the three named ones aren't stored, so their names don't matter. An empty table gives a manifest without
files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, hash_sample, join_counted, scratch_path, slices, written

#: Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
MANIFEST, PARTS, TEMPORARY = "manifest.json", "manifest", ".temporary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value).strip()


def record_id(page: str | None, url: str, digest: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, json.dumps([page, url, digest, place]))}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; its bytes depend on the arguments alone."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def page_record(page: str | None, url: str | None, payload: bytes, refers: tuple[str | None, str | None] | None, place: int, date: str = DATE) -> bytes:
    """A response, or where ``refers`` names page and target of an equal payload, a revisit of it."""
    target, digest = _clean(url or "") or "about:blank", base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(page, target, digest, place)), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None and (url != target or url == "about:blank"):
        headers.append(("X-Target", quote(url, safe="")))
    if page is not None:
        headers.append(("X-Page-ID", quote(page, safe="")))
    if refers is None:
        return record("response", headers, http + payload)
    first, first_url = refers
    first_target = _clean(first_url or "") or "about:blank"
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, first_target, digest, 0)), ("WARC-Refers-To-Target-URI", first_target), ("WARC-Refers-To-Date", date)]
    if first is not None:
        headers.append(("X-Refers-To-Page-ID", quote(first, safe="")))
    return record("revisit", headers, http)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with small names, block) of each record of a .warc.gz stream; ValueError if a record is damaged."""
    rest = stream.read(1 << 18)
    while rest:
        gz, parts = zlib.decompressobj(31), []
        while not gz.eof:
            rest = rest or stream.read(1 << 18)
            if not rest:
                raise ValueError("the file ends inside a record")
            parts.append(gz.decompress(rest))
            rest = b""
        rest = gz.unused_data or stream.read(1 << 18)
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        block = body[:-4]
        if first != "WARC/1.1" or not body.endswith(b"\r\n\r\n") or len(block) != int(headers["content-length"]):
            raise ValueError("not a whole record")
        if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"the block of {headers.get('warc-record-id')} has another digest")
        yield headers, block


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)
    return fs, path


def _rename(fs: pa.fs.FileSystem, temporary: str, name: str) -> None:
    """Where a rename doesn't replace, what an earlier attempt wrote, the same bytes, is taken away first."""
    try:
        fs.move(temporary, name)
    except OSError:
        fs.delete_file(name)
        fs.move(temporary, name)


class _Files:
    """The files of one shard of a range, one after another."""

    def __init__(self, uri: str, range_: int, shard: int, most: int, token: str, date: str):
        self.fs, self.path = _filesystem(uri)
        self.range, self.shard, self.most, self.token, self.date, self.number, self.out, self.payload = range_, shard, most, token, date, 0, None, 0

    def add(self, data: bytes, payload: int) -> Iterator[dict]:
        self.payload += payload
        if self.out is None:
            self.name = f"shard-{self.range:06d}-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.path}/{TEMPORARY}/{self.name}.{self.token}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self._write(record("warcinfo", [("WARC-Record-ID", record_id(None, self.name, "", 0)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.records += 1
        if self.size >= self.most:
            yield self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict:
        self.out.close()
        _rename(self.fs, f"{self.path}/{TEMPORARY}/{self.name}.{self.token}", f"{self.path}/{self.name}")
        self.out, self.number = None, self.number + 1
        return {"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}


_LISTED = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_LIST = "file string, records long, bytes long, sha256 string"


def _writer(uri: str, shard_bytes: int, file_bytes: int, date: str):
    """Writes rows ordered by range, key and role. Of a key's rows those of role 0 say which page its payload refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        token = f"{task.stageId()}-{task.taskAttemptId()}"
        files, last, place, refers, first = None, None, 0, None, True
        names = ("range", "role", "sort_url", "sort_page", "digest", "page", "url", "payload", "refers", "refers_url", "first")
        for batch in slices(batches, "payload"):
            listed = []
            for range_, role, *key, page, url, payload, refers_to, refers_url, is_first in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if key != last:
                    last, place, refers, first = key, 0, None, True
                if role == 0:
                    refers, first = (refers_to, refers_url), is_first
                    continue
                if files is None or files.range != range_ or files.payload >= shard_bytes:
                    if files is not None and files.out is not None:
                        listed.append(files.close())
                    files = _Files(uri, range_, files.shard + 1 if files is not None and files.range == range_ else 0, file_bytes, token, date)
                # equal rows stand together and get ids of their own; the first of the first key is the response
                revisited = None if refers is None or (first and place == 0) else refers
                listed += files.add(page_record(page, url, payload, revisited, place, date), len(payload))
                place += 1
            if listed:
                yield pa.RecordBatch.from_pylist(listed, _LISTED)
        if files is not None and files.out is not None:
            yield pa.RecordBatch.from_pylist([files.close()], _LISTED)

    return run


def write_warc(
    pages: DataFrame, uri: str | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_revisit: int = 0, shard_bytes: int = 32 << 20, file_bytes: int = 16 << 20, most_ranges: int = 1 << 14, date: str = DATE,
) -> str:
    """Writes the pages and returns the folder. A payload smaller than ``least_revisit`` bytes is never a revisit.

    ``shard_bytes`` of payload go into a shard, ``file_bytes`` compressed into a file. A range is meant to hold one shard; where the
    pages have more shards than ``most_ranges``, the tasks that write at once, a range's task writes several shards one after
    another. The bounds come from a sample of 16 keys a range. Payloads move between executors once. ``date`` is that of all records.
    """
    spark = pages.sparkSession
    uri = uri or scratch_path(spark, "warc")
    uri = uri if ":/" in uri else "file://" + uri
    fs, path = _filesystem(uri)
    if fs.get_file_info(f"{path}/{MANIFEST}").type != pa.fs.FileType.NotFound:
        fs.delete_file(f"{path}/{MANIFEST}")  # what was there is no longer whole
    fs.create_dir(f"{path}/{TEMPORARY}", recursive=True)
    payload = F.coalesce(F.col(f"`{html}`").cast("string").cast("binary"), F.lit(b""))
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    # files are sorted by text: integers are padded so that they follow by value, other ids as they read, none last
    order = F.concat(F.lit("0"), F.col("page_id").cast("string"))
    if isinstance(base.schema["page_id"].dataType, T.IntegralType):
        wide = F.col("page_id").cast("decimal(20,0)")
        order = F.when(F.col("page_id") < 0, F.concat(F.lit("-"), F.lpad((F.lit("9223372036854775808").cast("decimal(20,0)") + wide).cast("string"), 21, "0"))).otherwise(F.concat(F.lit("0"), F.lpad(wide.cast("string"), 21, "0")))
    keys = [F.coalesce("url", F.lit("")).alias("sort_url"), F.coalesce(order, F.lit("~")).alias("sort_page"), F.sha1("payload").alias("digest")]
    slim = written(base.select("page_id", "url", *keys, F.octet_length("payload").alias("size")), "payloads")
    total = slim.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, min(most_ranges, math.ceil(total / shard_bytes)))
    chosen = []
    if ranges > 1:
        names = ["sort_url", "sort_page", "digest"]
        rows = hash_sample(slim.select(*names), names, 16 * ranges)
        chosen = sorted(tuple(r) for r in rows.collect())
    bounds = spark.sparkContext.broadcast([chosen[i * len(chosen) // ranges] for i in range(1, ranges)] if chosen else [])

    @F.pandas_udf("int")
    def range_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([bisect_right(bounds.value, k) for k in zip(*columns, strict=True)], dtype="int32")

    own = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "sort_url", "url", "sort_page")
    first = slim.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min(own).alias("own"), F.count("*").alias("n")).where("n > 1")
    copies = join_counted(slim.select("sort_url", "sort_page", "digest"), written(first, "copies"), ["digest"], "n")
    is_first = (F.col("own.sort_page") == F.col("sort_page")) & (F.col("own.sort_url") == F.col("sort_url"))
    notes = copies.select("sort_url", "sort_page", "digest", F.col("own.page_id").cast("string").alias("refers"), F.col("own.url").alias("refers_url"), is_first.alias("first")).distinct()
    empty = F.lit(None).cast("string")
    notes = notes.select("sort_url", "sort_page", "digest", F.lit(0).alias("role"), empty.alias("page"), empty.alias("url"), F.lit(None).cast("binary").alias("payload"), "refers", "refers_url", "first")
    records = base.select(*keys, F.lit(1).alias("role"), F.col("page_id").cast("string").alias("page"), "url", "payload", empty.alias("refers"), empty.alias("refers_url"), F.lit(None).cast("boolean").alias("first"))
    rows = records.union(notes).withColumn("range", range_of("sort_url", "sort_page", "digest"))
    rows = rows.repartitionById(ranges, "range").sortWithinPartitions("range", "sort_url", "sort_page", "digest", "role", "url")
    rows.mapInArrow(_writer(uri, shard_bytes, file_bytes, date), _LIST).write.mode("overwrite").json(f"{uri}/{PARTS}")
    fs.delete_dir(f"{path}/{TEMPORARY}")
    with fs.open_output_stream(f"{path}/.{MANIFEST}") as out:
        out.write(json.dumps({"format": "WARC/1.1", "files": f"{PARTS}/*.json"}).encode())
    _rename(fs, f"{path}/.{MANIFEST}", f"{path}/{MANIFEST}")
    drop_written(slim)
    return uri


def manifest_of(spark: SparkSession, uri: str) -> DataFrame:
    """A row a file: its name, records, bytes and sha256. FileNotFoundError where no whole set of files was written."""
    fs, path = _filesystem(uri)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        json.loads(f.read())
    return spark.read.schema(_LIST).json(f"{uri}/{PARTS}")


def _reader(uri: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(uri)
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * keep
        names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers"] + ["payload"] * keep
        rows: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                            raise ValueError(f"the payload of {headers['warc-record-id']} has another digest")
                        url = headers["warc-target-uri"]
                        url = unquote(headers["x-target"]) if "x-target" in headers else None if url == "about:blank" else url
                        page, refers = (unquote(headers[h]) if h in headers else None for h in ("x-page-id", "x-refers-to-page-id"))
                        row = (page, url, length, digest, kind, refers)
                        rows.append((*row, payload) if keep else row)
                        size += len(payload) * keep
                        if len(rows) >= 4096 or size > 4 << 20:
                            yield full()
                            rows, size = [], 0
        if rows:
            yield full()

    return run


def read_warc(spark: SparkSession, uri: str, *, page_type: T.DataType | None = None, keep_payload: bool = False, task_bytes: int = 16 << 20) -> DataFrame:
    """A row a record of the files in the manifest: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    The type of the ids is ``page_type``, string where none is given.
    """
    files = manifest_of(spark, uri)
    size = files.agg(F.sum("bytes")).first()[0] or 0
    # a task reads about so many compressed bytes, whole files in turn
    listed = files.select("file").repartition(max(1, math.ceil(size / task_bytes)))
    schema = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string" + ", payload binary" * keep_payload
    kind = page_type or T.StringType()
    rows = listed.mapInArrow(_reader(uri, keep_payload), schema)
    refers = F.when(F.col("record_type") == "revisit", F.expr(f"try_cast(refers AS {kind.simpleString()})"))
    return rows.select(F.col("page").cast(kind).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"), *["payload"] * keep_payload)


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = read_warc(spark, write_warc(pages), page_type=pages.schema["page_id"].dataType)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Payload, digest and the first page of each payload in SQL (base32 from the digest's bits).
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (hex)
"""
