"""WARC archives as a PySpark data source, with revisit records for repeated payloads.

Every record is its own gzip member, and the member header carries its length (the ``sl`` extra field),
so a reader inflates only the first bytes of a record to see its WARC headers and seeks over records
that a pushed-down predicate rejects or whose payload nobody asked for. Archives without that field, and
uncompressed ones, are read as well; their unwanted payloads are passed over without being decoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import broadcast_if_small, load, scratch_path, stage

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, content_type string,"
    " content_length long, payload_digest string, payload_bytes long, payload binary"
)
_HEADER_OF = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "content_type": "content-type",
}
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER_BYTES = 4096
_CHUNK = 1 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """A filesystem and a path on it for a local path or any URI that Arrow knows."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """One gzip member whose extra field ``sl`` holds (length of the member, length of the data).

    The field has 32 bits: a record of 4 GiB or more goes without it, and readers inflate it to find its end.
    """
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) < 1 << 32:
        head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data))
    else:
        head = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """A response record with its payload, or a revisit record with the HTTP headers alone."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_bytes"] if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["target_uri"]), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + (row["payload_digest"] if revisit else digest_of(payload))),
        ("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", _REVISIT_PROFILE if revisit else None),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one file aside; the commit moves the files of the successful attempts into place."""

    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = open_fs(self.path)
        fs.create_dir(f"{root}/_aside", recursive=True)
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/_aside/{name}", compression=None) as out:
            for batch in iterator:
                names = batch.schema.names
                for values in zip(*batch.columns, strict=True):
                    out.write(gzip_member(record_bytes({k: v.as_py() for k, v in zip(names, values, strict=True)}), self.level))
                    n += 1
        return _Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            if m is not None and m.records:
                fs.move(f"{root}/_aside/{m.name}", f"{root}/{m.name}")
        if fs.get_file_info(f"{root}/_aside").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_aside")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(f"{root}/_aside/{m.name}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/_aside/{m.name}")


# ---------------------------------------------------------------- reading


@dataclass
class _Split(InputPartition):
    path: str
    start: int
    end: int


def _parse(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if colon:
            found[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return found


class _Inflater:
    """Bytes of the record that starts at ``at``: gzip member or plain; can stop after any of them."""

    def __init__(self, file, at: int):
        self.file, self.at, self.skip_to = file, at, None
        file.seek(at)
        start = file.read(24)
        self.gz = start[:3] == b"\x1f\x8b\x08"
        body = at
        if self.gz:
            flags, body = start[3], at + 10
            if flags & 4:
                (extra,) = struct.unpack("<H", start[10:12])
                if start[12:14] == b"sl" and extra >= 12:
                    self.skip_to = at + struct.unpack("<I", start[16:20])[0]
                body += 2 + extra
            file.seek(body)
            for flag in (8, 16):  # name, comment
                if flags & flag:
                    while (c := file.read(1)) not in (b"\0", b""):
                        body += 1
                    body += 1
            body += 2 * bool(flags & 2)
            self.z = zlib.decompressobj(-15)
        self.next = body
        self.tail = b""

    def read(self, most: int) -> bytes:
        """Up to ``most`` further bytes; empty at the end of the member."""
        if not self.gz:
            self.file.seek(self.next)
            data = self.file.read(most)
            self.next += len(data)
            return data
        while not self.z.eof:
            if not self.tail:
                self.file.seek(self.next)
                self.tail = self.file.read(_HEADER_BYTES if most <= _HEADER_BYTES else _CHUNK)
                self.next += len(self.tail)
                if not self.tail:
                    return b""
            out = self.z.decompress(self.tail, most)
            self.tail = self.z.unconsumed_tail
            if out:
                return out
        return b""

    def end(self) -> int:
        """Where the next record starts; inflates the rest only if the member's length is unknown."""
        if self.skip_to is not None:
            return self.skip_to
        while self.read(_CHUNK):
            pass
        return self.next - len(self.z.unused_data) + 8


def _next(file, at: int) -> int:
    """Where the record after the one at ``at`` starts, by stated lengths; a payload is inflated only if its member states none."""
    record = _Inflater(file, at)
    if record.gz:
        return record.end()
    data = b""
    while (stop := data.find(b"\r\n\r\n")) < 0 and (more := record.read(_HEADER_BYTES)):
        data += more
    if stop < 0:
        return file.size()
    return at + stop + 4 + int(_parse(data[:stop]).get("content-length", 0)) + 4


def _first(file, start: int) -> int:
    """First record start at or after ``start``.

    Found by walking from record to record: a payload may hold anything, whole archives among them, so what looks
    like a record in the middle of a file need not be one.
    """
    at, size = 0, file.size()
    while at < min(start, size):
        at = _next(file, at)
    return at


def _can_split(fs: pafs.FileSystem, path: str) -> bool:
    """Whether records can be walked without inflating them: plain ones and members that state their length."""
    with fs.open_input_file(path) as file:
        record = _Inflater(file, 0)
        return not record.gz or record.skip_to is not None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.mode = options.get("payload", "binary")
        self.split = int(options.get("splitbytes", 512 << 20))
        if self.mode not in ("binary", "digest", "none"):
            raise ValueError("option payload must be binary, digest or none")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership, prefix and not-null tests on header columns; returns the others."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _HEADER_OF and isinstance(f, EqualTo):
                self.tests.append((_HEADER_OF[name], "in", (f.value,)))
            elif name in _HEADER_OF and isinstance(f, In):
                self.tests.append((_HEADER_OF[name], "in", tuple(f.value)))
            elif name in _HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((_HEADER_OF[name], "prefix", f.value))
            elif name in _HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((_HEADER_OF[name], "present", None))
            else:
                yield f

    def partitions(self) -> list[_Split]:
        fs, root = open_fs(self.path)
        files = [fs.get_file_info(root)]
        if files[0].type == pafs.FileType.Directory:
            files = [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        # a conventional archive of a gigabyte or less is one partition or two; only larger ones are looked into
        step = lambda x: self.split if x.size <= self.split or _can_split(fs, x.path) else x.size
        return [
            _Split(x.path, a, min(a + step(x), x.size))
            for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, step(x))
        ] or [_Split("", 0, 0)]

    def _wanted(self, head: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            own = head.get(name)
            if own is None or (how == "in" and own not in value) or (how == "prefix" and not own.startswith(value)):
                return False
        return True

    def read(self, partition: _Split) -> Iterator[tuple]:
        if partition.end <= partition.start:
            return
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.path) as file:
            size = file.size()
            at = _first(file, partition.start)
            while at < min(partition.end, size):
                record = _Inflater(file, at)
                data = b""
                while (stop := data.find(b"\r\n\r\n")) < 0 and (more := record.read(_HEADER_BYTES)):
                    data += more
                if stop < 0:
                    break
                head = _parse(data[:stop])
                length = int(head.get("content-length", 0))
                plain_end = at + stop + 4 + length + 4
                if not self._wanted(head):
                    at = record.end() if record.gz else plain_end
                    continue
                yield self._row(head, length, record, data[stop + 4 :])
                at = record.end() if record.gz else plain_end

    def _row(self, head: dict[str, str], length: int, record: _Inflater, block: bytes) -> tuple:
        http = head.get("content-type", "").startswith("application/http")
        revisit = head.get("warc-type") == "revisit"
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        need = self.mode != "none" and not revisit
        inner: dict[str, str] = {}
        if http or need:
            while len(block) < length and (need or b"\r\n\r\n" not in block) and (more := record.read(_CHUNK if need else _HEADER_BYTES)):
                block += more
            block = block[:length]
        cut = 0
        if http and (cut := block.find(b"\r\n\r\n") + 4) >= 4:
            inner = _parse(block[:cut])
        else:
            cut = 0
        payload = None
        n = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else (length - cut if not revisit else None)
        if need:
            payload = block[cut:]
            own = digest_of(payload)
            if digest is not None and len(digest) == 32 and own != digest:
                raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
            digest, n = own, len(payload)
        return (*(head.get(_HEADER_OF[c]) for c in ("record_id", "record_type", "target_uri", "date", "refers_to", "content_type")),
                length, digest, n, payload if self.mode == "binary" else None)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "binary|digest|none").load(folder)`` and the matching writer."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 4)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row; of equal payloads the row with the largest id is the response.

    Null html is an empty payload, a null url leaves the header out, and a row without id is always a
    response of its own. Rows repeating the same id and payload are all responses if that id is the
    largest. An empty table writes no file. Extra columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    keyed = rows.select("page_id", "target_uri", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes"))
    largest = keyed.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = stage(keyed.join(largest, "sha1").filter("page_id < response"), "warc-revisits")
    again = broadcast_if_small(stage(revisits.select("page_id", "sha1").distinct(), "warc-revisit-ids"))
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    none = lambda kind: F.lit(None).cast(kind)
    common = [uri("page_id").alias("record_id"), "target_uri", F.lit("1970-01-01T00:00:00Z").alias("date")]
    responses = rows.join(again, ["page_id", "sha1"], "left_anti").select(
        *common, F.lit("response").alias("record_type"), none("string").alias("refers_to"), none("string").alias("payload_digest"),
        none("long").alias("payload_bytes"), "payload")
    base32 = F.concat(*[
        F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(F.conv(F.substring("sha1", 10 * k + 1, 10), 16, 10).cast("long"), 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        for k in range(4) for j in range(8)])
    repeats = revisits.select(
        *common, F.lit("revisit").alias("record_type"), uri("response").alias("refers_to"), base32.alias("payload_digest"),
        "payload_bytes", none("binary").alias("payload"))
    responses.unionByName(repeats).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "binary") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_pages(load(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    id_of = lambda c: F.when(page(c) != "", page(c).cast("long"))
    out = [id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to")]
    responses = read_warc(spark, path, "digest").filter("record_type = 'response'").select(*out)
    revisits = read_warc(spark, path, "none").filter("record_type = 'revisit'").select(*out)
    return responses.unionByName(revisits)


QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {
    "op1_warc": """
WITH keyed AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
judged AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM keyed)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM judged""",
}
