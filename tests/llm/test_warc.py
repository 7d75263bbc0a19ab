import base64
import gzip
import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from inkmeter.llm import warc
from inkmeter.llm.common import scratch_path
from inkmeter.plans.oracle import same_rows

PAGES = "page_id long, url string, html string"


def expected(rows):
    by = defaultdict(list)
    for i, _, html in rows:
        by[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max(by[html or ""])
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out)


def written(spark, rows, extra=False):
    df = spark.createDataFrame(rows, PAGES)
    if extra:
        df = df.select("*", *[F.lit("x").alias(c) for c in ("sha1", "payload", "response", "target_uri", "record_type", "n")])
    folder = scratch_path(spark, "in")
    df.write.parquet(f"{folder}/pages.parquet")
    return folder


def test_round_trip_against_brute_force(spark):
    rows = [(i, f"http://h/{i % 3}", html) for i, html in enumerate(["a", None, "", "a", "ü<p>", "long " * 50_000, "a", "ü<p>", "\r\n\r\nWARC/1.1\r\n"])]
    got = warc.op1_warc(spark, written(spark, rows, True))
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_empty_table(spark):
    assert warc.op1_warc(spark, written(spark, [])).count() == 0


def test_null_ids_and_urls_are_responses(spark):
    got = [tuple(r) for r in warc.op1_warc(spark, written(spark, [(None, None, "x"), (4, None, "x"), (4, None, "x")])).collect()]
    assert sorted(r[3] for r in got) == ["response"] * 3 and sorted(str(r[0]) for r in got) == ["4", "4", "None"]


def test_oracle_on_driver_table(spark, tiny):
    assert same_rows(warc.op1_warc(spark, tiny), warc.ORACLE_SQL["op1_warc"], tiny)


def test_splits_and_pushdown(spark):
    rows = [(i, f"http://h{i % 2}/", "payload %d " % i * 500) for i in range(60)]
    path = scratch_path(spark, "warc")
    warc.write_pages(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    whole = spark.read.format("warc").option("splitbytes", "700").load(path)
    assert whole.count() == 60 and whole.select("record_id").distinct().count() == 60
    picked = warc.read_warc(spark, path).filter("record_type = 'response' AND target_uri LIKE 'http://h1%'")
    assert picked.count() == 30
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("content_length",), 3)]))
    assert len(left) == 1 and [x for p in reader.partitions() for x in reader.read(p)] == []


def test_plain_and_foreign_archives(spark, tmp_path):
    def record(kind, uri, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    records = [record("resource", f"u{i}", b"body %d" % i) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.read_warc(spark, str(tmp_path)).select("target_uri", "payload", "payload_bytes").collect()
    assert sorted((r[0], bytes(r[1]), r[2]) for r in got) == sorted((f"u{i}", b"body %d" % i, 6) for i in range(5) for _ in (0, 1))


def test_payload_is_not_read_when_unwanted(spark):
    path = scratch_path(spark, "warc")
    warc.write_pages(spark.createDataFrame([(1, "u", "x" * 1000)], PAGES), path)
    r = warc.read_warc(spark, path, "none").first()
    assert r.payload is None and r.payload_bytes == 1000


def _record(nth, payload):
    return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{nth}>\r\nContent-Type: text/plain\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def test_splits_take_no_quoted_record_for_a_record(spark, tmp_path):
    inner = _record(99, b"quoted") * 3
    payloads = [b"first " * 20, inner, warc.gzip_member(inner, 0) * 3, b"", inner[:-9], b"WARC/1.0\r\n" * 30, b"last" * 50]
    records = [_record(i, p) for i, p in enumerate(payloads)]
    bare = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in records]
    kinds = {
        "plain.warc": b"".join(records), "stored.warc.gz": b"".join(warc.gzip_member(r, 0) for r in records),
        "packed.warc.gz": b"".join(warc.gzip_member(r, 6) for r in records),
        "unmarked.warc.gz": b"".join(z.compress(r) + z.flush() for z, r in zip(bare, records, strict=True)),
    }
    warc.register(spark)
    for name, data in kinds.items():
        path = tmp_path / name
        path.write_bytes(data)
        for split in (1 << 20, len(data) // 2, 300, 97):
            got = spark.read.format("warc").option("splitbytes", split).load(str(path)).select("record_id", "payload").collect()
            assert sorted((r.record_id, bytes(r.payload)) for r in got) == [(f"<urn:x:{i}>", p) for i, p in enumerate(payloads)], (name, split)


def test_a_record_too_long_for_the_length_field_goes_without_it(monkeypatch):
    data = _record(1, b"x" * 1000)
    assert b"sl" in warc.gzip_member(data)[:16]
    real = len
    monkeypatch.setattr(warc, "len", lambda x: 1 << 32 if x is data else real(x), raising=False)
    assert b"sl" not in warc.gzip_member(data)[:16]
