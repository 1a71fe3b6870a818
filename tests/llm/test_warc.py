import base64
import hashlib
import io
import os
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from rowforge.llm.warc import manifest_of, op7, page_record, read_records, read_warc, write_warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def files(uri):
    folder = uri.removeprefix("file://")
    return {f: open(f"{folder}/{f}", "rb").read() for f in sorted(os.listdir(folder)) if os.path.isfile(f"{folder}/{f}")}


def listed(spark, uri):
    return sorted(tuple(r) for r in manifest_of(spark, uri).collect())


PAGES = [(i, f"http://h{i % 7}.example/{i}", f"<p>{'same' if i % 5 == 0 else i}</p>" * (i % 40 + 1) if i % 5 else "<p>same</p>") for i in range(300)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows, least=0):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else min((x[0] for x in rows if x[0] is not None), default=0))):
        first.setdefault(html or "", page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and first[html or ""] != page
        out.append((page, len(data), digest(data), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 12, 10**6])
def test_round_trip(spark, least):
    uri = write_warc(frame(spark).repartition(5), least_revisit=least, shard_bytes=4096, file_bytes=3000)
    rows = read_warc(spark, uri, page_type=T.LongType(), keep_payload=True).collect()
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
    assert got == expected(PAGES, least)
    by_page = {p: (u, h.encode()) for p, u, h in PAGES}
    assert all(r.url == by_page[r.page_id][0] and (bytes(r.payload) == by_page[r.page_id][1] or r.record_type == "revisit") for r in rows)
    assert manifest_of(spark, uri).count() > 3


@pytest.mark.parametrize("most_ranges", [1 << 14, 3, 1])
def test_files_do_not_depend_on_partitions(spark, most_ranges):
    a = write_warc(frame(spark).repartition(2), shard_bytes=4096, file_bytes=2000, most_ranges=most_ranges)
    b = write_warc(frame(spark, PAGES[::-1]).repartition(9), shard_bytes=4096, file_bytes=2000, most_ranges=most_ranges)
    assert files(a) == files(b) and listed(spark, a) == listed(spark, b) and not os.path.exists(f"{a.removeprefix('file://')}/.temporary")
    # a range's shards follow shard_bytes, however few ranges there may be
    shards = {f.rsplit("-", 1)[0] for f in files(a) if f.startswith("shard")}
    assert len(shards) >= sum(len((h or "").encode()) for _, _, h in PAGES) / 4096 * 0.5


def test_files_match_the_manifest(spark):
    uri = write_warc(frame(spark), shard_bytes=4096, file_bytes=2000)
    found = files(uri)
    for f in manifest_of(spark, uri).collect():
        data = found[f["file"]]
        assert f["bytes"] == len(data) and f["sha256"] == hashlib.sha256(data).hexdigest()
    keys = [(h["warc-target-uri"], int(h["x-page-id"])) for f in sorted(x for x in found if x.endswith(".gz")) for h, _ in read_records(open(f"{uri.removeprefix('file://')}/{f}", "rb")) if h["warc-type"] != "warcinfo"]
    assert keys == sorted(keys) and len(keys) == len(PAGES)
    # what a broken writer left behind is not read
    open(f"{uri.removeprefix('file://')}/shard-999999-000000-00000.warc.gz", "wb").write(b"junk")
    assert read_warc(spark, uri).count() == len(PAGES)
    assert read_warc(spark, uri, task_bytes=2000).count() == len(PAGES)
    os.remove(f"{uri.removeprefix('file://')}/manifest.json")
    with pytest.raises(FileNotFoundError):
        read_warc(spark, uri)


def test_revisits_can_be_resolved(spark):
    """Every revisit names the record, target and date of a response with the same payload."""
    uri = write_warc(frame(spark), shard_bytes=4096, date="2024-02-29T00:00:00Z")
    heads = [h for f, data in files(uri).items() if f.endswith(".gz") for h, _ in read_records(io.BytesIO(data))]
    responses = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisits
    for h in revisits:
        first = responses[h["warc-refers-to"]]
        assert (h["warc-refers-to-target-uri"], h["warc-refers-to-date"], h["warc-payload-digest"]) == (first["warc-target-uri"], first["warc-date"], first["warc-payload-digest"])


IDS = {
    "long": [-5, -3, 0, 7, 10, 9, -(2**63), 2**63 - 1, None],
    "double": [10.0, 9.0, -2.5, 100.0, 1e300, -1e300, 0.0, None],
    "decimal(10,2)": [Decimal("10.00"), Decimal("9.00"), Decimal("-3.50"), Decimal("-30.50"), None],
    "string": [" a", "a", "b\x01", "", "é😀", "%41", "A", "a\r\nWARC-Type: x", "x: y", "\t", "~", "\x7f", None],
}


@pytest.mark.parametrize("kind", IDS)
def test_any_ids_come_back(spark, kind):
    """Every id against brute force, each with the payload of all others and with one of its own; urls of any content too."""
    urls = [None, "", " u ", "about:blank", "http://a\r\nb", "%zz", "http://é", "x" * 3000]
    rows = [(i, urls[k % len(urls)], html) for k, i in enumerate(IDS[kind]) for html in ("same", f"own {k}")]
    df = spark.createDataFrame(rows, f"page_id {kind}, url string, html string").repartition(3)
    back = read_warc(spark, write_warc(df, shard_bytes=50), page_type=df.schema["page_id"].dataType).collect()
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in back)
    assert got == expected(rows)
    assert sorted(str((r.page_id, r.url)) for r in back) == sorted(str((p, u)) for p, u, _ in rows)


def test_damage(tmp_path):
    data = page_record("1", "http://x", b"hello" * 100, None, 0)
    assert page_record("1", "http://x", b"hello" * 100, None, 0) == data
    for broken in (data[:-3], data[:40] + bytes([data[40] ^ 1]) + data[41:], b"junk" + data):
        (tmp_path / "x").write_bytes(broken)
        with pytest.raises(Exception):  # noqa: B017
            list(read_records(open(tmp_path / "x", "rb")))


def test_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a\r\nb", "<p>x</p>"), (2, "", ""), (3, "http://é", "<p>x</p>"), (None, None, "y" * 200_000), (-5, "u", "neg"), (4, "u", "neg")]
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read_warc(spark, write_warc(frame(spark, rows)), page_type=T.LongType()).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 0, "response", None), (1, 0, "revisit", 1), (None, 8, "revisit", 3), (2, 0, "revisit", 1), (3, 8, "response", None), (None, 200_000, "response", None), (-5, 3, "response", None), (4, 3, "revisit", -5)]))
    uri = write_warc(frame(spark, []))
    assert manifest_of(spark, uri).count() == 0 and read_warc(spark, uri).count() == 0
    extra = frame(spark).selectExpr("*", "1 shard", "'x' digest", "'y' refers", "2 role", "3 __uid")
    assert read_warc(spark, write_warc(extra)).count() == len(PAGES)


def test_query(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in op7(spark, sf_dir).collect())
    assert got == expected(pages)
