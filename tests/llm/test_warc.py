import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from rarespark.llm import warc

PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "http://c/\r\nX: y", "a\r\n\r\nWARC/1.1"),
         (6, "http://d/", "x" * 300_000), (7, "http://d/", "x" * 300_000), (8, "e", "same"), (8, "e", "same"), (9, "", "ends with\r\n"), (10, "http://e/\u2028WARC-Refers-To: <urn:page:9>", "\r\n\r"), (11, "http://f/\u0085WARC-Payload-Digest: sha1:ABC", "\r\n\r\n\r\n"),
         (12, "http://g/\nWARC-Type: revisit\rx", "\r\n" * 9 + "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde"), (13, "http://h/", "e\u2028" * 7), (14, "%0D%0A", "e\u2028" * 7), (None, "n", "same"), (None, "n", "alone")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("header", F.lit("clash"))


def read_back(spark, path, *more):
    files = f"{path}-files{len(more)}"
    warc.write_warc(spark, path, files, *more)
    return warc.read_warc(spark, files)


def test_types_digests_and_reconstruction(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.archive(pages.repartition(3), path)
    found = warc.described(read_back(spark, path)).cache()
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()}
    same = {}
    for page, _, html in PAGES:
        same.setdefault(html or "", []).append(page)
    want = set()
    for page, _, html in PAGES:
        last = max((p for p in same[html or ""] if p is not None), default=None)
        raw = (html or "").encode()
        want.add((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if page == last else ("revisit", last))))
    assert got == want and found.count() == len(PAGES)
    assert sorted(((r.page_id, r.url) for r in found.collect()), key=repr) == sorted(((p, u) for p, u, _ in PAGES), key=repr)
    whole = {(r.page_id, bytes(r.payload).decode()) for r in warc.records(spark, path).collect()}
    assert whole == {(p, h or "") for p, _, h in PAGES}
    full = read_back(spark, path, True).collect()
    assert sorted(((r.page_id, bytes(r.block).decode()) for r in full), key=repr) == sorted(((p, h or "") for p, _, h in PAGES), key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == len(same)


def test_warc_files_can_be_read(spark, pages, tmp_path):
    warc.archive(pages, str(tmp_path / "archive"))
    warc.write_warc(spark, str(tmp_path / "archive"), str(tmp_path / "warc"))
    found = []
    for name in os.listdir(tmp_path / "warc"):
        if name.startswith("part"):
            data = gzip.open(tmp_path / "warc" / name).read()
            while data:
                head, _, data = data.partition(b"\r\n\r\n")
                lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                n = int(lines["Content-Length"])
                assert data[n:n + 4] == b"\r\n\r\n" and head.startswith(b"WARC/1.1")
                found.append((lines["WARC-Type"], data[:n]))
                data = data[n + 4:]
    assert len(found) == len(PAGES)
    assert {x for k, x in found if k == "response"} == {(h or "").encode() for _, _, h in PAGES}


def test_changed_bytes_are_noticed(spark, pages, tmp_path):
    warc.archive(pages, str(tmp_path / "a"))
    warc.write_warc(spark, str(tmp_path / "a"), str(tmp_path / "files"))
    stored = spark.read.parquet(f"{tmp_path}/a/payloads")
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.records(spark, f"{tmp_path}/b").collect()
    with pytest.raises(Exception, match="does not match its payload"):
        read = warc.read_warc(spark, str(tmp_path / "files"))
        warc.described(read.withColumn("block", F.concat("block", F.lit(b"!")))).collect()


def test_empty(spark, pages, tmp_path):
    warc.archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.described(read_back(spark, str(tmp_path / "none"))).count() == 0
