"""Content-addressed web archive: exact round trips and every special row."""

import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tastelake.llm import warc
from tastelake.session import work_path
from tests.llm.conftest import listed

BIG, OTHER = "<p>é" + "x" * 1200, "<p>" + "y" * 999
PAGES = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (None, "http://a/n", BIG), (5, "http://a/5", BIG),
    (2, "http://a/2", "short"), (4, "http://a/4", "short"), (6, "http://a/6\r\nWARC-Type: revisit", None), (7, "", ""),
    (8, "http://a/8", OTHER), (9, "http://a/9", "line\r\n\r\nContent-Length: 7\r\n\r\nWARC/1.1"), (None, None, None),
    (10, "http://a/10", "z" * 3_000_000),
]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    pages = pages.withColumns({c: F.lit(7) for c in ("key", "n", "sha1", "payload", "revisit", "refers_to", "header", "m")})
    path = work_path(spark, "archive")
    warc.write(pages, path)
    return path


def test_listing(spark, archive):
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        first = 5 if html == BIG else page
        kind = "revisit" if page != first else "response"
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), kind, first if kind == "revisit" else None))
    got = warc.listing(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert listed(got) == sorted(want, key=repr)


def test_payloads_are_stored_once(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == len({html or "" for _, _, html in PAGES})


def test_damage_is_noticed(spark, archive):
    path = work_path(spark, "damaged")
    spark.read.parquet(f"{archive}/records").write.parquet(f"{path}/records")
    broken = F.when(F.octet_length("payload") == 5, F.lit(b"shirt")).otherwise(F.col("payload"))
    spark.read.parquet(f"{archive}/payloads").withColumn("payload", broken).write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload and header differ"):
        warc.listing(spark, path).collect()


def test_exported_files_are_standard(spark, archive):
    """Read with Content-Length alone, as any WARC reader does."""
    target = work_path(spark, "export")
    warc.export(spark, archive, target)
    found = []
    for file in Path(target).glob("part-*"):
        data = file.read_bytes()
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at) + 4
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:] if x)
            stop = end + int(fields["Content-Length"])
            block = data[end:stop]
            head, _, body = block.partition(b"\r\n\r\n")
            assert data[stop : stop + 4] == b"\r\n\r\n" and head.startswith(b"HTTP/1.1 200 OK")
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
            else:
                assert body == b"" and fields["WARC-Refers-To"] == "<urn:page:5>"
            page = re.fullmatch("<urn:page:(.*)>", fields["WARC-Record-ID"])[1]
            found.append((int(page) if page else None, fields.get("WARC-Target-URI")))
            at = stop + 4
    want = [(p, u and u.replace("\r", "%0D").replace("\n", "%0A")) for p, u, _ in PAGES]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_empty(spark):
    path = work_path(spark, "archive")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.listing(spark, path).count() == 0


def test_pages_without_ids(spark):
    path = work_path(spark, "archive")
    warc.write(spark.createDataFrame([(None, "u", BIG)] * 2, "page_id bigint, url string, html string"), path)
    assert [r.record_type for r in warc.listing(spark, path).collect()] == ["response"] * 2
