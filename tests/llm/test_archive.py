"""Legacy archives: both header versions, conversion, and the records read back."""

import base64
import hashlib

import pytest
from compare import compare, connect
from dualcast.llm import archive, queries
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def wanted(rows):
    last = {}
    for page, _, html in rows:
        if page is not None:
            key = html or ""
            last[key] = max(page, last.get(key, page))
    out = []
    for page, _, html in rows:
        data, top = (html or "").encode(), last.get(html or "")
        again = top is not None and top != page
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def converted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("digest", "content", "page", "original", "date")})
    found = archive.read_warc(archive.convert(df.repartition(3), "page_id", "url", "html")).collect()
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr)


def test_query_against_plain_python(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    found = queries.op9_warc(spark, sf_dir).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr) == wanted(rows)


def test_matches_sql(spark, sf_dir):
    problem = compare(spark, connect(sf_dir), "op9_warc", queries.QUERIES["op9_warc"], queries.SQL["op9_warc"], sf_dir)
    assert problem is None, problem


def test_equal_payloads_odd_urls_and_ids(spark):
    rows = [
        (1, "http://a b\n/c", "same"), (7, "u", "same"), (7, "u", "same"), (3, None, "same"), (4, "", None), (5, "x", ""), (-2, "é", "é\r\n\r\n"),
        (2**62 + 5, "u", "big"), (9, "u", "big"), (None, "u", "same"), (None, "u", "no id"), (11, "u", "z" * 2_000_000),
    ]
    assert converted(spark, rows) == wanted(rows)
    assert converted(spark, []) == []


def test_ids_reverse():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        name = archive.record_id(page, archive.base32_sha1(b"x"))
        assert archive.page_of(name) == page and name[24] == "8"


def test_version_lines_and_lengths():
    for version in (1, 2):
        block = f"{version} 0 x\n{' '.join(archive.ARC_FIELDS[version])}\n\n".encode()
        data = archive._arc_line(version, "filedesc://n", "20000101000000", "text/plain", block, "n", 0) + block
        body = b"HTTP/1.1 200 OK\r\n\r\nhttp://trap 0 0 0 9\n"
        data += b"\n" + archive._arc_line(version, "http://a", "20010203040506", "text/html", body, "n", len(data) + 1) + body
        ((fields, content),) = archive.parse_arc(data)
        assert content == body and fields["Archive-date"] == "20010203040506" and len(fields) == len(archive.ARC_FIELDS[version])
        with pytest.raises(ValueError):
            list(archive.parse_arc(data[:-1]))
        with pytest.raises(ValueError):
            list(archive.parse_arc(data + b"rest"))


def test_every_record_has_an_identifier_and_a_time_of_its_own(spark):
    rows = [(7, "u", "same", "20010203040506"), (7, "u", "same", "200102030405"), (3, "u", "same", "soon"), (None, "u", "same", None),
            (0, "u", "same", "20011303040506"), (None, "v", "none", "20040229235959"), (None, "v", "none", "20040229235959")]
    df = spark.createDataFrame(rows, SCHEMA + ", taken string").coalesce(1)
    files = archive.convert(df, "page_id", "url", "html", F.col("taken")).collect()
    records = [r for f in files for r, _ in archive.parse_warc(bytes(f["archive"]))]
    ids = [r["WARC-Record-ID"] for r in records]
    assert len(set(ids)) == len(ids) == 7 + len(files) and all(r["WARC-Date"] for r in records)
    responses = {r["WARC-Record-ID"]: r for r in records if r["WARC-Type"] == "response"}
    revisits = [r for r in records if r["WARC-Type"] == "revisit"]
    assert len(revisits) == 3 and all(r["WARC-Refers-To"] in responses for r in revisits)
    assert {archive.page_of(r["WARC-Refers-To"]) for r in revisits} == {7}
    times = sorted(r["WARC-Date"] for r in records if r["WARC-Type"] != "warcinfo")
    first = "2001-02-03T04:05:06Z"  # the file's date, for the three that cannot be read
    assert times == ["2001-02-03T04:05:00Z", first, first, first, first, "2004-02-29T23:59:59Z", "2004-02-29T23:59:59Z"]


def test_times():
    assert archive.warc_time("19991231235958") == "1999-12-31T23:59:58Z" and archive.warc_time("199912312359") == "1999-12-31T23:59:00Z"
    assert archive.warc_time("19990230000000", "20000101000000") == "2000-01-01T00:00:00Z"
    assert archive.warc_time("-", "") == archive.warc_time("1999") == "1970-01-01T00:00:00Z"


def test_a_foreign_file(spark):
    block = f"1 0 someone\n{' '.join(archive.ARC_FIELDS[1])}\n<arcmetadata>\nmade by hand\n</arcmetadata>\n"
    data = f"filedesc://x.arc 0.0.0.0 20020304050607 text/plain {len(block)}\n{block}"
    bodies = ["HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\none", "HTTP/1.0 404 Not Found\r\nContent-Length: 4\r\n\r\ntwo\n"]
    data += f"\nhttp://a/ 1.2.3.4 20020304050608 text/html {len(bodies[0])}\n{bodies[0]}\n\n\n"
    data += f"http://b/ 1.2.3.4 0 text/html {len(bodies[1])}\n{bodies[1]}"
    for end in ("", "\n", "\n\n"):
        files = spark.createDataFrame([("x.arc", bytearray((data + end).encode()))], "name string, archive binary")
        found = {r["url"]: r for r in archive.read_arc(files).collect()}
        assert [found[u]["date"] for u in ("http://a/", "http://b/")] == ["2002-03-04T05:06:08Z", "2002-03-04T05:06:07Z"]
        assert found["http://b/"]["digest"] == archive.base32_sha1(b"two\n") and found["http://a/"]["page"] is None
