"""Legacy web archives: ARC files of both versions, their conversion to WARC records, and a WARC reader.

An archive is a row (``name``, ``archive``) whose bytes are a whole file of at most ``ARCHIVE_BYTES`` or one
record. The converter reads the fields that an ARC file declares in its version block, takes each record
by its declared length, and gives it a WARC identifier, time, type and digests. Of records with equal
payloads one is the response and the others revisit it, keeping only their HTTP head.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, materialize, scratch

ARCHIVE_BYTES = 512 * 1024
#: Fixed values of the formats: the fields of a record line by version, and the profile of a revisit.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = b"X-Page-Id"
_ARCHIVE = pa.schema([("name", pa.string()), ("archive", pa.binary())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, place: str) -> str:
    """A custom (version 8) UUID of the 64 bits of the page's id and 58 hashed bits of ``place``: the record's file,
    position and digest, so that repeated rows and rows without an id have identifiers of their own."""
    top = int.from_bytes(hashlib.sha1(place.encode()).digest()[:8], "big") >> 6
    bits = (top << 64) | ((page_id or 0) & (2**64 - 1))
    value = ((bits >> 74) << 80) | (8 << 76) | (((bits >> 62) & 0xFFF) << 64) | (2 << 62) | (bits & (2**62 - 1))
    digits = f"{value:032x}"
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>"


def page_of(identifier: str) -> int:
    value = int(re.sub("[^0-9a-f]", "", identifier.removeprefix("<urn:uuid:")), 16)
    low = (((value >> 64) & 0xFFF) << 62 | (value & (2**62 - 1))) & (2**64 - 1)
    return low - 2**64 if low >= 2**63 else low


def warc_time(*dates: str) -> str:
    """The first readable date (14 digits, or 12 without seconds) as a WARC time; 1970 where none is."""
    for date in dates:
        if re.fullmatch(r"[0-9]{12}(?:[0-9]{2})?", date):
            try:
                return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
            except ValueError:
                continue
    return "1970-01-01T00:00:00Z"


def _line_safe(url: str | None) -> str:
    """A URL without white space or control characters; a missing one is ``about:blank``."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def _packed(task: str, kind: str, records: Iterator[bytes], head) -> Iterator[pa.RecordBatch]:
    """Files of records, each begun with the bytes of ``head(name, number, first record maker)``."""
    number, size, parts, name = 0, 0, [], ""
    for make in records:
        if parts and size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], schema=_ARCHIVE)
            parts = []
        if not parts:
            number += 1
            name = f"{task}-{number:06d}.{kind}"
            parts = [head(name, number, make)]
            size = len(parts[0])
        record = make(name, number, size)
        parts.append(record)
        size += len(record)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], schema=_ARCHIVE)


def _version(number: int) -> int:
    return 1 + number % 2


def write_arc(pages: DataFrame, page_id: str, url: str, html: str, date: str | Column) -> DataFrame:
    """Pages as ARC files, alternately of version 1 and 2. ``date`` is the 14-digit time of capture: one, or a column's.

    A file has its first record's date. A null date, or one that is no single word, is written as ``-``.

    Null html is an empty payload; a null id has no id header; every row becomes one record.
    """

    def head(name: str, number: int, make) -> bytes:
        version = _version(number)
        first = make(name, number, 0).split(b"\n", 2)[1].decode()
        when = first.rsplit(" ", len(ARC_FIELDS[version]) - 1)[ARC_FIELDS[version].index("Archive-date")]
        block = f"{version} 0 dualcast\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
        return _arc_line(version, f"filedesc://{name}", when, "text/plain", block, name, 0) + block

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for page, address, text, when in zip(*(cells(batch, c) for c in ("page", "url", "html", "date"))):
                    body = (text or "").encode("utf-8")
                    own = b"" if page is None else PAGE_HEADER + f": {page}\r\n".encode()
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own
                    content = http + f"Content-Length: {len(body)}\r\n\r\n".encode() + body
                    time = when if when and not re.search(r"\s", when) else "-"
                    yield lambda name, number, size, a=address, c=content, t=time: (
                        b"\n" + _arc_line(_version(number), _line_safe(a), t, "text/html", c, name, size + 1) + c
                    )

        yield from _packed(f"part-{TaskContext.get().partitionId():06d}", "arc", records(), head)

    when = F.lit(date) if isinstance(date, str) else date.cast("string")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), when.alias("date"))
    return arrow_pass(rows, passes, "name string, archive binary")


def _arc_line(version: int, url: str, date: str, kind: str, content: bytes, name: str, offset: int) -> bytes:
    value = {
        "URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200",
        "Checksum": hashlib.md5(content).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name,
        "Archive-length": str(len(content)),
    }
    return (" ".join(value[f] for f in ARC_FIELDS[version]) + "\n").encode()


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields and the content of every record after the version block, which names the fields.

    Further lines of the block are comments. One or more line ends stand before a record; some may end the file.
    """
    end = data.index(b"\n")
    if not data.startswith(b"filedesc://"):
        raise ValueError("an ARC file begins with its filedesc line")
    length = int(data[:end].rsplit(b" ", 1)[1])
    block = data[end + 1 : end + 1 + length].decode().split("\n")
    version, names = int(block[0].split(" ")[0]), block[1].split(" ")
    if ARC_FIELDS.get(version) != names:
        raise ValueError(f"unknown ARC version {version} with fields {names}")
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] not in (b"\n", b"\r"):
            raise ValueError(f"a declared length is wrong before byte {at}")
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at == len(data):
            return
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"not a version {version} record line: {line[:80]}")
        fields = dict(zip(names, values))
        length = int(fields["Archive-length"])
        if end + 1 + length > len(data):
            raise ValueError("a record is shorter than its declared length")
        yield fields, data[end + 1 : end + 1 + length]
        at = end + 1 + length


def _http(content: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    head, _, body = content.partition(b"\r\n\r\n")
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return head, body, {k.strip().lower(): v.strip() for k, _, v in lines}


def read_arc(archives: DataFrame) -> DataFrame:
    """One row per ARC record: page, url, date, content (HTTP head and payload), the payload's digest, and its place.

    A date that cannot be read is that of the file, or else 1970.
    """

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(cells(batch, "name"), cells(batch, "archive")):
                rows = []
                begun = data[: data.index(b"\n")].decode("utf-8", "replace").split(" ")[2]
                for number, (fields, content) in enumerate(parse_arc(data)):
                    digest = base32_sha1(_http(content)[1])
                    headers = _http(content)[2]
                    page = headers.get(PAGE_HEADER.lower())
                    rows.append((
                        None if page is None else int(page), fields["URL"], warc_time(fields["Archive-date"], begun), content, digest,
                        f"{name} {number} {digest}",
                    ))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["page", "url", "date", "content", "digest", "place"])

    schema = "page long, url string, date string, content binary, digest string, place string"
    return arrow_pass(archives.select("name", "archive"), passes, schema)


def with_originals(records: DataFrame) -> DataFrame:
    """Adds ``original`` and ``original_place``: the largest page of the records with equal payloads, where there are
    several, and the last place of a record of it.

    Only digests that occur again are stored and joined; both sides of the join are plain exchanges, so
    Spark splits a digest that very many records share.
    """
    groups = records.groupBy("digest").agg(F.max(F.struct("page", "place")).alias("last"), F.count(F.lit(1)).alias("copies"))
    last = F.col("last.page").alias("original"), F.col("last.place").alias("original_place")
    groups = materialize(groups.where("copies > 1").select("digest", *last))
    return records.join(groups, "digest", "left")


def write_warc(records: DataFrame) -> DataFrame:
    """WARC files of the records: a response, or a revisit where ``original`` is another page.

    Records of the original page itself, repeated rows included, are responses; so are all records of a
    group in which no page has an id.
    """

    def record(page: int | None, url: str, time: str, content: bytes, digest: str, place: str, original: int | None, other: str | None) -> bytes:
        again = original is not None and original != page
        block = content[: content.index(b"\r\n\r\n") + 4] if again else content
        lines = [
            "WARC/1.0", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id(page, place)}",
            f"WARC-Date: {time}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        ]
        if again:
            lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(original, other)}"]
        return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    columns = ["page", "url", "date", "content", "digest", "place", "original", "original_place"]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records_of():
            for batch in batches:
                for row in zip(*(cells(batch, c) for c in columns)):
                    yield lambda name, number, size, row=row: record(*row)

        info = b"software: dualcast\r\nformat: WARC File Format 1.0\r\n"

        def head(name: str, number: int, make) -> bytes:
            first = make(name, number, 0)
            time = re.search(rb"\r\nWARC-Date: ([^\r]*)", first)[1].decode()
            own = record_id(None, f"{name} {base32_sha1(first)}")
            return (
                f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {own}\r\nWARC-Date: {time}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\n"
                f"Content-Length: {len(info)}\r\n\r\n"
            ).encode() + info + b"\r\n\r\n"

        yield from _packed(f"part-{TaskContext.get().partitionId():06d}", "warc", records_of(), head)

    rows = records.select(*columns)
    return arrow_pass(rows, passes, "name string, archive binary")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin, length = end + 4, int(headers["Content-Length"])
        if data[begin + length : begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"a declared length is wrong before byte {begin + length}")
        yield headers, data[begin : begin + length]
        at = begin + length + 4


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per response or revisit; a response's digests and length are checked against its bytes."""

    def row(headers: dict[str, str], block: bytes) -> tuple:
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        _, body, http = _http(block)
        page, size = http.get(PAGE_HEADER.lower()), int(http[b"content-length"])
        if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
        if headers["WARC-Type"] == "response" and (len(body) != size or base32_sha1(body) != digest):
            raise ValueError(f"payload of {headers['WARC-Record-ID']}")
        refers = headers.get("WARC-Refers-To")
        return (
            None if page is None else int(page), size, digest, headers["WARC-Type"],
            None if refers is None else page_of(refers), headers["WARC-Record-ID"], headers["WARC-Date"], headers["WARC-Target-URI"],
        )

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "record_date", "target_uri"]
        for batch in batches:
            for data in cells(batch, "archive"):
                rows = [row(*r) for r in parse_warc(data) if r[0]["WARC-Type"] != "warcinfo"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, record_date string, target_uri string"
    )
    return arrow_pass(archives.select("archive"), passes, schema)


def convert(pages: DataFrame, page_id: str, url: str, html: str, date: str | Column = "20000101000000") -> DataFrame:
    """Pages to ARC files, those to WARC files, both stored in the shared folder; the WARC files as a table.

    An empty table gives no files. Columns other than the three named are not read.
    """
    arcs = materialize(write_arc(pages, page_id, url, html, date))
    warcs = write_warc(with_originals(read_arc(arcs)))
    path = scratch(pages.sparkSession)
    warcs.write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(warcs.schema).parquet(path)


SQL = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN top <> page_id OR (page_id IS NULL AND top IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id OR (page_id IS NULL AND top IS NOT NULL) THEN top END AS refers_to
FROM p
"""
