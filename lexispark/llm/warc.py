"""Conversion of the older ARC archives to WARC records.

An ARC file begins with a version block (``filedesc://``) that says how many fields the header line of each record has:
five in version 1, ten in version 2. The last field declares the length of what follows. URLs with blanks are found by
reading the fields from the right. Each record becomes a WARC record with an identifier made of its content, so that a
repeated conversion gives the same, its date in the form of ISO 8601, a type that depends on what it holds, and
SHA-1 digests of its block and its payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import table, text_slices

#: Fields of a header line, by version.
FIELDS = {1: 5, 2: 10}
#: Pages that are written to an archive of each version at most.
ARCHIVE_PAGES = 64
#: Bytes that are decompressed at once.
CHUNK = 1 << 20
#: Bytes of records that are handed on at once.
BATCH_BYTES = 16_000_000
#: Date of the page with id 0 in archives made of pages; each later one is a minute later.
FIRST_DATE = datetime(1998, 1, 1)
HTTP = re.compile(rb"HTTP/\d\.\d \d{3}[^\r\n]*\r?\n")
BLANK_LINE = re.compile(rb"\r?\n\r?\n")
SCHEMA = "archive string, arc_version int, warc_type string, record_id string, warc_date string, target_uri string, ip_address string, content_type string, payload_type string, content_length long, block_digest string, payload_digest string, error string, record binary"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(stamp: str) -> str | None:
    """ISO 8601 of an ARC date of 4 to 14 digits; what is missing counts as the earliest; None if it names no moment."""
    if not re.fullmatch(r"\d{4,14}", stamp) or len(stamp) % 2:
        return None
    try:
        return datetime.strptime(stamp + "00000101000000"[len(stamp) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def record_id(uri: str, date: str, digest: str) -> str:
    """A name-based UUID of what identifies the record."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{uri} {date} {digest}'.encode()).digest(), version=3)}>"


MAGIC = b"\x1f\x8b\x08"


def members(content: bytes) -> Iterator[tuple[bytes, bool]]:
    """What each gzip member of a file holds, and whether it is whole; other content is one whole member.

    A damaged member gives what could be read of it, and reading goes on at the next place that looks like a member's beginning.
    """
    if content[:2] != MAGIC[:2]:
        yield content, True
        return
    at = 0
    while at < len(content):
        if content[at : at + 2] != MAGIC[:2]:
            # padding between members, or what a damaged one left
            at = content.find(MAGIC, at)
            if at < 0:
                return
        stream, out, here = zlib.decompressobj(31), [], at
        try:
            while not stream.eof and here < len(content):
                out.append(stream.decompress(content[here : here + CHUNK]))
                here += CHUNK
            whole = stream.eof
        except zlib.error:
            whole = False
        yield b"".join(out), whole
        if whole:
            at = min(here, len(content)) - len(stream.unused_data)
        else:
            following = content.find(MAGIC, at + 1)
            at = following if following > 0 else len(content)


def archive_records(content: bytes) -> Iterator[tuple[int, list[str], bytes, str | None]]:
    """The records of all members: an error hides the rest of its member, and no other."""
    version = 1
    for data, whole in members(content):
        last = None
        for last in arc_records(data, version):
            version = last[0]
            if whole or last[3] is None:
                yield last
        if not whole:
            # what stands in the way is the damage, whatever the record's own state
            yield version, last[1][:1] if last is not None else [""], b"", "gzip"


def arc_records(content: bytes, version: int = 1) -> Iterator[tuple[int, list[str], bytes, str | None]]:
    """(version, header fields, block, error) of each record. After an error that hides where the next begins, none follow."""
    at = 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if line.startswith("filedesc://"):
            # the version stands at the start of the block's first line
            found = re.match(rb"\s*([12]) ", content[end + 1 : end + 16])
            version = int(found[1]) if found else 2 if len(line.split(" ")) == FIELDS[2] else 1
        fields = line.rsplit(" ", FIELDS[version] - 1)
        if len(fields) != FIELDS[version] or not fields[-1].isascii() or not fields[-1].isdigit():
            yield version, [line], b"", "header"
            return
        size = int(fields[-1])
        block = content[end + 1 : end + 1 + size]
        if len(block) < size:
            yield version, fields, block, "truncated"
            return
        yield version, fields, block, None
        at = end + 1 + size


def to_warc(archive: str | None, version: int, fields: list[str], block: bytes, error: str | None) -> tuple:
    """A row of SCHEMA. A broken header gives the error and nothing else; a truncated block is kept as far as it goes."""
    if error in ("header", "gzip"):
        return archive, version, None, None, None, fields[0], None, None, None, None, None, None, error, None
    uri, ip, stamp, mime = fields[:4]
    date = warc_date(stamp)
    error = error or (None if date else "date")
    status = HTTP.match(block)
    payload, kind, content_type = None, "resource", mime
    if uri.startswith("filedesc://"):
        kind = "warcinfo"
    elif status and uri.startswith(("http://", "https://")):
        kind, content_type = "response", "application/http; msgtype=response"
        blank = BLANK_LINE.search(block)
        payload = block[blank.end() :] if blank else b""
    elif uri.startswith("dns:"):
        content_type = "text/dns"
    digest = sha1(block)
    name = record_id(uri, date or stamp, digest)
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date or stamp}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {uri[len('filedesc://'):]}")
    else:
        lines += [f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip}"]
    lines.append(f"WARC-Block-Digest: {digest}")
    if payload is not None:
        lines += [f"WARC-Payload-Digest: {sha1(payload)}", f"WARC-Identified-Payload-Type: {mime}"]
    if error == "truncated":
        lines.append("WARC-Truncated: unspecified")
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return archive, version, kind, name, date, uri, ip, content_type, mime, len(block), digest, None if payload is None else sha1(payload), error, record


def convert_archives(archives: DataFrame, *, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """One row for each ARC record: its WARC fields, and the whole ``record`` in bytes.

    Archives may be gzip files of any number of members, read member by member. ``error`` is null, or ``header`` (a line
    without the fields of its version: the line is in ``target_uri``, and what follows in the member can't be read),
    ``truncated`` (less than the declared length), ``gzip`` (a damaged member: the last URI that could be read of it is in
    ``target_uri``, records before the damage and other members have their rows) or ``date`` (no moment; ``warc_date`` is
    null). Null or empty contents give no rows, repeated archives their rows each time;
    other columns aren't read.
    """
    types = [pa.string(), pa.int32(), *[pa.string()] * 7, pa.int64(), *[pa.string()] * 3, pa.binary()]

    def give(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for version, fields, block, error in archive_records(content or b""):
                    rows.append(to_warc(name, version, fields, block, error))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield give(rows)
                        rows, size = [], 0
        if rows:
            yield give(rows)

    return archives.select(F.col(name_col).cast("string").alias("archive"), F.col(content_col).alias("content")).mapInArrow(run, SCHEMA)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files under a path."""
    return convert_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), name_col="path")


def arc_of(rows: list[tuple[int, str, str]], version: int, name: str) -> bytes:
    """An ARC file of (id, url, html) rows, each as a response of HTTP/1.0."""
    origin = "URL IP-address Archive-date Content-type " + ("Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length")
    block = f"{version} 0 lexispark\n{origin}\n".encode()
    stamp = FIRST_DATE.strftime("%Y%m%d%H%M%S")
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {stamp} text/plain{middle} {len(block)}\n".encode() + block]
    size = len(out[0])
    for key, url, html in rows:
        body = html.encode("utf-8", "replace")
        block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        stamp = (FIRST_DATE + timedelta(minutes=key % 10_000_000)).strftime("%Y%m%d%H%M%S")
        ip = f"10.{key // 65536 % 256}.{key // 256 % 256}.{key % 256}"
        middle = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {size} {name}"
        out.append(f"\n{url} {ip} {stamp} text/html{middle} {len(block)}\n".encode() + block)
        size += len(out[-1])
    return b"".join(out)


def pages_to_arc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_pages: int = ARCHIVE_PAGES) -> DataFrame:
    """(archive, content): the pages as ARC files, those with an even id as version 1 and the others as version 2.

    Pages of which id, url or html is null can't stand in an archive and are left out. Blanks and breaks in a URL are percent-encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            keys, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            waiting: dict[int, list[tuple[int, str, str]]] = {1: [], 2: []}
            for start, part in text_slices(batch, 2):
                names, contents = [], []
                for i, html in enumerate(part, start):
                    version = 1 + keys[i] % 2
                    waiting[version].append((keys[i], re.sub(r"[\s\x00]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), urls[i]), html))
                last = start + len(part) == batch.num_rows
                for version, rows in waiting.items():
                    while len(rows) >= archive_pages or rows and last:
                        name = f"{n}-{rows[0][0]}-v{version}.arc"
                        names.append(name)
                        contents.append(arc_of(rows[:archive_pages], version, name))
                        del rows[:archive_pages]
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["archive", "content"])

    whole = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return whole.where("id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL").mapInArrow(run, "archive string, content binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written as ARC files of both versions and converted; the archives' own descriptions don't count as pages.

    ``record`` is the whole WARC record; all of it is UTF-8 here. Pages of which id, url or html is null give no row.
    """
    rows = convert_archives(pages_to_arc(table(spark, sf_dir, "pages"))).where("warc_type <> 'warcinfo' OR warc_type IS NULL")
    return rows.select(*[n for n in NAMES if n not in ("archive", "record")], F.decode("record", "UTF-8").alias("record"))


_CRLF = "chr(13) || chr(10)"
SQL = rf"""
WITH blocks AS (
  SELECT page_id AS k, url, html, 'HTTP/1.0 200 OK' || {_CRLF} || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(html) || {_CRLF} || {_CRLF} || html AS block
  FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL),
hashed AS (SELECT *, sha1(block) AS b, sha1(html) AS p FROM blocks),
named AS (
  SELECT *, 'sha1:' || {{b}} AS block_digest, 'sha1:' || {{p}} AS payload_digest,
    strftime(TIMESTAMP '{FIRST_DATE}' + to_minutes((k % 10000000)::INT), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
    '10.' || (k // 65536 % 256) || '.' || (k // 256 % 256) || '.' || (k % 256) AS ip_address FROM hashed),
ids AS (SELECT *, md5(url || ' ' || warc_date || ' ' || block_digest) AS u FROM named),
done AS (
  SELECT *, '<urn:uuid:' || u[1:8] || '-' || u[9:12] || '-3' || u[14:16] || '-' || substr('89ab', ((strpos('0123456789abcdef', u[17]) - 1) % 4 + 1)::INT, 1) || u[18:20] || '-' || u[21:32] || '>' AS record_id FROM ids)
SELECT (1 + k % 2)::INT AS arc_version, 'response' AS warc_type, record_id, warc_date, url AS target_uri, ip_address,
  'application/http; msgtype=response' AS content_type, 'text/html' AS payload_type, strlen(block)::BIGINT AS content_length, block_digest, payload_digest, NULL::VARCHAR AS error,
  'WARC/1.0' || {_CRLF} || 'WARC-Type: response' || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Date: ' || warc_date || {_CRLF} || 'WARC-Target-URI: ' || url || {_CRLF}
    || 'WARC-IP-Address: ' || ip_address || {_CRLF} || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || 'WARC-Payload-Digest: ' || payload_digest || {_CRLF}
    || 'WARC-Identified-Payload-Type: text/html' || {_CRLF} || 'Content-Type: application/http; msgtype=response' || {_CRLF} || 'Content-Length: ' || strlen(block) || {_CRLF} || {_CRLF} || block || {_CRLF} || {_CRLF} AS record
FROM done
""".replace("{b}", "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(b, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)), '')").replace(
    "{p}", "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(p, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)), '')"
)
