"""WARC derivatives: metadata and plain-text conversion records of HTTP responses.

``responses`` wraps raw pages into WARC/1.1 response records. ``derivatives`` reads any
response record and makes two records of it that refer to it: a metadata record
(fields of the response and of the page) and a conversion record (the page's text).
All identifiers are name-based UUIDs of content, so a task that runs again makes the
same bytes, and record dates are those of the responses. Records stand for themselves,
so a file of any of them in any order is a WARC file; ``write`` writes one gzip member
for each record.

All headers of the source, those of the record and those of HTTP, are in the metadata
record in their order, repeated ones as often as they stand there. Chunked and
compressed bodies are decoded before their text is taken.

Defined results: a null page is an empty one; a null URL is the empty target; broken
HTML is read as far as it goes, in time that grows with its length; a record whose
digest does not match its payload keeps the digest it states and is marked; a null
record, one that can't be read as WARC and one that is no HTTP response give a row of
nulls; a body that can't be decoded is read as far as it goes; repeated pages give
repeated records with equal identifiers; an empty table gives none; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f6d3a3e-2a55-5d0c-9a52-0d7e3b1f4c10")
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: str | bytes) -> str:
    name = b"\0".join(p if isinstance(p, bytes) else p.encode() for p in parts)
    return f"<urn:uuid:{uuid.uuid5(_SPACE, hashlib.sha256(name).hexdigest())}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_header(v)}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF


def _header(value: str) -> str:
    """One line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def fields(head: bytes) -> list[tuple[str, str]]:
    """Names and values of header lines, the first line left out; a line that begins with a blank goes on with the value before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        else:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _by_name(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """First value of each name, in lower case."""
    out: dict[str, str] = {}
    for name, value in pairs:
        out.setdefault(name.lower(), value)
    return out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, the first of repeated ones) and block of a record; ValueError if it is none."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _by_name(fields(head))
    size = int(headers.get("content-length", len(rest)))
    if size < 0:
        raise ValueError("a record of negative length")
    return headers, rest[:size]


def response(url: str, page: str) -> bytes:
    body = page.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, body)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)),
        ],
        block,
    )


# No pattern can fail after it has looked far ahead: what is not closed goes to the end of the page, so each is linear.
_DROP = re.compile(r"<!--(?:.*?-->|.*)|<(script|style|template|noscript)\b(?:[^>]*>(?:.*?</\1\s*>|.*)|[^>]*)|<!\w[^>]*>?", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|head|body|html|blockquote|pre|hr|form|main|aside|dd|dt|dl|td|th)\b[^>]*>?", re.I)
_TAG = re.compile(r"</?[A-Za-z][^>]*>?")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b(?:[^>]*>(.*?)(?:</title\s*>|\Z)|[^>]*\Z)", re.S | re.I)
_ANCHOR = re.compile(r"<a\b([^>]*)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)


def plain(page: str) -> str:
    """The page's visible text: block elements end lines, runs of white space become one blank, empty lines go."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page)))
    text = _BLANK.sub(" ", html.unescape(text))
    return _LINES.sub("\n", text).strip(" \n")


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return head.partition(b"\r\n")[0].decode("utf-8", "replace"), fields(head), body


def _dechunked(body: bytes) -> bytes:
    """A chunked body put together, as far as it can be read."""
    out, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        try:
            size = int(body[at:line_end].partition(b";")[0], 16) if line_end >= 0 else 0
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[line_end + 2 : line_end + 2 + size])
        at = line_end + 4 + size
    return b"".join(out)


def _unpacked(body: bytes, coding: str) -> bytes:
    """A body of content coding gzip or deflate, as far as it can be read; of others as it is."""
    kinds = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding.strip().lower(), ())
    for bits in kinds:
        stream, out = zlib.decompressobj(bits), []
        try:
            for at in range(0, len(body), 1 << 16):
                out.append(stream.decompress(body[at : at + (1 << 16)]))
        except zlib.error:
            if not out:
                continue
        return b"".join(out)
    return body


@dataclass
class Derived:
    refers_to: str
    metadata_id: str
    metadata: bytes
    conversion_id: str
    conversion: bytes
    text: str
    payload_digest: str
    digest_ok: bool
    n_links: int


def derive(raw: bytes | None) -> Derived | None:
    """The metadata and the conversion record of a response record; None of anything else."""
    try:
        headers, block = parse(raw or b"")
    except ValueError:
        return None
    if headers.get("warc-type", "response").lower() != "response" or not block.startswith(b"HTTP/"):
        return None
    status, sent, stored = http(block)
    of = _by_name(sent)
    body = _dechunked(stored) if "chunked" in of.get("transfer-encoding", "").lower() else stored
    digests_ = {digest(stored), digest(body)}
    for coding in reversed(of.get("content-encoding", "").split(",")):
        body = _unpacked(body, coding)
    said = _CHARSET.search(of.get("content-type", ""))
    try:
        page = body.decode(said[1] if said else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source, target, date = headers.get("warc-record-id", ""), headers.get("warc-target-uri", ""), headers.get("warc-date", DATE)
    stated = headers.get("warc-payload-digest") or digest(stored)
    text = plain(page)
    title = _TITLE.search(page)
    links = [m[1] or m[2] or m[3] or "" for a in _ANCHOR.finditer(page) if (m := _HREF.search(a[1]))]
    html_ = _HTML.search(page)
    lang = _LANG.search(html_[1]) if html_ else None
    whole_title = title[1] if title else None
    shared = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)]
    facts = [("http-status", status), ("source-content-type", of.get("content-type", "")), ("source-block-digest", headers.get("warc-block-digest", "")), ("source-payload-digest", stated)]
    facts += [("digest-verified", str(stated in digests_).lower()), ("title", plain(whole_title) if whole_title else ""), ("lang", lang[1] if lang else ""), ("text-digest", digest(text.encode()))]
    facts += [("source-warc-header", f"{k}: {v}") for k, v in fields(raw.partition(b"\r\n\r\n")[0])]
    facts += [("source-http-header", f"{k}: {v}") for k, v in sent]
    facts += [("outlink", x) for x in links]
    notes = "".join(f"{k}: {_header(v)}\r\n" for k, v in facts).encode()
    written = text.encode("utf-8", "replace")
    meta_id, text_id = record_id("metadata", source, notes), record_id("conversion", source, written)
    meta = record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *shared, ("WARC-Concurrent-To", text_id), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(notes))], notes)
    conv = record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *shared, ("WARC-Source-Payload-Digest", stated), ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(written))], written)
    return Derived(source, meta_id, meta, text_id, conv, text, stated, stated in digests_, len(links))


def responses(pages: DataFrame) -> DataFrame:
    """page_id and a response record for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [response(u or "", h or "") for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(made, pa.binary())], ["page_id", "record"])

    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, record binary")


_FIELDS = "refers_to string, metadata_id string, metadata binary, conversion_id string, conversion binary, text string, payload_digest string, digest_ok boolean, n_links long"


def derivatives(records: DataFrame) -> DataFrame:
    """page_id and the derived records of every record (column record); nulls for what is no response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        kinds = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}
        types = [kinds[x.split()[1]] for x in _FIELDS.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [derive(x.as_py()) for x in part.column("record")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *(pa.array([getattr(d, k) if d else None for d in made], t) for k, t in zip(names, types, strict=True))], ["page_id", *names])

    ship(records.sparkSession)
    kind = records.schema["page_id"].dataType.simpleString()
    return records.select("page_id", "record").mapInArrow(run, f"page_id {kind}, {_FIELDS}")


def digests(pages: DataFrame) -> DataFrame:
    """Per page: the two derived records with the page's text, and the identifiers and digests that link them with the response."""
    made = derivatives(responses(pages))
    return made.select(
        "page_id", "refers_to", "metadata_id", "conversion_id", "payload_digest", "digest_ok", "n_links",
        F.char_length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"),
        F.octet_length("metadata").cast("long").alias("metadata_bytes"), F.sha2("metadata", 256).alias("metadata_sha256"),
        F.octet_length("conversion").cast("long").alias("conversion_bytes"), F.sha2("conversion", 256).alias("conversion_sha256"),
        "metadata", "conversion", "text",
    )


def write(derived: DataFrame, path: str) -> None:
    """Derived records as rows of gzip members in part files; concatenating the members gives ``.warc.gz`` files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            both = [gzip.compress(m.as_py() or b"", mtime=0) + gzip.compress(c.as_py() or b"", mtime=0) for m, c in zip(b.column("metadata"), b.column("conversion"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(both, pa.binary())], ["page_id", "members"])

    ship(derived.sparkSession)
    kind = derived.schema["page_id"].dataType.simpleString()
    derived.select("page_id", "metadata", "conversion").mapInArrow(run, f"page_id {kind}, members binary").write.parquet(path)
