"""Metadata and plain-text derivatives of WARC response records.

``responses_from_pages`` makes response records of crawled pages, ``parse_block`` reads the HTTP
message of any response record, and ``derive`` writes two records for each: ``metadata`` (status,
headers, title and links as JSON) and ``conversion`` (plain text). Both keep the response's target,
date and selected headers, and refer to its record id; digests are SHA-1 in base 32, as in the WARC
format. Rows are independent: no shuffle, one page in memory at a time.

A null html counts as empty, a null url as the empty target; repeated rows give repeated records with
the same ids; a block without a header gives an empty header and its bytes as the payload; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscore.llm.common import whole_text

# Names of the record fields and the media types of the two derivatives.
RESPONSE = "page_id bigint, record_id string, target_uri string, date string, block binary"
DERIVED = (
    "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, source_headers map<string,string>, source_payload_digest string, block_digest string, "
    "content_length bigint, content string"
)
KINDS = {"metadata": "application/json", "conversion": "text/plain; charset=utf-8"}
DROPPED = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|aside|title|form|pre|blockquote)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]*>")
LINK = re.compile(r"""<(a|img|link|script|form|iframe)\b[^>]*?\b(href|src|action)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I | re.S)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)


def record_id(kind: str, *parts: object) -> str:
    """The same record always gets the same id, so a task that runs again changes nothing."""
    name = "\x1f".join(str(p) for p in (kind, *parts))
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def responses_from_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """RESPONSE records of ``page_id, url, html`` rows, with an HTTP header of the page's size and type."""
    body = whole_text("html").cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    uri, page = whole_text("url"), F.col("page_id").cast("bigint")
    sha = F.sha1(F.concat_ws("\x1f", F.lit("response"), page.cast("string"), uri))
    cuts = [F.substring(sha, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        page.alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">")).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head.cast("binary"), body).alias("block"),
    )


def parse_block(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (lower-case names, repeated ones joined by a comma) and payload."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return lines[0], headers, payload


def decoded(payload: bytes, headers: dict[str, str]) -> str:
    m = re.search(r"charset=[\"']?([\w.:-]+)", headers.get("content-type", ""), re.I)
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """All visible text, one line per block element."""
    text = html.unescape(TAG.sub("", BREAK.sub("\n", DROPPED.sub("", page)).replace("\x00", "")))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str, base: str) -> list[dict[str, str]]:
    found = []
    for tag, attribute, value in LINK.findall(page):
        value = html.unescape(value.strip("\"'"))
        try:
            url = urljoin(base, value)
        except ValueError:
            url = value
        found.append({"path": f"{tag.upper()}@/{attribute.lower()}", "url": url})
    return found


def derive(responses: DataFrame, kept_headers: tuple[str, ...] = ("content-type", "content-length")) -> DataFrame:
    """DERIVED records: one ``metadata`` and one ``conversion`` per response."""

    def both(page_id, source: str, uri: str, date: str, block: bytes) -> Iterator[tuple]:
        status, headers, payload = parse_block(block)
        page, paid = decoded(payload, headers), digest(payload)
        bare = DROPPED.sub("", page)
        title = TITLE.search(bare)
        meta = {
            "status": status,
            "headers": headers,
            "title": " ".join(html.unescape(TAG.sub("", title[1])).split()) if title else "",
            "links": links(bare, uri),
        }
        contents = {"metadata": json.dumps(meta, ensure_ascii=False, sort_keys=True), "conversion": plain_text(page)}
        kept = [(h, headers[h]) for h in kept_headers if h in headers]
        for kind, content in contents.items():
            data = content.encode("utf-8", "surrogatepass")
            name = record_id(kind, source, page_id)
            yield page_id, kind, name, source, uri, date, KINDS[kind], kept, paid, digest(data), len(data), content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in DERIVED.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [r for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in both(*x)]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return responses.select("page_id", "record_id", "target_uri", "date", "block").mapInArrow(run, DERIVED)
