import base64
import hashlib
import json
from collections import Counter

from tierscore.llm import warc

SCHEMA = "page_id bigint, url string, html string, block string, date string"
PAGE = '<title>T &amp; x</title><p>Hello <b>w</b>orld<br>next</p><a href="/a?x=1&amp;y=2">l</a><script>no</script><!-- c -->'


def derive(spark, rows):
    return warc.derive(warc.responses_from_pages(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)))


def sha(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_linked_records(spark):
    rows = [(1, "http://h/p", PAGE), (2, None, None), (None, "http://h/", ""), (1, "http://h/p", PAGE)]
    got = derive(spark, rows).collect()
    assert Counter(r.record_type for r in got) == {"metadata": 4, "conversion": 4}
    one = [r for r in got if r.page_id == 1]
    assert len({r.record_id for r in one}) == 2 and len({r.refers_to for r in one}) == 1
    meta, text = (next(r for r in one if r.record_type == k) for k in ("metadata", "conversion"))
    assert text.content == "T & x\nHello world\nnext\nl"
    assert text.content_length == len(text.content) and text.block_digest == sha(text.content.encode())
    assert text.source_payload_digest == meta.source_payload_digest == sha(PAGE.encode())
    assert text.source_headers == {"content-type": "text/html; charset=utf-8", "content-length": str(len(PAGE))}
    data = json.loads(meta.content)
    assert data["title"] == "T & x" and data["links"] == [{"path": "A@/href", "url": "http://h/a?x=1&y=2"}]
    assert all(r.content == "" for r in got if r.page_id != 1 and r.record_type == "conversion")


def test_response_blocks():
    block = b"HTTP/1.1 301 Moved\r\nX-A: 1\r\nx-a: 2\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xe9"
    status, headers, payload = warc.parse_block(block)
    assert status == "HTTP/1.1 301 Moved" and headers["x-a"] == "1, 2"
    assert warc.decoded(payload, headers) == "é"
    assert warc.parse_block(b"<p>") == ("", {}, b"<p>")
    assert warc.decoded(b"x", {"content-type": "text/html; charset=nonsense"}) == "x"


def test_empty_table(spark):
    assert derive(spark, []).count() == 0
