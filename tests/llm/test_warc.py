import base64
import gzip
import hashlib
import re
import time
import zlib
from html.parser import HTMLParser

import pytest

from vicinity.llm import warc as R
from vicinity.sources.points import read_table

SF = "/root/testdata/sf0.001"


class Reader(HTMLParser):
    """Text of a page by a parser: what no hidden element holds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head", "template", "noscript", "svg", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head", "template", "noscript", "svg", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def letters(text):
    return re.sub(r"\s", "", text)


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_text_equals_a_parser(spark):
    for p in read_table(spark, SF, "pages").collect():
        reader = Reader()
        reader.feed(p.html)
        reader.close()
        assert letters(R.plain_text(p.html)) == letters("".join(reader.parts))


def test_plain_text_by_hand():
    page = "<html><head><title>T</title></head><body><p>a &amp; b<br>c</p><!-- x --><script>var t='</p>';</script><td>d</td><td>e</td> 1 < 2 <b>f</b>g"
    assert R.plain_text(page) == "a & b\nc\nd e 1 < 2 fg"
    assert R.plain_text("") == "" and R.plain_text("<p>é</p>𝒳") == "é\n𝒳"


@pytest.mark.parametrize("page, text", [
    # A head without its end tag ends at the first thing that may not stand in it.
    ("<html><head><title>T</title><body><p>hello</p>", "hello"),
    ("<head><meta charset=utf-8><title>T</title><script>x</script><p>hello<div>you</div>", "hello\nyou"),
    ("<head><link rel=a>hello", "hello"),
    ("<head><style>a</style><noscript><style>b</style></noscript></head><body>hello", "hello"),
    # An svg that closes itself is empty; one left open ends at HTML's next element.
    ('<p>a<svg class="i"/>b</p><p>c</p>', "a b\nc"),
    ('<p>a<svg aria-label="x>y"/>b</p><svg><path/></svg>c', "a b\nc"),
    ("<p>a<svg><path d=''></p><p>b</p><svg><text>no</text></svg><p>c</p>", "a\nb\nc"),
    ("a<svg><g><svg><text>no</text></svg><text>no</text></g></svg>b", "a b"),
    ("a<svg><style/><title/><text>no</text></svg>b", "a b"),
    ("a<svg><title>no</svg>b<p>c", "a b\nc"),
    ("a<svg><foreignObject><div>no</div></foreignObject><text>no</text></svg>b", "a b"),
    ("a<svg><desc><p>no</p></desc></svg>b", "a b"),
    ("<svg> a", "a"),
    ("<a href=x><svg><path></a> b <p>c", "b\nc"),
    ("<a href=x><svg><a><text>no</text></a><text>no</text></svg></a>b", "b"),
    ("<template><svg><path></template>a<p>b", "a\nb"),
    # Left open, template and noscript hide nothing, also if another one is closed later.
    ("a<template>b<p>c", "ab\nc"),
    ("a<noscript>b<p>c</p><noscript>no</noscript>d", "ab\nc\nd"),
    ("a<template>no<template>no</template>no<script>'</template>'</script>no</template>b", "a b"),
    # Custom elements are others.
    ("<head-line>a</head-line><svg-icon>b</svg-icon> <title-bar>c</title-bar><template-x>d<p-x>e", "ab cde"),
    # What HTML runs to the end of the page.
    ("a<!-- b<p>c", "a"), ("a<script>b<p>c", "a"), ("a<style>b<p>c", "a"), ("a<title>b<p>c", "a"), ("a<!-->b<!--->c<!-- x --!>d", "a b c d"),
])
def test_elements_left_open_take_no_text_along(page, text):
    assert R.plain_text(page) == text


def test_many_open_elements_take_one_pass():
    for tag in ("<svg>", "<template>", "<noscript>", "<svg><desc>", "<svg></template>", "<svg><p>", "<svg"):
        assert R.plain_text(tag * 20_000 + "<p>hello").endswith("hello") or tag == "<svg"


def test_records_link_back_and_keep_digests(spark):
    pages = {r.page_id: r for r in read_table(spark, SF, "pages").collect()}
    source = R.responses(read_table(spark, SF, "pages"))
    ids = {r.page_id: r.record_id for r in source.collect()}
    assert len(set(ids.values())) == len(pages)
    rows = R.build_derivatives(source, ["page_id"]).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    conversion = {r.refers_to: r.record_id for r in rows if r.warc_type == "conversion"}
    for r in rows:
        page = pages[r.page_id]
        assert r.refers_to == ids[r.page_id] == r.headers["WARC-Refers-To"] and r.target_uri == page.url
        assert r.source_payload_digest == sha1(page.html.encode()) and r.block_digest == sha1(r.body.encode())
        assert r.content_length == len(r.body.encode()) == int(r.headers["Content-Length"])
        if r.warc_type == "metadata":
            assert f"conversion: {conversion[r.refers_to]}" in r.body and "source-header-content-type: text/html; charset=utf-8" in r.body
        else:
            assert r.body == R.plain_text(page.html)


def test_files_round_trip_and_rederive(spark, tmp_path):
    source = R.responses(read_table(spark, SF, "pages"), date="2024-01-02T03:04:05Z")
    rows = R.build_derivatives(source)
    for compression in ("gzip", "none"):
        R.write_warc(rows, f"{tmp_path}/{compression}", compression)
        back = {r.record_id: r for r in R.read_warc(spark, f"{tmp_path}/{compression}").collect()}
        for r in rows.collect():
            b = back[r.record_id]
            assert bytes(b.block).decode() == r.body and b.headers == r.headers and b.refers_to == r.refers_to and b.warc_date == "2024-01-02T03:04:05Z"


def test_responses_read_from_a_file(spark, tmp_path):
    """A response record of another writer, gzip by record: its own digest and headers are preserved."""
    import gzip

    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-Odd: a\tb\r\n\r\n<html lang=FR><title>x\ny</title><a href='/z'>gone</a>"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:KEPT\r\nContent-Length: {len(block)}\r\n\r\n"
    one = gzip.compress(head.encode() + block + b"\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(one + one)
    found = R.read_warc(spark, str(tmp_path / "a.warc.gz"))
    rows = R.build_derivatives(found.where("warc_type = 'response'")).collect()
    assert len(rows) == 4 and {r.source_payload_digest for r in rows} == {"sha1:KEPT"} and {r.refers_to for r in rows} == {"<urn:uuid:1>"}
    meta = next(r.body for r in rows if r.warc_type == "metadata")
    for line in ("status: HTTP/1.1 404 Not Found", "source-header-x-odd: a b", "title: x y", "language: fr", "links: 1"):
        assert line in meta.split("\r\n")
    assert {r.body for r in rows if r.warc_type == "conversion"} == {"gone"}


def test_hostile(spark):
    df = spark.createDataFrame(
        [(None, None, None, "a"), (1, "http://x", "", "b"), (1, "http://x", "", "b"), (2, "http://y\r\nEvil: 1", "<p>" * 5000 + "deep", "c"), (3, None, "plain 1 < 2 & 3", None)],
        "page_id long, url string, html string, body string",
    )
    rows = R.build_derivatives(R.responses(df), ["page_id", "body"]).collect()
    assert len(rows) == 10 and len({r.record_id for r in rows}) == 8
    assert all("\r" not in v and "\n" not in v for r in rows for v in r.headers.values())
    text = {(r.page_id, r.body) for r in rows if r.warc_type == "conversion"}
    assert text == {(None, ""), (1, ""), (2, "deep"), (3, "plain 1 < 2 & 3")}
    empty = spark.createDataFrame([], df.schema)
    assert R.build_derivatives(R.responses(empty), ["page_id"]).collect() == []


@pytest.mark.parametrize("piece", ["<a ", "<html ", "<title>", "<title ", '<p a="', "<svg ", "<!-", "</td", "<script ", "<svg><a ", "&#", "<a href=x <b ", "<noscript><title "])
@pytest.mark.parametrize("tail", ["", ">", "-->"])
def test_crafted_pages_take_linear_time(piece, tail):
    page = (piece * (1_000_000 // len(piece)) + tail).encode()
    source = {"record_id": "<x>", "target_uri": None, "warc_date": None, "payload_digest": None, "block": b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page}
    began = time.process_time()
    assert len(R.derive(source)) == 2
    assert time.process_time() - began < 5


def response(head, payload, **more):
    return {"record_id": "<r>", "target_uri": "http://h/", "warc_date": None, "payload_digest": None, "block": f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + payload} | more


def test_encoded_payloads_are_decoded():
    page = "<html><body><p>café</p></body></html>"
    latin, packed = page.encode("latin-1"), gzip.compress(page.encode())
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    for head, payload in [
        ("Content-Type: text/html; charset=iso-8859-1", latin), ("Content-Type: text/html; charset=nonsense", page.encode()),
        ("Content-Type: text/html\r\ncontent-encoding: gzip", packed), ("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(page.encode())),
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked),
    ]:
        assert R.derive(response(head, payload))[1]["body"] == "café", head
    for head, payload in [("Content-Type: image/png", b"\x89PNG"), ("Content-Type: text/html\r\nContent-Encoding: gzip", packed[:-9]), ("Content-Type: text/html\r\nTransfer-Encoding: chunked", b"zz\r\nx"), ("Content-Type: text/html\r\nContent-Encoding: br", b"x")]:
        records = R.derive(response(head, payload))
        assert [r["warc_type"] for r in records] == ["metadata"] and "conversion:" not in records[0]["body"]


def test_headers_without_a_value_and_responses_without_an_id():
    body = R.derive(response("X-Empty:\r\nContent-Type: text/plain", b"x"))[0]["body"]
    assert "source-header-x-empty: \r\n" in body
    one, two = (R.derive(response("Content-Type: text/plain", p, record_id=None)) for p in (b"x", b"y"))
    assert one[0]["refers_to"] is None and "WARC-Refers-To" not in one[0]["headers"]
    assert len({r["record_id"] for r in one + two}) == 4 and one == R.derive(response("Content-Type: text/plain", b"x", record_id=None))


def record(head, block):
    return b"WARC/1.1\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_broken_files_give_rows_with_an_error(spark, tmp_path):
    good = record(b"warc-type: response\r\nwarc-record-id: <a>\r\ncontent-length: 3", b"abc")
    request = record(b"WARC-Type: request\r\nContent-Length: 2", b"hi")
    files = {
        "a": good + record(b"WARC-Type: response\r\nContent-Length: x", b"lost") + good, "b": good + b"WARC/1.1\r\nWARC-Type: resp",
        "c": good + record(b"Content-Length: 99", b"short"), "d": gzip.compress(good) + gzip.compress(good)[:-4], "e": gzip.compress(good * 3)[:20], "f": b"", "g": b"no warc", "h": request,
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = {name: [(bytes(r.block), r.error is None) for r in R.read_warc(spark, str(tmp_path / name)).collect()] for name in files}
    assert rows["a"] == [(b"abc", True), (b"", False), (b"abc", True)] and rows["b"] == [(b"abc", True), (b"", False)]
    assert rows["c"][0] == (b"abc", True) and not rows["c"][1][1] and rows["d"][0] == (b"abc", True)
    assert all(not ok for _, ok in rows["e"]) and rows["f"] == rows["g"] == [] and rows["h"] == [(b"hi", True)]
    read = R.read_warc(spark, str(tmp_path / "a"))
    assert {r.record_id for r in read.collect()} == {"<a>", None}
    assert R.build_derivatives(R.read_warc(spark, str(tmp_path / "h"))).count() == 0
    assert R.build_derivatives(read.where("error IS NULL")).count() == 4
