"""Derived WARC records: linked metadata and plain text for every response.

A response record (HTTP headers and payload) gives two records that name it
in ``WARC-Refers-To``, with its target and date:

* ``metadata`` (``application/warc-fields``): status line and source headers of
  the response, title, language, number of links, size of the text, and the
  id of the conversion record;
* ``conversion`` (``text/plain``): the text of an HTML payload, one line per
  block.

Digests are ``sha1:`` and base 32, over the block of each record; the payload
digest of the source is kept where its record has one, and computed otherwise.
Record ids follow from the response's id and the kind of record, so a rerun
gives the same ids. Each response is handled by itself: no shuffle.

The text leaves out comments, scripts, styles and titles (left open, they run
to the end of the page, as in HTML), and closed svg, template and noscript
elements. Left open, an svg ends at the first tag that is none of its own, and
a template or noscript hides nothing, so no text after it is lost. A head
hides nothing of its own: HTML ends it at the first text or element that may
not stand in it.

Payloads are decoded first: chunked transfer, gzip and deflate, then the charset
that the response names (UTF-8 if it names none or one unknown; bytes that do
not fit are replaced). What cannot be unpacked, or is no text by its type
(images, say), gets its metadata record only.

Every step takes time in proportion to the page, whatever it holds: a tag is
consumed where it is found, and behind the last ``>`` of a page only a comment can begin.

Edge cases: a null page is an empty payload; a null url gives records without
a target; a null record id gives records that refer to none, with ids drawn from target and
block; rows whose ``warc_type`` is another than response give none; a payload
that is not HTML gives its text as it is; headers cannot hold line breaks, they
become spaces; source headers without a value are kept. Repeated pages give
records alike. Carried columns named like an output column give way. A record of
a file that cannot be read (a header without end, a length that is no number or
goes beyond the file) is returned with what there is of it and ``error``; reading goes on at the
next record. Names of headers are read in any case. A file is read as one row, so it must be smaller than 2 GB.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import quoted, ship
from vicinity.sources.points import read_table

VERSION, CRLF = "WARC/1.1", "\r\n"
#: Date of responses whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
OUT = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, headers map<string,string>, body string"
)
NAMES = [c.split()[0] for c in OUT.split(", ")]

# The end of an element's name, and the rest of a tag, quoted values with ">" included.
_NAME_END, _REST = r"(?=[\s/>])", r"""[^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*')?+[^>=]*+)*+>"""
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|$))"
#: What HTML itself runs to the end of the page if it is left open: comments and elements whose content is no markup.
RAW = rf"{_COMMENT}|<(script|style|title){_NAME_END}{_REST}.*?(?:</\1{_NAME_END}[^>]*>|$)"
HIDDEN = re.compile(rf"(?is){RAW}")
NESTED = re.compile(rf"(?i)<(?:svg|template|noscript){_NAME_END}")
IN_HTML = re.compile(rf"(?is){RAW}|<(/?)(svg|template|noscript|foreignobject|desc|title){_NAME_END}{_REST}")
# In an svg, script, style and title are ordinary elements; HTML's elements (in a start or an end tag) end it.
IN_SVG = re.compile(
    rf"(?is){_COMMENT}|<!\[CDATA\[.*?(?:\]\]>|$)|<(/?)(svg|foreignobject|desc|title|a|"
    "address|article|aside|b|big|blockquote|body|br|button|caption|center|code|dd|details|div|dl|dt|em|embed|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|i|img|input|label|legend|li|listing|main|menu|meta|nav|nobr|noscript|ol|option|p|pre|"
    rf"ruby|s|section|select|small|span|strike|strong|sub|summary|sup|table|tbody|td|template|textarea|tfoot|th|thead|tr|tt|u|ul|var){_NAME_END}{_REST}"
)
BLOCKS = frozenset("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr table thead tbody article section header footer nav aside main form blockquote pre figure title head body html".split())
CELLS = frozenset(("td", "th"))
TAG = re.compile(r"</?([A-Za-z!?][^\s/>]*)[^>]*(?:>|$)")
TITLE, TITLE_END = re.compile(r"(?i)<title(?=[\s/>])[^<>]*>"), re.compile(r"(?i)</title\s*>")
LANGUAGE = re.compile(r"(?i)<html(?=[\s/>])[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)")
LINK = re.compile(r"(?i)<a(?=[\s/>])[^<>]*?\bhref\s*=")
CHARSET = re.compile(r"(?i)\bcharset\s*=\s*[\"']?([\w.:-]+)")
#: Types of payloads that are text (fixed values).
TEXT_TYPE = re.compile(r"(?i)^\s*(?:text/|application/(?:[\w.+-]*\+)?(?:json|xml|xhtml|javascript|ecmascript)|application/x-(?:www-form-urlencoded|javascript))|html")
_END = "\ue000"
SPACES = re.compile(r"[^\S\n]+")


def visible(page: str) -> str:
    """``page`` without comments and hidden elements. One pass: each step goes on behind the last tag."""
    if not NESTED.search(page):
        return HIDDEN.sub(" ", page)
    cuts: list[tuple[int, int]] = []
    # Elements open at this place, with the start of their tags, and how many there are of each name.
    inside: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    at = links = 0
    while True:
        svg = bool(inside) and inside[-1][0] == "svg"
        m = (IN_SVG if svg else IN_HTML).search(page, at)
        if not m:
            break
        at = m.end()
        slash, name = m.group(1, 2) if svg else m.group(2, 3)
        if name is None:
            cuts.append(m.span())
            continue
        name = name.lower()
        foreign = name in ("foreignobject", "desc", "title")
        if svg and name == "a" and (not slash or links):
            # A link within the svg; the end of one around it ends the svg too.
            links += -1 if slash else not m[0].endswith("/>")
        elif svg and name != "svg" and not foreign:
            # The svg was left open, and ends here.
            while inside and inside[-1][0] == "svg":
                start = inside.pop()[1]
                count["svg"] -= 1
            cuts.append((start, m.start()))
            at, links = m.start(), 0
        elif slash:
            while count[name]:
                top, start = inside.pop()
                count[top] -= 1
                if top == name:
                    if not foreign:
                        cuts.append((start, at))
                    break
        elif svg and m[0].endswith("/>"):
            pass
        elif name == "svg" and m[0].endswith("/>"):
            cuts.append(m.span())
        elif svg or not foreign:
            inside.append((name, m.start()))
            count[name] += 1
    # What is still open hides nothing. Cuts may lie in others.
    out, upto = [], 0
    for lo, hi in sorted(cuts):
        if lo >= upto:
            out.append(page[upto:lo])
        upto = max(upto, hi)
    return " ".join([*out, page[upto:]])


def _shown(page: str) -> str:
    """:func:`visible` for pages with any number of tags that nothing closes."""
    last = page.rfind(">") + 1
    # No tag ends behind the last ">", so only a comment can hide what stands there.
    tail = page[last:].partition("<!--")[0]
    t = visible(page[:last] + _END)
    return t[: -len(_END)] + tail if t.endswith(_END) else t


def _spaced(tag: re.Match) -> str:
    name = tag[1].lower()
    return "\n" if name in BLOCKS else " " if name in CELLS else ""


def plain_text(page: str) -> str:
    """Text of an HTML page: hidden elements dropped, blocks on lines of their own, entities decoded."""
    t = _shown(page.replace("\r", " ").replace("\n", " "))
    t = html.unescape(TAG.sub(_spaced, t)).replace("\r", " ")
    return "\n".join(line for line in (x.strip() for x in SPACES.sub(" ", t).split("\n")) if line)


def _unchunked(payload: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = int(payload[at : end if end >= 0 else None].split(b";")[0], 16)
        if end < 0 or size < 0:
            raise ValueError("chunk without end")
        if not size:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + size])
        if len(out[-1]) < size:
            raise ValueError("chunk cut off")
        at = end + 2 + size + 2


def decoded(payload: bytes, headers: dict[str, str]) -> bytes | None:
    """``payload`` without its transfer and content encodings; None if they cannot be undone."""
    try:
        if "chunked" in headers.get("transfer-encoding", "").lower():
            payload = _unchunked(payload)
        for name in reversed([x.strip().lower() for x in headers.get("content-encoding", "").split(",")]):
            if name in ("gzip", "x-gzip"):
                payload = b"".join(_gunzipped(payload))
            elif name == "deflate":
                payload = zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
            elif name not in ("", "identity"):
                return None
        return payload
    except (ValueError, zlib.error):
        return None


def _text(payload: bytes, kind: str) -> str:
    named = CHARSET.search(kind)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, ValueError, TypeError):
        return payload.decode("utf-8", "replace")


def _gunzipped(raw: bytes) -> Iterator[bytes]:
    """The members of gzip data, end to end."""
    while raw:
        d = zlib.decompressobj(31)
        yield d.decompress(raw) + d.flush()
        if not d.eof:
            raise zlib.error("gzip data cut off")
        raw = d.unused_data


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def derive(source: dict) -> list[dict]:
    """The metadata and conversion records of one response."""
    block = source["block"] or b""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        head, payload = b"", block
    lines = head.decode("utf-8", "replace").split(CRLF)
    http = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k]
    by_name = {k.lower(): v for k, v in reversed(http)}
    kind = by_name.get("content-type", "")
    plain = decoded(payload, by_name)
    readable = plain is not None and (not kind or bool(TEXT_TYPE.search(kind)))
    page = _text(plain, kind) if readable else ""
    is_html = "html" in kind.lower() if kind else "<html" in page[:1024].lower()
    text = plain_text(page) if is_html else page
    title, language = "", None
    if is_html:
        opened = TITLE.search(page)
        closed = TITLE_END.search(page, opened.end()) if opened else None
        title, language = page[opened.end() : closed.start()] if closed else "", LANGUAGE.search(page)
    payload_digest = source["payload_digest"] or digest(payload)
    # Without an id of its own, a response is named by where it is from and what it holds.
    name = source["record_id"] or f"{source['target_uri'] or ''} {digest(block)}"
    conversion = derived_id(name, "conversion")
    fields = [("status", lines[0])] if _clean(lines[0]) else []
    fields += [(f"source-header-{k.lower()}", v) for k, v in http]
    extra = [("title", html.unescape(title)), ("language", language[1].lower() if language else ""), ("links", str(len(LINK.findall(page)) if is_html else 0)), ("payload-length", str(len(payload)))]
    extra += [("text-chars", str(len(text))), ("conversion", conversion)] if readable else [("text", "none")]
    fields += [(k, v) for k, v in extra if _clean(v)]
    records = [("metadata", derived_id(name, "metadata"), "application/warc-fields", "".join(f"{k}: {_clean(v)}{CRLF}" for k, v in fields))]
    if readable:
        records.append(("conversion", conversion, "text/plain", text))
    out = []
    for what, record_id, mime, body in records:
        raw = body.encode("utf-8", "replace")
        headers = {"WARC-Type": what, "WARC-Record-ID": record_id, "WARC-Date": source["warc_date"] or NO_DATE}
        if source["record_id"] is not None:
            headers["WARC-Refers-To"] = source["record_id"]
        if source["target_uri"] is not None:
            headers |= {"WARC-Target-URI": _clean(source["target_uri"]), "WARC-Refers-To-Target-URI": _clean(source["target_uri"])}
        headers |= {"WARC-Refers-To-Date": source["warc_date"] or NO_DATE, "WARC-Source-Payload-Digest": payload_digest, "WARC-Block-Digest": digest(raw), "Content-Type": mime, "Content-Length": str(len(raw))}
        out.append({
            "warc_type": what, "record_id": record_id, "refers_to": source["record_id"], "target_uri": source["target_uri"], "warc_date": source["warc_date"] or NO_DATE,
            "content_type": mime, "content_length": len(raw), "block_digest": headers["WARC-Block-Digest"], "source_payload_digest": payload_digest, "headers": headers, "body": body,
        })
    return out


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", key_cols: Sequence[str] = ("page_id", "url"), date: str = NO_DATE) -> DataFrame:
    """``pages`` as response records: their columns (but the page) and ``record_id, target_uri, warc_date, block, payload_digest``."""
    page = F.coalesce(F.col(quoted([html_col])[0]).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in quoted(list(key_cols))], F.sha1(page)))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(page).cast("string"), F.lit(CRLF * 2))
    made = {
        "record_id": F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")), "target_uri": F.col(quoted([url_col])[0]).cast("string"),
        "warc_date": F.lit(date), "block": F.concat(http, page).cast("binary"), "payload_digest": F.lit(None).cast("string"),
    }
    rest = [c for c in pages.columns if c != html_col and c.lower() not in made]
    return pages.select(*quoted(rest), *[v.alias(k) for k, v in made.items()])


def build_derivatives(source: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """A metadata record, and for text a conversion record, for each response; ``carry`` names columns of ``source`` to keep."""
    ship(source.sparkSession)
    if "warc_type" in source.columns:
        source = source.where("warc_type IS NULL OR lower(warc_type) = 'response'")
    needed = ["record_id", "target_uri", "warc_date", "block", "payload_digest"]
    carry = [c for c in carry if c.lower() not in NAMES]
    df = source.select(*needed, *quoted(carry))
    made = T.StructType.fromDDL(OUT)
    schema = T.StructType([f for f in df.schema if f.name in carry] + list(made))
    kinds = [pa.map_(pa.string(), pa.string()) if f.name == "headers" else pa.int64() if f.name == "content_length" else pa.string() for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                made_of = [derive(row) for row in part.select(needed).to_pylist()]
                records = [r for rs in made_of for r in rs]
                owner = pa.array([k for k, rs in enumerate(made_of) for _ in rs], pa.int64())
                rest = [part.column(len(needed) + k).take(owner) for k in range(len(carry))]
                cols = [pa.array([list(r[n].items()) if n == "headers" else r[n] for r in records], t) for n, t in zip(NAMES, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*rest, *cols], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def record_text(headers: str = "headers", body: str = "body") -> Column:
    """A record as it stands in a file, without the two line ends after it."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit(VERSION + CRLF), F.array_join(lines, CRLF), F.lit(CRLF * 2), F.col(body))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one per task, into a folder that all executors share."""
    records.select(record_text().alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """``(headers, block, error)`` of each record of a file (gzip of the whole or of each record, or plain)."""
    broken = None
    if raw[:2] == b"\x1f\x8b":
        parts = []
        try:
            parts.extend(_gunzipped(raw))
        except zlib.error as e:
            # What came before the fault is read; members are taken one by one, so nothing of them is lost.
            parts, rest = [], raw
            while rest[:2] == b"\x1f\x8b":
                d = zlib.decompressobj(31)
                try:
                    parts.append(d.decompress(rest))
                except zlib.error:
                    break
                rest = d.unused_data
            broken = str(e)
        raw = b"".join(parts)
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        head = raw[at : end if end >= 0 else None]
        lines = head.decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}
        if end < 0:
            yield headers, b"", broken or "header without end"
            return
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "0")
        if not (length.isascii() and length.isdigit()):
            yield headers, b"", f"content length {length!r}"
            at = end + 4
            # The next record begins a line.
            following = raw.find(b"\r\nWARC/", end)
            at = following + 2 if following >= 0 else len(raw)
            continue
        block = raw[end + 4 : end + 4 + int(length)]
        yield headers, block, None if len(block) == int(length) else (broken or "block cut off")
        at = end + 4 + int(length)
    if broken and not raw:
        yield {}, b"", broken


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(headers, block, error)`` and the columns of a response for every record of WARC files."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, headers map<string,string>, block binary, error string"
    fields = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                for headers, block, error in parse_warc(content.as_py()):
                    by_name = {k.lower(): v for k, v in headers.items()}
                    cols = [pa.array([by_name.get(f)], pa.string()) for f in fields]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary()), pa.array([error], pa.string())], names)

    return files.mapInArrow(run, schema)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion record of every page."""
    pages = responses(read_table(spark, sf_dir, "pages"))
    return build_derivatives(pages, carry=["page_id"]).withColumn("headers", F.to_json("headers"))
