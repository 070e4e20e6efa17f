"""WARC derivatives: metadata and plain-text conversion records of response records (operator 6).

A response record becomes two linked records, as web archives publish them: a metadata record with what can be said
about the response without its text (HTTP status and headers, title, meta tags, links, digests) as JSON, and a
conversion record with its plain text. Both name the response in WARC-Refers-To and keep its target URI, date and
payload digest; their own record ids are derived from the response's id and the kind, so a repeated run, or a task
that runs twice, makes the same records.

`responses` makes response records of (url, html) rows; `parse` reads them back from WARC bytes, also gzipped, and
`serialize` writes any records as WARC bytes, a gzip member each. One row is worked at a time: nothing is collected.
Reading is linear in the length of a page or a file, whatever stands there.

Bodies are read as their headers say: chunks are joined, gzip and deflate undone, and text decoded by the character set
of the header, else of a meta tag, else as UTF-8. Digests and lengths are those of the body as recorded.

Defined results: a null html is an empty body; a null url becomes an empty target URI and is not resolved against;
equal rows give equal records, ids included; a record without a body gives a conversion record of length 0; a body whose
type is no text (text/*, HTML, XML, JSON, or none given) gives a metadata record only; what cannot be decoded is read
with replacement characters, and with encodings other than those two as it is; a repeated header field keeps all its
values, in order; elements whose end tag is missing end with the page if they are scripts, styles or titles, else only
their tags go; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs (RFC 4122)
DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, headers string, block binary, block_digest string, payload_digest string, length long"

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_RAW = re.compile(r"<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*+>|\Z)|<!\w[^>]*>|<\?[^>]*>", re.I | re.S)
_CODE = re.compile(r"(<(script|style)\b[^>]*>).*?(?:</\2\s*+>|\Z)", re.I | re.S)
#: Elements that go with all that is in them, if they end.
_WHOLE = ("noscript", "template", "svg", "head", "iframe")
_WHOLE_BEGIN, _WHOLE_END = (re.compile(rf"<{slash}({'|'.join(_WHOLE)})\b", re.I) for slash in ("", "/"))
_WHOLES = re.compile(rf"<({'|'.join(_WHOLE)})\b[^>]*>.*?</\1\s*+>", re.I | re.S)
_HEAD_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title\s*+>|\Z)", re.I | re.S)
_META = re.compile(r"<meta\b[^>]*>", re.I)
_LINK = re.compile(r"<(a|area|img|link|script|iframe|source|form)\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"(?<![-a-zA-Z:])([a-zA-Z][-a-zA-Z:]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_CHARSET = re.compile(rb"<meta\b[^>]{0,200}?charset\s*=\s*[\"']?([-\w]+)", re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I
)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
#: A quoted value with a > and without a < in it (with one, the quote may be broken markup). In a text, where it is no value, the entity that takes the place of > is resolved again.
_HELD = re.compile(r"=\s*+(?:\"[^\"<>]*+>[^\"<]*+\"|'[^'<>]*+>[^'<]*+')")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def closed_tags(page: str) -> str:
    """page without comments, without a < that no > follows and without a > in quoted values: so each pattern for a tag ends where the tag does, and reading is linear."""
    page = _HELD.sub(lambda m: m[0].replace(">", "&gt;"), _COMMENT.sub(" ", page))
    k = page.rfind(">") + 1
    return page[:k] + page[k:].replace("<", "&lt;")


def plain_text(page: str) -> str:
    """The text of a page: no scripts, styles, comments or head; block elements end lines; entities resolved once, after the tags."""
    page = _RAW.sub(" ", closed_tags(page))
    ends = {m[1].lower(): m.start() for m in _WHOLE_END.finditer(page)}  # the last of each element
    if any(m.start() > ends.get(m[1].lower(), -1) for m in _WHOLE_BEGIN.finditer(page)):  # beginnings without an end are tags like others
        page = _WHOLE_BEGIN.sub(lambda m: m[0] if m.start() < ends.get(m[1].lower(), -1) else "<x" + m[0][1:], page)
    text = _TAG.sub("", _BREAK.sub("\n", " ".join(_WHOLES.sub(" ", page).split())))
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(filter(None, lines))


def attributes(tag: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(tag)}


def about(page: str, base: str) -> dict:
    """Title, meta tags and links of a page; links as written and, where a base is known, resolved."""
    page = closed_tags(page)
    title = _HEAD_TITLE.search(page)
    metas = [attributes(m) for m in _META.findall(page)]
    links = []
    for m in _LINK.finditer(_CODE.sub(r"\1", page)):
        a = attributes(m.group())
        for key in ("href", "src", "action"):
            if url := a.get(key):
                links.append({"path": f"{m.group(1).upper()}@/{key}", "url": url} | ({"absolute": _join(base, url)} if base else {}))
    return {
        "Title": " ".join(entities.unescape(title.group(1)).split()) if title else None,
        "Metas": [{"name": m.get("name") or m.get("property") or m.get("http-equiv"), "content": m.get("content")} for m in metas if m.get("content") is not None],
        "Links": links,
    }


def _join(base: str, url: str) -> str | None:
    try:
        return urljoin(base, url)
    except ValueError:
        return None


def record(page_id, kind: str, uri: str, block: bytes, content_type: str, date: str, refers_to: str | None, name: str, payload: str, more: tuple = ()) -> tuple:
    own = digest(block)
    record_id = f"<urn:uuid:{uuid.uuid5(SPACE, kind + ' ' + name)}>"
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
        *([("WARC-Refers-To", refers_to)] if refers_to else []), ("WARC-Block-Digest", own),
        *([("WARC-Payload-Digest", payload)] if payload else []), *more, ("Content-Type", content_type), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines)
    return page_id, kind, record_id, refers_to, uri, head, block, own, payload, len(block)


def _one_line(value: str) -> str:
    return value if value.isprintable() else re.sub(r"[\r\n\0]+", " ", value)


def response(page_id, url: str | None, body: str | None, date: str = DATE) -> tuple:
    """A response record of a page as fetched: a plain HTTP header, then the body."""
    body, uri = (body or "").encode("utf-8", "replace"), url or ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return record(page_id, "response", uri, head + body, "application/http; msgtype=response", date, None, f"{page_id} {uri}", digest(body))


def fields(lines: list[str]) -> list[list[str]]:
    """Names and values of header lines, in order; a line that begins with a blank goes on with the value before it."""
    out: list[list[str]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if out and line[:1] in (" ", "\t"):
            out[-1][1] = f"{out[-1][1]} {line.strip()}".strip()
        elif colon and name.strip():
            out.append([name.strip(), value.strip()])
    return out


def first(found: list[list[str]], name: str) -> str | None:
    return next((v for k, v in found if k.lower() == name.lower()), None)


def http_parts(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers in order, body; a block that doesn't start like HTTP is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, fields(lines), body


def unchunked(body: bytes) -> bytes:
    """The chunks of a body one after another; a body that isn't chunked, as archives often store it, as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at, at + 1024)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out and at >= len(body) else body


def content(http: list[list[str]], body: bytes) -> bytes:
    """A body without its transfer and content encodings, as far as they are known."""
    if "chunked" in (first(http, "Transfer-Encoding") or "").lower():
        body = unchunked(body)
    for name in reversed((first(http, "Content-Encoding") or "").lower().split(",")):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name.strip(), ()):
            z = zlib.decompressobj(bits)
            try:
                body = z.decompress(body)
                break
            except zlib.error:
                continue
    return body


def as_text(http: list[list[str]], body: bytes) -> str | None:
    """A body as text by the character set it names; None if its type is no text."""
    kind, _, more = (first(http, "Content-Type") or "").lower().partition(";")
    if kind.strip() and not re.fullmatch(r"\s*(text/.*|.*[/+](html|xml|json)|.*/(xhtml\+xml|javascript))\s*", kind):
        return None
    named = re.search(r"charset\s*=\s*[\"']?([-\w]+)", more)
    name = named[1] if named else m[1].decode() if (m := _CHARSET.search(body[:4096])) else "utf-8"
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derived(page_id, record_id: str, uri: str, headers: str, block: bytes, payload: str | None) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    own = fields(headers.split("\r\n")[1:])
    status, http, body = http_parts(block)
    page, date = as_text(http, content(http, body)), first(own, "WARC-Date") or DATE
    payload = payload or digest(body)
    said = {
        "Container": {"Response-Record-ID": record_id, "Block-Digest": first(own, "WARC-Block-Digest") or digest(block), "Payload-Digest": payload, "Actual-Content-Length": len(block)},
        "WARC-Header": own,
        "HTTP-Response": {"Status-Line": status, "Headers": http, "Entity-Length": len(body), "Entity-Digest": digest(body)},
        "HTML": None if page is None else about(page, uri),
    }
    made = [record(page_id, "metadata", uri, json.dumps(said, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"), "application/json", date, record_id, record_id, payload)]
    if page is not None:
        kind = (first(http, "Content-Type") or "text/html").lower()
        text = plain_text(page) if re.search(r"html|xml", kind) else page
        made.append(record(page_id, "conversion", uri, text.encode("utf-8", "replace"), "text/plain", date, record_id, record_id, payload))
    return made


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), *((k, pa.string()) for k in ("record_type", "record_id", "refers_to", "target_uri", "headers")), ("block", pa.binary()),
     ("block_digest", pa.string()), ("payload_digest", pa.string()), ("length", pa.int64())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)


def _mapped(df: DataFrame, work, rows: int = 256, size: int = 8 << 20) -> DataFrame:
    """Rows of records from each row, given out a few at a time, however many and long they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                for row in batch.slice(at, 32).to_pylist():
                    for r in work(row):
                        made.append(r)
                        held += len(r[6])
                        if len(made) >= rows or held > size:
                            yield _batch(made)
                            made, held = [], 0
        yield _batch(made)

    return df.mapInArrow(run, RECORD)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return _mapped(pages, lambda r: [response(r["page_id"], r["url"], r["html"])])


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records among records."""
    records = records.where("record_type = 'response'").select("page_id", "record_id", "target_uri", "headers", "block", "payload_digest")
    return _mapped(records, lambda r: derived(*r.values()))


def serialize(records: DataFrame, gzipped: bool = True) -> DataFrame:
    """records with `warc`: each as WARC bytes, by default a gzip member of its own; concatenated in any order they are a WARC file."""

    @F.udf("binary")
    def pack(headers: str, block: bytes) -> bytes:
        raw = headers.encode("utf-8", "replace") + b"\r\n" + bytes(block) + b"\r\n\r\n"
        if not gzipped:
            return raw
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()

    return records.withColumn("warc", pack("headers", "block"))


def members(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in pieces, each gzip member decompressed; what follows the last member comes as it is."""
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            part = view[at : at + piece]
            try:
                out = z.decompress(part, piece)
                while z.unconsumed_tail:
                    yield out
                    out = z.decompress(z.unconsumed_tail, piece)
            except zlib.error:  # the file is broken from here on
                return
            yield out
            at += len(part) - len(z.unused_data)
    for k in range(at, len(data), piece):
        yield data[k : k + piece]


def parse_bytes(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file's bytes, gzipped or not, one at a time. A record cut short by the file's end is left out."""
    held, seen, need = bytearray(), 0, 0
    for piece in members(data):
        held += piece
        if len(held) < need:
            continue
        at = 0
        while (start := held.find(b"WARC/", at)) >= 0 and (end := held.find(b"\r\n\r\n", max(start, at + seen))) >= 0:
            head, seen = held[start : end + 2].decode("utf-8", "replace"), 0
            own = {k.lower(): v for k, v in reversed(fields(head.split("\r\n")[1:]))}  # of repeated fields the first
            n = int(own.get("content-length", "0")) if own.get("content-length", "0").isdigit() else 0
            need = end + 4 + n - start
            if len(held) < start + need:
                at = start
                break
            yield (None, own.get("warc-type"), own.get("warc-record-id"), own.get("warc-refers-to"), own.get("warc-target-uri"), head, bytes(held[end + 4 : end + 4 + n]),
                   own.get("warc-block-digest"), own.get("warc-payload-digest"), n)
            at, need = end + 4 + n, 0
        else:
            at = max(at, start) if start >= 0 else max(at, len(held) - 4)
            seen = max(0, len(held) - at - 3)  # no end of a head before that
        del held[:at]


def parse(files: DataFrame) -> DataFrame:
    """Records of WARC files: rows with their bytes in `content`, as spark.read.format("binaryFile") gives them, one file at a time."""
    return _mapped(files.select("content"), lambda r: parse_bytes(r["content"] or b""), rows=64)


def query(spark, sf_dir: str) -> DataFrame:
    """The derived records of all pages; of their blocks length and digests."""
    found = derivatives(responses(table(spark, sf_dir, "pages")))
    return found.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", "length", F.sha2("headers", 256).alias("headers_sha256"))


SQL = None
