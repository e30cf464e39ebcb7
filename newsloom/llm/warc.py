"""WARC derivatives: metadata and plain-text conversion records for responses.

A response record's block is an HTTP message. Its two derivatives point back to it
(WARC-Refers-To), keep its target, date and headers, and carry digests of their own
and of the source, so that each can be checked without the others. Records are
written as gzip members; a file is a Parquet container of members in order, and the
members joined are a valid .warc.gz. ``from_files`` reads such files.

Pages are hostile input: every scan goes forward once, so time is linear in the page.
"""

from __future__ import annotations

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

from newsloom.llm.common import scratch_path

CRLF = b"\r\n"
LEVEL = 1  # of gzip: within 6 % of the size of 6 in half its time
_ABSOLUTE = re.compile(r"https?://[^#?]*/[^#]*$")
#: a path from the root that joining would not alter: no dot segment, query, fragment or blank
_ROOTED = re.compile(r"/(?![/.])(?!.*/\.)[^\x00-\x20?#;]*\Z")
_NAMESPACE = uuid.NAMESPACE_URL.bytes
RECORD = "page_id bigint, kind string, record_id string, refers_to string, member binary"
_OPEN = re.compile(r"<!--|<(script|style|noscript|template|svg)\b", re.I)
_CLOSE = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "title")}
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b", re.I)
_HOLDER = re.compile(r"<(a|img|link|script|iframe|meta)(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>=]++|=)(?:\s*+=\s*+(?:(["'])|([^\s>]*+)))?+)""")
#: a number no character has, or one too long to be read as a number
_HUGE = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{7,}+|0*+[0-9]{8,}+);?")
_TEXT = re.compile(r"\s*(?:text/|application/(?:xhtml\+xml|xml|json|ld\+json|rss\+xml|atom\+xml)\b|\Z)", re.I)
_MARKUP = re.compile(r"\s*(?:text/html|text/xml|application/(?:xhtml\+xml|xml|rss\+xml|atom\+xml)|\Z)", re.I)
MOST_BODY = 1 << 28  # bytes that a compressed body may unpack to; beyond, no text is drawn from it


_PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def digest(data: bytes) -> str:
    """SHA-1 in base 32, two letters for every ten bits."""
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([_PAIRS[n >> s & 1023] for s in range(150, -1, -10)])


def plain_text(html: str) -> str:
    """Visible text: comments, scripts and styles go, block tags end lines, other tags
    vanish, entities are decoded, white space inside a line is one blank, empty lines go."""
    return _visible(_bare(html))


def _bare(html: str) -> str:
    """The page without comments and elements whose text is not shown. What is opened
    and never closed counts as a plain tag; that nothing closes it is found out once."""
    parts, at, look, unclosed = [], 0, 0, set()
    while m := _OPEN.search(html, look):
        kind = (m[1] or "").lower()
        look = m.end()
        if kind in unclosed:
            continue
        if not kind:
            end = html.find("-->", look)
            end += 3 if end >= 0 else 0
        else:
            opened = html.find(">", look)
            if opened < 0:
                break
            close = _CLOSE[kind].search(html, opened + 1)
            end = close.end() if close else -1
        if end < 0:
            unclosed.add(kind)
            continue
        parts.append(html[at : m.start()])
        at = look = end
    return " ".join([*parts, html[at:]]) if parts else html


def _title(html: str) -> str | None:
    m = _TITLE.search(html)
    opened = html.find(">", m.end()) if m else -1
    close = _CLOSE["title"].search(html, opened + 1) if opened >= 0 else None
    return html[opened + 1 : close.start()] if close else None


def tags(html: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(name, attributes) of the tags that hold links or metadata. One pass: a tag ends
    at the first > outside quotes; a page that ends inside a tag ends the scan; the
    first of repeated attributes counts."""
    at = 0
    while m := _HOLDER.search(html, at):
        own: dict[str, str] = {}
        at = m.end()
        while x := _ATTRIBUTE.match(html, at):
            at = x.end()
            if x[1]:
                yield m[1].lower(), own
                break
            value = x[4] or ""
            if x[3]:
                end = html.find(x[3], at)
                if end < 0:
                    return
                value, at = html[at:end], end + 1
            own.setdefault(x[2].lower(), value)
        else:
            return


def _unescape(text: str) -> str:
    if "&" not in text:
        return text
    return entities.unescape(_HUGE.sub("\ufffd", text) if "&#" in text else text)


def _visible(html: str) -> str:
    end = html.rfind(">") + 1  # no tag ends beyond, so the patterns need not look there
    text = _TAG.sub("", _BLOCK.sub("\n", html[:end])) + html[end:] if end else html
    return _lines(_unescape(text))


def _lines(text: str) -> str:
    return "\n".join([" ".join(words) for x in text.split("\n") if (words := x.split())])


def pack(data: bytes) -> bytes:
    """One gzip member; window and tables no larger than the data can use."""
    bits = min(15, max(9, len(data).bit_length()))
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 16 + bits, min(8, max(1, bits - 6)))
    return c.compress(data) + c.flush()


def unpack(member: bytes) -> bytes:
    """The data of one gzip member, its length and checksum verified."""
    return zlib.decompress(member, 31, 4 * len(member))


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in headers)
    return head + f"Content-Length: {len(block)}".encode() + CRLF + CRLF + block + CRLF + CRLF


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers in order, block); raises where the record is not whole."""
    at = record.find(CRLF + CRLF)
    lines = record[: max(at, 0)].decode().split("\r\n")
    if at < 0 or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers, n = [], None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:  # a folded header line
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
        else:
            k, _, v = line.partition(":")
            headers.append((k.strip(), v.strip()))
    for k, v in headers:
        if k.lower() == "content-length":
            n = int(v)
    if n is None:
        raise ValueError("no block length")
    if not record.startswith(CRLF + CRLF, at + 4 + n):
        raise ValueError("block length does not match")
    return headers, record[at + 4 : at + 4 + n]


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of a response block."""
    head, _, body = block.partition(CRLF + CRLF)
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def _header(headers: list[tuple[str, str]], name: str) -> str:
    return next((v for k, v in headers if k.lower() == name), "")


def _charset(headers: list[tuple[str, str]]) -> str:
    m = re.search(r"charset=[\"']?([\w.:-]+)", _header(headers, "content-type"), re.I)
    return m[1] if m else "utf-8"


def _joined_chunks(body: bytes) -> bytes:
    """The body without its chunked transfer coding; as it is if that is not whole."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at, at + 1024)
        if end < 0:
            return body
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if n < 0 or at + n > len(body):
            return body
        parts.append(body[at : at + n])
        at += n + 2


def content(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, bytes | None]:
    """(the payload without transfer coding, its content without content coding). No
    content where the coding is unknown, broken or unpacks to more than MOST_BODY."""
    payload = _joined_chunks(body) if "chunked" in _header(headers, "transfer-encoding").lower() else body
    data = payload
    for coding in reversed([x.strip().lower() for x in _header(headers, "content-encoding").split(",")]):
        if coding in ("", "identity"):
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            return payload, None
        try:
            # deflate comes with and without the zlib header
            window = 47 if coding != "deflate" or data[:1] and data[0] & 15 == 8 else -15
            d = zlib.decompressobj(window)
            data = d.decompress(data, MOST_BODY)
            if not d.eof and d.unconsumed_tail:
                return payload, None
        except zlib.error:
            return payload, None
    return payload, data


def _decode(body: bytes, charset: str) -> str:
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _record_id(*parts: str) -> str:
    """A version 5 UUID of the parts, in the namespace of addresses."""
    h = hashlib.sha1(_NAMESPACE + "\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{int(h[16], 16) & 3 | 8:x}{h[17:20]}-{h[20:32]}>"


def response(uri: str, html: str, date: str, key: str) -> bytes:
    """A response record for a page kept as bare HTML; its id follows from its key."""
    body = html.encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + f"Content-Length: {len(body)}".encode() + CRLF + CRLF + body
    clean, payload = re.sub(r"[\r\n]+", " ", uri), digest(body)
    return serialize(
        [("WARC-Type", "response"), ("WARC-Record-ID", _record_id("response", key, clean, payload)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")],
        block,
    )


def derive(record: bytes) -> list[tuple[str, bytes]]:
    """The metadata record of a response record and, if its content is text, the
    conversion record.

    Transfer and content codings are undone first. The metadata keep every source
    header, repeated ones too, in order. Digests of the source are checked where given
    (a payload digest may be of the body before or after transfer coding); a source
    that fails them, or is no response, raises.
    """
    return [(kind, data) for kind, _, _, data in _derive(*parse(record))]


def _derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[str, str, str, bytes]]:
    """(kind, record id, source id, record) of the derivatives."""
    own = {k.lower(): v for k, v in reversed(headers)}
    if own.get("warc-type") != "response":
        raise ValueError("not a response record")
    status, http, body = split_http(block)
    coded, data = content(http, body)
    given = own.get("warc-block-digest", "")
    if given.startswith("sha1:") and given != digest(block):
        raise ValueError("warc-block-digest does not match")
    payload = own.get("warc-payload-digest", "")
    if payload.startswith("sha1:") and payload != digest(body) and (coded is body or payload != digest(coded)):
        raise ValueError("warc-payload-digest does not match")
    source = own["warc-record-id"]
    payload = payload or digest(coded)
    kind = _header(http, "content-type")
    readable = data is not None and _TEXT.match(kind) is not None
    markup = readable and _MARKUP.match(kind) is not None
    page = _decode(data, _charset(http)) if readable else ""
    facts = {"source": [list(x) for x in headers], "http": {"status": status, "headers": [list(x) for x in http]}}
    bare = page
    if markup:
        title, bare = _title(page), _bare(page)
        base = own.get("warc-target-uri", "")
        root = urljoin_safe(base, "/")[:-1]
        links = []
        for tag, x in tags(bare):
            u = _unescape(x["href"] if "href" in x else x.get("src", "")) if tag != "meta" and ("href" in x or "src" in x) else None
            if u is not None:
                links.append({"tag": tag, "url": root + u if _ROOTED.match(u) else urljoin_safe(base, u)})
        meta = [[x["name"].lower(), _unescape(x["content"])] for tag, x in (tags(page) if "<meta" in page or "<META" in page or "<Meta" in page else ()) if tag == "meta" and "name" in x and "content" in x]
        facts["html"] = {"title": plain_text(title) if title is not None else None, "meta": meta, "links": links}
    derived = [("metadata", "application/json", json.dumps(facts, ensure_ascii=True, sort_keys=True).encode())]
    if readable:
        derived.append(("conversion", "text/plain", (_visible(bare) if markup else _lines(page)).encode("utf-8", "replace")))
    out = []
    for kind, mime, block in derived:
        check = digest(block)
        name = _record_id(kind, source, check)
        out.append((kind, name, source, serialize(
            [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Date", own.get("warc-date", "")), ("WARC-Target-URI", own.get("warc-target-uri", "")), ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", check), ("Content-Type", mime)],
            block,
        )))
    return out


def urljoin_safe(base: str, url: str) -> str:
    if _ABSOLUTE.match(url):
        return url
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def records(data: bytes) -> Iterator[bytes]:
    """The records of a .warc or .warc.gz file, one at a time."""
    buffer, at = bytearray(), 0
    if data[:2] != b"\x1f\x8b":
        yield from _cut(bytearray(data))
        return
    view = memoryview(data)
    while at < len(data):
        d = zlib.decompressobj(31)
        for start in range(at, len(data), 1 << 20):
            buffer += d.decompress(view[start : start + (1 << 20)])
            if d.eof:
                at = min(start + (1 << 20), len(data)) - len(d.unused_data)
                break
        else:
            raise ValueError("the file ends inside a gzip member")
        yield from _cut(buffer)  # takes the whole records, leaves a rest
    if bytes(buffer).strip():
        raise ValueError("the file ends inside a record")


def _cut(buffer: bytearray) -> Iterator[bytes]:
    at = 0
    while True:
        head = buffer.find(CRLF + CRLF, at)
        if head < 0:
            break
        n = re.search(rb"\r\ncontent-length\s*:\s*(\d+)", buffer[at : head + 2], re.I)
        if n is None:
            raise ValueError("no block length")
        end = head + 4 + int(n[1]) + 4
        if end > len(buffer):
            break
        yield bytes(buffer[at:end])
        at = end
    del buffer[:at]


def from_files(spark, path: str) -> DataFrame:
    """(page_id, record) of the response records of .warc and .warc.gz files, through
    Spark's reader; page_id is null. A file is one task's work and is held whole, as
    gzip members cannot be found without reading from the start: files of up to 2 GB,
    the reader's limit, spread over many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for record in records(data.as_py()):
                    if re.search(rb"\r\nwarc-type\s*:\s*response\r\n", record[:65536], re.I):
                        rows.append(record)
                        size += len(record)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["page_id", "record"])
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["page_id", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id bigint, record binary")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (page_id, record) for a table of page_id, url, html; null url
    and html are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [record for _, record in _responses(batch, date)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), pa.array(out, pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, record binary")


def _responses(batch: pa.RecordBatch, date: str) -> Iterator[tuple[int | None, bytes]]:
    for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
        yield page_id, response(url or "", html or "", date, str(page_id))


def derivatives(source: DataFrame) -> DataFrame:
    """For each response (page_id, record) its own, its metadata and its conversion
    record as gzip members: page_id, kind, record_id, refers_to, member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _members(zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist()))

    return source.select("page_id", "record").mapInArrow(run, RECORD)


def page_derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``derivatives(responses(pages))`` in one pass: whole records do not travel
    between the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _members(_responses(batch, date))

    return pages.select("page_id", "url", "html").mapInArrow(run, RECORD)


def _members(records: Iterator[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    rows, size = [], 0
    for page_id, record in records:
        headers, block = parse(record)
        source = next(v for k, v in headers if k.lower() == "warc-record-id")
        for kind, name, refers_to, data in [("response", source, None, record), *_derive(headers, block)]:
            rows.append((page_id, kind, name, refers_to, pack(data)))
            size += len(rows[-1][-1])
        if size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def write(records: DataFrame, path: str) -> None:
    records.write.option("compression", "uncompressed").parquet(path)


def read(spark, path: str, blocks: tuple[str, ...] = ("response", "metadata", "conversion")) -> DataFrame:
    """Records read back and checked: page_id, kind, ids, target, digests, and the block
    of the kinds named."""
    schema = "page_id bigint, kind string, record_id string, refers_to string, target_uri string, date string, source_digest string, block_digest string, valid boolean, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 7, pa.bool_(), pa.binary()]
        for batch in batches:
            rows = []
            for page_id, member in zip(batch.column("page_id").to_pylist(), batch.column("member").to_pylist()):
                headers, block = parse(unpack(member))
                own = dict(headers)
                source = own.get("WARC-Source-Payload-Digest") or own.get("WARC-Payload-Digest")
                rows.append((page_id, own["WARC-Type"], own["WARC-Record-ID"], own.get("WARC-Refers-To"), own["WARC-Target-URI"], own["WARC-Date"], source, own["WARC-Block-Digest"], own["WARC-Block-Digest"] == digest(block), block if own["WARC-Type"] in blocks else None))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return spark.read.parquet(path).select("page_id", "member").mapInArrow(run, schema)


def build(pages: DataFrame) -> DataFrame:
    """One row per page row, from the written and reread records: page_id, the ids of
    its three records, target, digests, text size and digest, title and link counts.

    Null url and html are empty (their records have empty blocks); repeated rows give
    a row each; null page_ids are kept; other columns are ignored; no rows, no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(page_derivatives(pages), path)
    own = read(spark, path, ("metadata", "conversion"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    lean = own.withColumn("text", F.when(F.col("kind") == "conversion", F.decode("block", "UTF-8"))).withColumn("facts", F.when(F.col("kind") == "metadata", F.decode("block", "UTF-8")))
    lean = lean.select("page_id", "kind", "record_id", F.coalesce("refers_to", "record_id").alias("source_id"), "target_uri", "source_digest", "block_digest", "valid", F.char_length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("text_sha256"), F.get_json_object("facts", "$.html.title").alias("title"), F.size(F.from_json(F.get_json_object("facts", "$.html.links"), "array<string>")).alias("links"))
    # a page row that repeats has the same ids; its records come as often
    out = lean.groupBy("page_id", "source_id", "target_uri", "source_digest").agg(
        pick("metadata", "record_id").alias("metadata_id"), pick("conversion", "record_id").alias("conversion_id"), pick("conversion", "block_digest").alias("text_digest"),
        F.min("valid").alias("valid"), pick("conversion", "chars").alias("text_chars"), pick("conversion", "text_sha256").alias("text_sha256"), pick("metadata", "title").alias("title"), pick("metadata", "links").cast("int").alias("links"), F.count(F.when(F.col("kind") == "response", 1)).alias("_n"),
    )
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
