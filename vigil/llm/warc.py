"""WARC derivatives: linked metadata records and plain-text conversion records of response records.

A response has a record id, an address, a date, an HTTP header and a body. responses() makes them of crawled pages,
with ids that follow from page and address; read_responses() reads them from WARC files with the ids, headers, dates
and digests that stand there. derivatives() gives each response a metadata record (the source's HTTP header, title,
language and links as warc-fields) and a conversion record (the text of the page). Both refer to the response by its
record id and carry its address, date and payload digest; the digest is the source's own where it states one.

Markup is read forward once, tag by tag; whatever is never closed ends the reading, so hostile and very long pages
take linear time. Null html counts as an empty body and null addresses as none; null dates are written as the date of
the run's parameter. Repeated rows give equal records. Columns beside those named are not read, so their names may
clash. An empty table gives no records. One page is held at a time; no shuffle is needed.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is not text; elements that end a line.
HIDDEN = {"script", "style", "noscript", "template"}
BLOCKS = set("p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr td th table article section nav header footer main aside blockquote pre form title head body html".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_INSIDE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')|>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in [*HIDDEN, "title"]}
_SPACE, _LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r"\s*\n\s*")
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(map(str, parts)))}>"


def one_line(text: str) -> str:
    return " ".join(text.split())


def _tags(page: str) -> Iterator[tuple[str, int, int, str, bool]]:
    """("text" or "tag", begin, end, name, closing) from left to right. Comments and hidden elements are passed over;
    a tag, comment or hidden element that is never closed hides the rest."""
    at = 0
    while (start := page.find("<", at)) >= 0:
        following = page[start + 1 : start + 2]
        if not (following.isascii() and following.isalpha()) and following not in ("/", "!", "?"):
            yield "text", at, start + 1, "", False
            at = start + 1
            continue
        if at < start:
            yield "text", at, start, "", False
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return
            yield "tag", start, end + 3, "!--", False
            at = end + 3
            continue
        place = start + 1
        while (m := _INSIDE.search(page, place)) and m[0] != ">":
            place = m.end()
        if not m:
            yield "text", start, len(page), "", False  # no tag ends from here on
            return
        found = _NAME.match(page, start + 1)
        name, closing = (found[1].lower(), found[0][0] == "/") if found else ("", False)
        at = m.end()
        yield "tag", start, at, name, closing
        if name in HIDDEN and not closing:
            shut = _CLOSE[name].search(page, at)
            if not shut:
                return
            at = shut.end()
    if at < len(page):
        yield "text", at, len(page), "", False


def attributes(tag: str) -> dict[str, str]:
    """Attributes of one tag, in lower case; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, 1):
        out.setdefault(m[1].lower(), entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """Text, title, language and links of a page."""
    pieces, links, title, lang, opened = [], {}, None, None, None
    for kind, begin, end, name, closing in _tags(page):
        if kind == "text":
            pieces.append(page[begin:end])
            continue
        if name == "!--":
            pieces.append(" ")
        elif name in HIDDEN and not closing:
            pieces.append(" ")
        elif name in BLOCKS:
            pieces.append("\n")
        if name == "title" and not closing and opened is None:
            opened = len(pieces)
        elif name == "title" and closing and opened is not None and title is None:
            title = one_line(entities.unescape("".join(pieces[opened:])))
        elif name == "html" and not closing and lang is None:
            lang = attributes(page[begin:end]).get("lang")
        elif name in ("a", "area") and not closing and (href := one_line(attributes(page[begin:end]).get("href", ""))):
            links[href] = None
    text = _LINES.sub("\n", _SPACE.sub(" ", entities.unescape("".join(pieces)))).strip()
    return text, title, lang and lang.strip().lower(), list(links)


def plain_text(page: str) -> str:
    """Visible text; block elements end lines."""
    return read_page(page)[0]


def http_header(body: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()


def response(page_id: object, url: str | None, html: str | None, date: str) -> dict[str, object]:
    body = (html or "").encode()
    header = http_header(body)
    return {"record_id": record_id("response", page_id, url), "target_uri": url, "date": date, "http_header": header, "body": body, "payload_digest": digest(body), "block_digest": digest(header + body)}


def derive(source: dict[str, object]) -> list[dict[str, object]]:
    """The metadata and the conversion record of one response."""
    text, title, lang, links = read_page(bytes(source["body"] or b"").decode("utf-8", "replace"))
    lines = [f"http-{one_line(line)}" for line in bytes(source["http_header"] or b"").decode("latin-1").split("\r\n") if ":" in line]
    lines += [f"title: {title}"] if title is not None else []
    lines += [f"language: {one_line(lang)}"] if lang else []
    lines += [f"outlink: {x}" for x in links]
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in lines)), ("conversion", "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "replace")
        out.append({"record_type": kind, "record_id": record_id(kind, source["record_id"]), "refers_to": source["record_id"], "refers_to_target_uri": source["target_uri"], "refers_to_date": source["date"], "source_payload_digest": source["payload_digest"] or digest(bytes(source["body"] or b"")), "content_type": content, "content_length": len(raw), "block_digest": digest(raw), "block": raw.decode()})
    return out


def to_bytes(record: dict[str, object]) -> bytes:
    """A record as it stands in a WARC file."""
    head = [f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: {record['record_id']}", f"WARC-Date: {record['refers_to_date']}", f"WARC-Refers-To: {record['refers_to']}", f"WARC-Refers-To-Date: {record['refers_to_date']}"]
    if record["refers_to_target_uri"] is not None:
        uri = one_line(str(record["refers_to_target_uri"]))
        head += [f"WARC-Target-URI: {uri}", f"WARC-Refers-To-Target-URI: {uri}"]
    head += [f"WARC-Source-Payload-Digest: {record['source_payload_digest']}", f"WARC-Block-Digest: {record['block_digest']}", f"Content-Type: {record['content_type']}", f"Content-Length: {record['content_length']}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + str(record["block"]).encode() + b"\r\n\r\n"


def response_bytes(source: dict[str, object]) -> bytes:
    """A response record as it stands in a WARC file."""
    block = bytes(source["http_header"]) + bytes(source["body"])
    head = ["WARC-Type: response", f"WARC-Record-ID: {source['record_id']}", f"WARC-Date: {source['date']}"]
    head += [f"WARC-Target-URI: {one_line(str(source['target_uri']))}"] if source["target_uri"] is not None else []
    head += [f"WARC-Payload-Digest: {source['payload_digest']}", f"WARC-Block-Digest: {digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


_START = re.compile(rb"(?:^|(?<=\n))WARC/1\.")
_PIECE = 8 << 20
#: A gzip member of up to so many bytes is held until its checksum is seen to be right.
_CHECKED = 256 << 20


def _unpacked(data: bytes, tally: Counter) -> Iterator[bytes]:
    """The bytes of a WARC file in pieces; gzip members are unpacked one after another, and a broken one is passed over."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + _PIECE] for i in range(0, len(data), _PIECE))
        return
    at = 0
    while 0 <= at < len(data):
        member, rest, read, parts, size = zlib.decompressobj(31), b"", at, [], 0
        try:
            while not member.eof and (rest or read < len(data)):
                if not rest:
                    rest, read = data[read : read + _PIECE], read + _PIECE
                parts.append(member.decompress(rest, _PIECE))
                rest, size = member.unconsumed_tail, size + len(parts[-1])
                if size > _CHECKED:  # a whole crawl in one member passes before its checksum
                    yield from parts
                    parts.clear()
            if member.eof:
                yield from parts
            else:
                tally["skipped"] += 1
            at = min(read, len(data)) - len(member.unused_data)
            at = at if data[at : at + 2] == b"\x1f\x8b" else data.find(b"\x1f\x8b\x08", at)
        except zlib.error:
            tally["skipped"] += 1
            yield b"\r\n\r\n"
            at = data.find(b"\x1f\x8b\x08", at + 3)


def parse(data: bytes, tally: Counter | None = None) -> Iterator[dict[str, object]]:
    """Response records of the bytes of a WARC file, gzipped or not; no more is unpacked than a record and a piece.

    A record without a valid length, or whose length does not lead to the next record or the end, is passed over and
    counted in tally["skipped"], as is a broken gzip member; reading goes on at the next line that begins a record. Other
    records count in tally["records"].
    """
    tally = Counter() if tally is None else tally
    pieces, held, at = _unpacked(data, tally), bytearray(), 0

    def more(size: int) -> bool:
        """Reads until that many bytes are held; says whether they are."""
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        found = _START.search(held, at)
        if not found:
            last = max(at, len(held) - 8)  # a mark may be cut by the end of a piece
            del held[: max(last - 1, 0)]
            at = min(last, 1)
            if not more(len(held) + 1):
                return
            continue
        start = found.start()
        stop, seen = held.find(b"\r\n\r\n", start), len(held)
        while stop < 0 and more(seen + 1):
            stop, seen = held.find(b"\r\n\r\n", max(start, seen - 3)), len(held)
        head: dict[str, str] = {}
        for line in bytes(held[start : max(stop, start)]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                head.setdefault(name.strip().lower(), value.strip())
        size = head.get("content-length", "")
        end = stop + 4 + int(size) if size.isascii() and size.isdigit() and len(size) < 16 else -1
        if stop < 0 or end < 0 or not more(end) or (more(end + 11) or True) and not _follows(held[end : end + 11]):
            tally["skipped"] += 1
            at = start + 7
            continue
        tally["records"] += 1
        if head.get("warc-type", "").lower() == "response" and "warc-record-id" in head:
            block = bytes(held[stop + 4 : end])
            cut = block.find(b"\r\n\r\n")
            header, body = (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)
            yield {"record_id": head["warc-record-id"], "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "http_header": header, "body": body, "payload_digest": head.get("warc-payload-digest")}
        del held[:end]
        at = 0


def _follows(after: bytes | bytearray) -> bool:
    """Whether these bytes may stand behind a record: blank lines, then the next record or the end."""
    rest = bytes(after).lstrip(b"\r\n")
    return b"WARC/1."[: len(rest)] == rest[:7]


_SOURCE = {"record_id": pa.string(), "target_uri": pa.string(), "date": pa.string(), "http_header": pa.binary(), "body": pa.binary(), "payload_digest": pa.string()}
_FIELDS = {"record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "refers_to_target_uri": pa.string(), "refers_to_date": pa.string(), "source_payload_digest": pa.string(), "content_type": pa.string(), "content_length": pa.int64(), "block_digest": pa.string(), "block": pa.string()}
SOURCE = "record_id string, target_uri string, date string, http_header binary, body binary, payload_digest string"


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of crawled pages: page_id and the columns of SOURCE."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [response(i, u, h, date) for i, u, h in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *(pa.array([r[k] for r in made], kind) for k, kind in _SOURCE.items())], ["page_id", *_SOURCE])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(rows, f"page_id {kind}, {SOURCE}")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of the WARC files below a path. A file is read by one task, so it must fit one, as crawls do that
    write files of 1 GB; page_id is the record's number in its file."""

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                part: list[dict] = []
                number = 0
                for record in parse(content.as_py()):
                    part.append(record)
                    if len(part) == 64:
                        yield made(part, number)
                        number, part = number + len(part), []
                yield made(part, number)

    def made(part, number):
        return pa.RecordBatch.from_arrays([pa.array(range(number, number + len(part)), pa.int64()), *(pa.array([r[k] for r in part], kind) for k, kind in _SOURCE.items())], ["page_id", *_SOURCE])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, f"page_id long, {SOURCE}")


def reading_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_records, n_skipped) of the WARC files below a path: what parse() could not read is counted, not silent."""

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                tally: Counter = Counter()
                for _ in parse(content.as_py(), tally):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([tally["records"]], pa.int64()), pa.array([tally["skipped"]], pa.int64())], ["path", "n_records", "n_skipped"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, n_records long, n_skipped long")


def derivatives(sources: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Two records per row of responses() or read_responses(): page_id, the record's headers, its block, and the whole
    record as bytes. date stands for dates that the source does not give."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for page, *values in zip(*(part.column(c).to_pylist() for c in ("page_id", *_SOURCE))):
                    source = dict(zip(_SOURCE, values))
                    source["date"] = source["date"] or date
                    out += [(page, r) for r in derive(source)]
                columns = [pa.array([i for i, _ in out], part.schema.field("page_id").type), *(pa.array([r[k] for _, r in out], kind) for k, kind in _FIELDS.items()), pa.array([to_bytes(r) for _, r in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", *_FIELDS, "record"])

    kind = sources.schema["page_id"].dataType.simpleString()
    schema = ", ".join(f"{k} {'long' if k == 'content_length' else 'string'}" for k in _FIELDS)
    return sources.select("page_id", *_SOURCE).mapInArrow(rows, f"page_id {kind}, {schema}, record binary")
