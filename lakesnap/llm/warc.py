"""WARC derivatives: metadata and plain-text conversion records for response records.

A response record (WARC/1.1) gets two more: a `conversion` whose block is the page's text in UTF-8, and a `metadata`
record (application/warc-fields) with the source's headers and digests and the conversion's. Both carry
WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date of the response; the metadata names the conversion.
Bodies are taken out of chunks and compression first. Records are built and read a row at a time; a file is a run of
gzip members, one for each record, and is read as a stream. All work is linear in the page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesnap.llm.common import claim, small_batches
from lakesnap.operators.copying import filesystem

VERSION = b"WARC/1.1\r\n"
HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|(?P<title><title\b[^>]*>(?:(?:(?!</head\b|<body\b|<title\b).)*?</title\s*>|[^<]*))"  # one without an end ends at the next tag
    r"|<(?:meta|link|base)\b(?:=\s*\"[^\"<]*\"|=\s*'[^'<]*'|[^>])*?>",  # values may hold >
    re.S | re.I,
)
PICTURE = re.compile(r"<(/?)svg\b", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z][^>]*>|<[!?][^>]*>")
SPACES, LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")


#: Date of the records that stand for rows of pages, which have none, and of what is derived from them.
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 20  # bytes of a file that are read at a time


def settled(page: str) -> tuple[str, str]:
    """The page without what opens a tag after the last >, which nothing closes: each such < is a character that the
    page lacks, which is also given. A comment that is left open hides the rest. So no pattern looks for an end in vain."""
    cut = page.rfind(">") + 1
    tail = page[cut:]
    tail = tail[: k if (k := tail.find("<!--")) >= 0 else len(tail)]
    mark = next(c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in page) if "<" in tail else "<"
    return page[:cut] + tail.replace("<", mark), mark


def page_text(page: str) -> str:
    """Visible text: a line for each block element, entities resolved, white space collapsed. Of a head, whose end tag
    may be left out, what is never shown is taken out; anything else in it is text of the page."""

    page, mark = settled(page)
    pictures = list(PICTURE.finditer(page))
    starts = [m.start() for m in pictures]

    def cut(m: re.Match) -> str:
        k = bisect_left(starts, m.start()) - 1
        return m[0] if m["title"] and k >= 0 and not pictures[k][1] else " "  # the label of a picture stays

    shown = TAG.sub("", BREAK.sub("\n", HIDDEN.sub(cut, page).replace("\n", " "))).replace(mark, "<")
    return LINES.sub("\n", SPACES.sub(" ", entities.unescape(shown))).strip()


def page_title(page: str) -> str:
    page, mark = settled(page)
    m = TITLE.search(page)
    return " ".join(entities.unescape(TAG.sub("", m[1]).replace(mark, "<")).split()) if m else ""


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _clean(value: object) -> str:
    """A header value can't hold line ends."""
    return " ".join(str(value).split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {_clean(v)}\r\n".encode() for k, v in headers if v != ""] + [f"Content-Length: {len(block)}\r\n".encode()]
    return VERSION + b"".join(lines) + b"\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """Header values by name in lower case (of a name that is repeated, the first); `pairs` has all as they stand."""

    def __init__(self, lines: list[str]):
        self.pairs = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]
        super().__init__((k.lower(), v) for k, v in reversed(self.pairs))


def parsed(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of an uncompressed file."""
    return streamed([data])


def streamed(parts: Iterable[bytes]) -> Iterator[tuple[Headers, bytes]]:
    """parsed() of a file that comes in parts; no more than a record and a part are held."""
    parts, held, size = iter(parts), bytearray(), None

    def more() -> bool:
        part = next(parts, None)
        held.extend(part or b"")
        return part is not None

    at = 0  # bytes of held in which no end of headers begins
    while True:
        if held and not held.startswith(b"WARC/"[: len(held)]):
            raise ValueError("no WARC record where one should begin")
        end = held.find(b"\r\n\r\n", at)
        if end < 0:
            at = max(0, len(held) - 3)
            if more():
                continue
            if held:
                raise ValueError("a WARC record has no end of headers")
            return
        headers = Headers(bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:])
        size = int(headers["content-length"])
        while len(held) < end + 4 + size + 4 and more():
            pass
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]
        at = 0


def inflated(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a run of gzip members, or of a plain file, that comes in parts."""
    member, left, plain = None, b"", None
    for part in parts:
        left += part
        if plain is None and len(left) >= 2:
            plain = left[:2] != b"\x1f\x8b"
        if plain:
            yield left
            left = b""
        while left and not plain and plain is not None:
            member = member or zlib.decompressobj(31)
            if out := member.decompress(left, READ):
                yield out
            left = member.unused_data if member.eof else member.unconsumed_tail
            member = None if member.eof else member
            if member and not left:
                break
    if member:
        yield member.flush()
    elif left:
        yield left


def unchunked(body: bytes) -> bytes:
    """The body that a chunked one stands for; ValueError if it isn't one."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip() or b"-", 16)
        if not size:
            return b"".join(out)
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("not a chunk")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def plain_body(http: Headers, payload: bytes) -> bytes:
    """The payload without transfer and content codings (chunked, gzip, deflate); a body that isn't what its header
    says is left as it is, as crawlers store bodies that they have decoded."""
    try:
        if "chunked" in http.get("transfer-encoding", "").lower():
            payload = unchunked(payload)
    except ValueError:
        pass
    for coding in reversed(http.get("content-encoding", "").lower().replace(",", " ").split()):
        windows = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
        for bits in windows:
            try:
                payload = zlib.decompress(payload, bits)
                break
            except zlib.error:
                pass
    return payload


def response(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    """A response record for a page; null url and html count as empty."""
    payload = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", urn("response", page_id, url, digest(payload))), ("WARC-Target-URI", url or ""), ("WARC-Date", date),
         ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))], block,
    )


def derivatives(headers: Headers, block: bytes, date: str) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of the conversion and the metadata record, made at date, of a response (none for other types)."""
    if headers.get("warc-type") != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = Headers(lines)
    body = plain_body(http, payload)
    m = re.search(r"charset=[\"']?([\w.:-]+)", http.get("content-type", ""), re.I)
    try:
        page = body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = page_text(page).encode("utf-8", "replace")
    source, uri, captured = headers.get("warc-record-id", ""), headers.get("warc-target-uri", ""), headers.get("warc-date", "")
    own = headers.get("warc-payload-digest") or digest(payload)
    refers = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", captured)]
    conversion = urn("conversion", source, own)
    fields = [("source-status", status), *((f"source-{k.lower()}", v) for k, v in http.pairs), ("source-payload-digest", own), ("source-block-digest", headers.get("warc-block-digest", digest(block))),
              ("source-payload-length", len(payload)), ("conversion-record-id", conversion), ("conversion-block-digest", digest(text)), ("title", page_title(page))]
    about = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields).encode()
    return [
        ([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion), *refers, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text))], text),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", urn("metadata", source, own)), *refers, ("WARC-Concurrent-To", conversion), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(about))], about),
    ]


RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, record binary"


def derive(responses: DataFrame, date: str | None = None) -> DataFrame:
    """RECORD for the derivatives of each row (page_id, record), made at date (default: now): `record` is one
    uncompressed WARC record. Rows whose record is null, or not a response, have none."""
    small_batches(responses.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("warc")
        for pdf in batches:
            out = []
            for page, data in zip(pdf.page_id, pdf.record, strict=True):
                for headers, block in parsed(data) if data is not None else ():
                    for own, body in derivatives(headers, block, date):
                        h = dict(own)
                        payload = headers.get("warc-payload-digest") or digest(block.partition(b"\r\n\r\n")[2])
                        out.append((page, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h["Content-Type"], len(body), h["WARC-Block-Digest"], payload, record(own, body)))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
            if out:
                yield found.assign(page_id=found.page_id.astype("Int64"))

    return responses.select("page_id", "record").mapInPandas(rows, RECORD)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record: a response record for each row of pages."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("binary")
    def built(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, urls, bodies in batches:
            yield pd.Series([response(None if pd.isna(i) else int(i), u, b, date) for i, u, b in zip(ids, urls, bodies, strict=True)], dtype=object)

    return pages.select("page_id", built(pages["page_id"], pages["url"], pages["html"]).alias("record"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id (null), record of each record in the WARC files under path, gzipped or not, headers as they stand. A task
    reads a file as a stream; no more than a record is held."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def parts(name: str) -> Iterator[bytes]:
        fs, inner = filesystem(name)
        with fs.open_input_stream(inner, compression=None) as f:
            while data := f.read(READ):
                yield data

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("warc")
        for pdf in batches:
            for name in pdf.path:
                for headers, block in streamed(inflated(parts(name))):
                    again = record([(k, v) for k, v in headers.pairs if k.lower() != "content-length"], block)
                    yield pd.DataFrame({"page_id": pd.array([None], "Int64"), "record": [again]})

    n = max(1, spark.sparkContext.defaultParallelism)
    return files.repartition(n).mapInPandas(rows, "page_id long, record binary")


def gzipped(records: DataFrame) -> DataFrame:
    """`member`: each record as a gzip member; members laid end to end are a WARC file."""

    @F.pandas_udf("binary")
    def packed(record: pd.Series) -> pd.Series:
        return record.map(lambda x: gzip.compress(x, 6, mtime=0))

    return records.withColumn("member", packed("record"))


def warc_derivatives(pages: DataFrame) -> DataFrame:
    """The derivative records of a table of pages: RECORD, a conversion and a metadata row for each row of pages (also
    for null or empty html, whose text is empty; for repeated rows, which have the same ids). One pass, no shuffle; other
    columns are not read. An empty table gives no rows."""
    return derive(responses(pages), DATE)
