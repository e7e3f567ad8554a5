r"""WARC derivative builder.

From each response record two records are derived: a `metadata` record that
links back to it (WARC-Refers-To) and keeps the source's status, headers and
digests beside the title, language and outlinks found in the page, and a
`conversion` record with the page as plain text.  Record ids are name-based, so
a rerun, or a task that is tried again, derives the very same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from .common import with_fields
from .shingles import batches_of

#: Fixed values of the format (WARC 1.1).
VERSION, CRLF = "WARC/1.1", "\r\n"
FIELDS_TYPE, TEXT_TYPE, HTTP_TYPE = "application/warc-fields", "text/plain; charset=utf-8", "application/http; msgtype=response"

_NAMESPACE = uuid.UUID("6f0d7a5e-52f1-5a2e-9a3c-3c1b9f1f4f60")

_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|svg|head)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "head")}
_BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK, _HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(block: bytes) -> str:
    """Labelled SHA-1 in base 32, as crawlers write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(parts))}>"


def shown(page: str) -> str:
    """The page without comments and elements that are not shown; what an
    unclosed comment, script or style hides reaches to the end.

    Every search goes on where the last one ended, and an end that was not found
    once is not looked for again, so hostile pages take linear time too.
    """
    out, kept, at, missing = [], 0, 0, set()
    while opened := _HIDDEN.search(page, at):
        name = (opened[1] or "").lower()
        at = opened.end()
        if name in missing:
            continue
        if not name:
            end = page.find("-->", at) + 3
            found = end > 2
        else:
            closed = _ENDS[name].search(page, at)
            found, end = closed is not None, closed.end() if closed else 0
        if found:
            out.append(page[kept : opened.start()])
            kept = at = end
        elif name in ("", "script", "style"):
            out.append(page[kept : opened.start()])
            kept = len(page)
            break
        else:
            missing.add(name)
    return " ".join([*out, page[kept:]])


def _without_tags(page: str, breaks: bool = False) -> str:
    """Behind the last `>` no tag can end, so none is looked for there."""
    last = page.rfind(">") + 1
    head = page[:last]
    return _TAG.sub("", _BREAKS.sub("\n", head) if breaks else head) + page[last:]


def _tag(page: str, opener: re.Pattern, at: int = 0) -> tuple[str, int] | None:
    """(attributes, end) of the next tag of a kind, from `at` on."""
    found = opener.search(page, at)
    end = page.find(">", found.end()) if found else -1
    return (page[found.end() : end], end) if end >= 0 else None


def plain_text(page: str) -> str:
    """The visible text: a line for each block, blanks made one, entities read."""
    text = html.unescape(_without_tags(shown(page).replace("\n", " "), breaks=True))
    lines = (_BLANKS.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str | None:
    opened = _tag(page, _TITLE)
    closed = _TITLE_END.search(page, opened[1]) if opened else None
    return " ".join(html.unescape(_without_tags(page[opened[1] + 1 : closed.start()])).split()) if closed else None


def language_of(page: str) -> str | None:
    opened = _tag(page, _HTML)
    found = _LANG.search(opened[0]) if opened else None
    return found[1] if found else None


def links_of(page: str) -> Iterator[str]:
    """The targets of links in what is shown, in order."""
    page, at = shown(page), 0
    while opened := _tag(page, _LINK, at):
        at = opened[1]
        found = _HREF.search(opened[0])
        if found:
            yield html.unescape(next(g for g in found.groups() if g is not None)).strip()


@dataclass
class Record:
    """A record: named fields in their order, and its block."""

    fields: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def __getitem__(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)

    def header(self) -> str:
        return CRLF.join([VERSION, *(f"{k}: {v}" for k, v in self.fields)]) + CRLF

    def encode(self) -> bytes:
        return self.header().encode() + CRLF.encode() + self.block + 2 * CRLF.encode()


def members(data: bytes) -> Iterator[bytes]:
    """The data of a file, a gzip member at a time if it is compressed."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        yield member.decompress(data)
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data
    if data.strip(b"\0\r\n"):
        yield data


def read_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, compressed by records or not at all."""
    for part in members(data):
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            lines = part[at : end if end >= 0 else len(part)].decode("utf-8", "replace").split(CRLF)
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at}")
            named = (line.partition(":") for line in lines[1:])
            out = Record([(k.strip(), v.strip()) for k, _, v in named])
            size = int(out["Content-Length"])
            out.block = part[end + 4 : end + 4 + size]
            if len(out.block) < size:
                raise ValueError(f"the record at byte {at} is cut short")
            at = end + 4 + size
            while part[at : at + 2] == b"\r\n":
                at += 2
            yield out


def _record(kind: str, ident: str, uri: str | None, date: str, mime: str, block: bytes, more: list[tuple[str, str | None]]) -> Record:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Target-URI", uri), ("WARC-Date", date), *more,
        ("WARC-Block-Digest", digest(block)), ("Content-Type", mime), ("Content-Length", str(len(block))),
    ]
    return Record([(k, " ".join(v.split())) for k, v in fields if v is not None], block)


def response(uri: str | None, page: str | None, date: str, headers: list[tuple[str, str]] | None = None, status: str = "HTTP/1.1 200 OK") -> Record:
    """A response record around a page; null pages are empty."""
    body = (page or "").encode()
    named = headers if headers is not None else [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = CRLF.join([status, *(f"{k}: {v}" for k, v in named)]) + 2 * CRLF
    payload = digest(body)
    return _record("response", record_id("response", uri or "", date, payload), uri, date, HTTP_TYPE, head.encode() + body, [("WARC-Payload-Digest", payload)])


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split(CRLF)
    return lines[0], [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]], body


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response."""
    status, headers, body = http_parts(source.block)
    mime = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = re.search(r"charset=\"?([\w-]+)", mime, re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    title, lang, links = title_of(page), language_of(page), links_of(page)
    payload = source["WARC-Payload-Digest"] or digest(body)
    facts = [
        ("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers),
        ("source-block-digest", source["WARC-Block-Digest"] or digest(source.block)), ("source-payload-digest", payload),
        *([("title", title)] if title is not None else []), *([("language", lang)] if lang else []), *(("outlink", x) for x in links),
    ]
    of, uri, date = source["WARC-Record-ID"], source["WARC-Target-URI"], source["WARC-Date"]
    fields = CRLF.join(f"{k}: {' '.join(v.split())}" for k, v in facts) + CRLF
    common = [("WARC-Refers-To", of)]
    meta = _record("metadata", record_id("metadata", of), uri, date, FIELDS_TYPE, fields.encode(), common)
    text = plain_text(page).encode()
    converted = _record("conversion", record_id("conversion", of), uri, date, TEXT_TYPE, text, [*common, ("WARC-Source-Payload-Digest", payload), ("WARC-Source-Content-Type", mime or None)])
    return meta, converted


#: The columns of a derived record, after the key.
DERIVED = (
    *[(n, StringType()) for n in ("warc_type", "record_id", "refers_to", "target_uri", "block_digest", "source_payload_digest", "content_type")],
    ("content_length", LongType()), ("header", StringType()), ("block", BinaryType()),
)
_ARROW = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

#: Name and value of each field of a record's or a response's header, in order.
HEADER = ArrayType(StructType().add("name", StringType()).add("value", StringType()))


def _row(source: Record, r: Record) -> tuple:
    return (r["WARC-Type"], r["WARC-Record-ID"], r["WARC-Refers-To"], r["WARC-Target-URI"], r["WARC-Block-Digest"], source["WARC-Payload-Digest"] or digest(http_parts(source.block)[2]), r["Content-Type"], len(r.block), r.header(), r.block)


def _derived(rows: DataFrame, weight: str, source_of: Callable[[dict], Record]) -> DataFrame:
    """The records derived of each row: `rows` has the key first and the bytes in
    the column `weight`, by which batches are cut."""
    key = rows.columns[0]
    schema = with_fields(StructType([rows.schema[key]]), *DERIVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in batches_of(whole, weight):
                keys, made = [], []
                for i, row in enumerate(part.to_pylist()):
                    source = source_of(row)
                    for r in derive(source):
                        keys.append(i)
                        made.append(_row(source, r))
                cols = list(zip(*made, strict=True)) or [()] * len(_ARROW)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int32())), *[pa.array(c, k) for c, k in zip(cols, _ARROW, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def derivatives(responses: DataFrame, key: str = "page_id", uri: str = "url", page: str = "html", date: str = "2020-01-01T00:00:00Z", dates: str | None = None, status: str | None = None, headers: str | None = None, record: str | None = None, digests: str | None = None) -> DataFrame:
    """The two derived records of each row of `responses` (uri, page).

    Columns that a table has of its responses are named by `dates` (WARC-Date),
    `status` (status line), `headers` (HEADER), `record` (WARC-Record-ID) and
    `digests` (WARC-Payload-Digest); without them, and where they are null, the
    response is taken as one of `date`, 200, with the type and length of its
    page, a name-based id and the digest of the page.

    Rows: key, warc_type, record_id, refers_to, target_uri, block_digest,
    source_payload_digest, content_type, content_length, header (the record's
    header) and block.  A null page has an empty payload, a null uri gives
    records without one; equal rows derive equal records.
    """
    given = {"_date": (dates, "string"), "_status": (status, "string"), "_headers": (headers, HEADER), "_record": (record, "string"), "_digest": (digests, "string")}
    narrow = responses.select(
        F.col(key), F.col(uri).cast("string").alias("_uri"), F.col(page).cast("string").alias("_page"),
        *[(F.lit(None) if c is None else F.col(c)).cast(t).alias(name) for name, (c, t) in given.items()],
    )

    def source_of(row: dict) -> Record:
        named = None if row["_headers"] is None else [(h["name"] or "", h["value"] or "") for h in row["_headers"] if h is not None]
        out = response(row["_uri"], row["_page"], row["_date"] or date, named, row["_status"] or "HTTP/1.1 200 OK")
        own = {"WARC-Record-ID": row["_record"], "WARC-Payload-Digest": row["_digest"]}
        out.fields = [(k, own.get(k) or v) for k, v in out.fields]
        return out

    return _derived(narrow, "_page", source_of)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (plain, or gzip by records): file, at (the place
    of the record in its file), warc_type, record_id, target_uri, date, fields
    (HEADER, all of them in order), block.

    A task holds one file, so files should be rotated as crawlers do (1 GB).  A
    file that is cut short or no WARC file fails its task by name of the byte.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = StructType().add("file", StringType()).add("at", LongType())
    for name in ("warc_type", "record_id", "target_uri", "date"):
        schema = schema.add(name, StringType())
    schema = schema.add("fields", HEADER).add("block", BinaryType())
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size, name = [], 0, batch.column(0)[i].as_py()
                for at, r in enumerate(read_records(batch.column(1)[i].as_py())):
                    rows.append((name, at, r["WARC-Type"], r["WARC-Record-ID"], r["WARC-Target-URI"], r["WARC-Date"], [{"name": k, "value": v} for k, v in r.fields], r.block))
                    size += len(r.block)
                    if size > 1 << 20:
                        yield flush()
                        rows, size = [], 0
                if rows:
                    yield flush()

    return files.mapInArrow(run, schema)


def derive_records(records: DataFrame) -> DataFrame:
    """The two derived records of each response among `records` (of read_warc):
    source_id (the response's id), then the columns of DERIVED.  Records of other
    kinds are passed over."""
    responses = records.filter("warc_type = 'response'").select(F.col("record_id").alias("source_id"), "fields", "block")

    def source_of(row: dict) -> Record:
        return Record([(f["name"], f["value"]) for f in row["fields"] or []], row["block"] or b"")

    return _derived(responses, "block", source_of)
