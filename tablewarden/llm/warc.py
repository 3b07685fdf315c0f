"""Operator 2: from WARC responses, linked metadata records and plain-text conversion records.

Each response gives two records. The `metadata` record (application/warc-fields) holds the page's title, language,
declared character set and number of links, and the `conversion` record (text/plain) the page's text. Both name the
response in WARC-Refers-To, with its target URI and date, keep the response's own headers as X-Source-*, and carry
SHA-1 digests of their block; WARC-Source-Payload-Digest is the payload digest that the response gives, or else that of its
bytes. Record ids are name-based, so a lost task that runs again gives the same records.

Responses come from a table or, by read_responses, from WARC files (1.0 or 1.1, plain or gzip by member). Bodies are
bytes, read in the character set that the HTTP header or the page declares, else UTF-8.

A page is scanned once from front to end, so the time is proportional to its length whatever is left unclosed. Text leaves out
scripts, styles, comments and the head, breaks lines at block elements, resolves character references and joins runs of white space.

Defined results: a null or empty body gives records with an empty text and the digest of nothing; a null URI is left
out of the headers; rows that share an id or are repeated give the same record ids, each row its two records; a null
id is part of the name as an empty string; a response of unknown date has the caller's `date`; a table without rows gives
none; extra columns are ignored. In files, records other than responses, and what is cut off at a file's end, are left out.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, documents, session_defaults

VERSION = "WARC/1.1"
SPACE_OF_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:derived-warc-records")
RECORD = pa.schema([("page_id", pa.int64()), *((k, pa.string()) for k in ("record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_payload_digest", "headers", "block")), ("content_length", pa.int64())])

#: Elements whose content is no text, and those that end a line.
RAW = ("script", "style", "noscript", "template")
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*RAW, "title")}
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def parsed(page: str) -> tuple[str, list[tuple[str, str]]]:
    """The text, one line for each block, and the fields of a page."""
    out, fields, links, in_head, at = [], {}, 0, False, 0
    last = page.rfind(">")
    while True:
        tag = page.find("<", at)
        if tag < 0 or (tag > last and not page.startswith("<!--", tag)):  # no tag can end any more, but a comment ends with the page
            tag = page.find("<!--", at) if tag >= 0 else -1
        if not in_head:
            out.append(page[at : tag if tag >= 0 else len(page)])
        if tag < 0:
            break
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        if not (tag + 1 < len(page) and (page[tag + 1] in "/!?" or page[tag + 1].isascii() and page[tag + 1].isalpha())):
            out.append("" if in_head else "<")
            at = tag + 1
            continue
        at = page.index(">", tag) + 1
        m = _NAME.match(page, tag, at)
        name, opens = (m[1].lower(), page[tag + 1] != "/") if m else ("", False)
        body = page[m.end() : at] if m else ""
        if name in BLOCK and not in_head:
            out.append("\n")
        if name == "head":
            in_head = opens
            out.append(" ")
        elif opens and name == "title" and "title" not in fields:
            end = _END["title"].search(page, at)
            fields["title"] = page[at : end.start() if end else len(page)]
        elif opens and name == "a":
            links += bool(_HREF.search(body))
        elif opens and (found := {"html": ("language", _LANG), "meta": ("charset", _CHARSET)}.get(name)) and found[0] not in fields and (value := found[1].search(body)):
            fields[found[0]] = value[1]
        elif opens and name in RAW:
            end = _END[name].search(page, at)
            out.append(" ")
            at = end.end() if end else len(page)
    text = "\n".join(line for line in map(squeezed, html.unescape("".join(out)).split("\n")) if line)
    return text, [*((k, squeezed(html.unescape(fields[k]))) for k in ("title", "language", "charset") if k in fields), ("outlinks", str(links))]


def plain_text(page: str) -> str:
    return parsed(page)[0]


def page_fields(page: str) -> list[tuple[str, str]]:
    return parsed(page)[1]


def decoded(body: bytes, media: str = "") -> str:
    """A body as text: in the character set of its media type, or that its first 2048 bytes declare, else UTF-8."""
    for found in (_CHARSET.search(media), _CHARSET.search(body[:2048].decode("latin-1"))):
        if found:
            with contextlib.suppress(LookupError, UnicodeDecodeError):
                return body.decode(found[1])
    return body.decode("utf-8", "replace")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_NAMES, chr(0).join(name))}>"


def _line(value: str) -> str:
    """A header's value, on one line."""
    return squeezed(value)


def derived(page_id: int | None, uri: str | None, body: bytes | None, date: str, source: dict[str, str]) -> Iterator[dict]:
    """The two records of a response."""
    body = body or b""
    payload = source.get("WARC-Payload-Digest") or digest(body)
    name = "" if page_id is None else str(page_id)
    response = source.get("WARC-Record-ID") or record_id("response", name, uri or "", payload)
    kept = {k: v for k, v in source.items() if k != "WARC-Record-ID"}
    text, fields = parsed(decoded(body, source.get("Content-Type") or ""))
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), "conversion": ("text/plain; charset=utf-8", text)}
    ids = {kind: record_id(kind, response, payload) for kind in blocks}
    for kind, (media, text) in blocks.items():
        block = text.encode("utf-8", "replace")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        head = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", response), ("WARC-Concurrent-To", other), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Source-Payload-Digest", payload)]
        head += [(f"X-Source-{k}", v) for k, v in sorted(kept.items())] + [("Content-Type", media), ("Content-Length", str(len(block)))]
        headers = "\r\n".join([VERSION, *(f"{k}: {_line(v)}" for k, v in head if v is not None)])
        yield {"page_id": page_id, "record_type": kind, "record_id": ids[kind], "refers_to": response, "target_uri": uri, "block_digest": digest(block), "source_payload_digest": payload, "headers": headers, "block": block.decode(), "content_length": len(block)}


def _derive(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4 << 20, "body"):
            rows = [r for x in batch.to_pylist() for r in derived(x["page_id"], x["url"], x["body"], x["date"] or date, dict(x["source"] or ()))]
            yield pa.RecordBatch.from_pylist(rows, RECORD)

    return run


def build_derivatives(responses: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Metadata and conversion records of responses.

    responses: page_id, url, body, and if known date (of capture) and source (map of the response's WARC and HTTP headers).
    """
    session_defaults(responses.sparkSession)
    has = set(responses.columns)
    rows = responses.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("body").cast("binary").alias("body"),
        (F.col("date").cast("string") if "date" in has else F.lit(None).cast("string")).alias("date"),
        (F.col("source").cast("map<string,string>") if "source" in has else F.lit(None).cast("map<string,string>")).alias("source"),
    )
    schema = "page_id long, record_type string, record_id string, refers_to string, target_uri string, block_digest string, source_payload_digest string, headers string, block string, content_length long"
    return rows.mapInArrow(_derive(date), schema)


class Skipped(NamedTuple):
    """Bytes of a stream that hold no whole record."""

    reason: str
    size: int


_BEGIN = re.compile(rb"(?:\A|(?<=\n))WARC/\d+\.\d+\r?\n")


def _records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes] | Skipped]:
    """Headers and block of each record of a stream of bytes. After bytes that are no record, as its headers or its length
    don't hold, reading goes on where the next line names a WARC version; what was passed over is told."""
    held, ended = bytearray(), False

    def more(n: int) -> bool:
        nonlocal ended
        while len(held) < n:
            piece = next(data, None)
            if piece is None:
                ended = True
                return False
            held.extend(piece)
        return True

    def skip(reason: str) -> Skipped:
        """Drop all before the next line that begins a record, but not one in the first byte."""
        gone, start = 0, 1
        while True:
            found = _BEGIN.search(held, start)
            if found and (found.end() < len(held) or not more(len(held) + 1)):
                del held[: found.start()]
                return Skipped(reason, gone + found.start())
            keep = 32  # a line cut in two
            if len(held) > keep:
                gone, start = gone + len(held) - keep, 0
                del held[: len(held) - keep]
            if not more(len(held) + 1):
                gone += len(held)
                held.clear()
                return Skipped(reason, gone)

    while True:
        while more(1) and held[0] in b"\r\n":  # what ends a record
            del held[:1]
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0 and len(held) < MOST_HEADER:
            seen = len(held)
            if not more(seen + 1):
                break
        if end < 0:
            yield skip("no end of headers")
            continue
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        if not lines[0].startswith("WARC/") or not re.fullmatch(r"[0-9]{1,18}", length):
            yield skip("no length" if lines[0].startswith("WARC/") else "no version")
            continue
        size = end + 4 + int(length)
        if not more(size) or (more(size + 4) or len(held) > size) and not held[size:].startswith(b"\r\n"):
            yield skip("the length is not that of the block")
            continue
        yield head, bytes(held[end + 4 : size])
        del held[:size]


MEMBER = b"\x1f\x8b\x08"
#: Bytes of headers of a record at most.
MOST_HEADER = 1 << 20


def _unzipped(content: bytes, at_once: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file; of a gzip file those of all its members, piece by piece. After a damaged member comes the next one."""
    if content[:2] != MEMBER[:2]:
        yield from (content[i : i + at_once] for i in range(0, len(content), at_once))
        return
    begin = 0
    while begin >= 0:
        stream, at = zlib.decompressobj(31), begin
        try:
            while at < len(content) and not stream.eof:
                piece = content[at : at + at_once]
                yield stream.decompress(piece, at_once)
                at += len(piece) - len(stream.unconsumed_tail) - len(stream.unused_data)
        except zlib.error:
            yield b"\r\n\r\n"  # ends what the damaged member began
            at = begin + 1
        begin = content.find(MEMBER, at)


def _payload(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """HTTP headers (with HTTP-Status) and body of a response block, transfer and content encodings undone."""
    head, sep, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = lines[0].split(" ")
    if not sep or len(status) < 2 or not lines[0].startswith("HTTP/"):
        return None
    headers = {k.strip().title(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"HTTP-Status": status[1]}
    if headers.get("Transfer-Encoding", "").lower() == "chunked":
        whole, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            size = body[at:end].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9a-fA-F]+", size) or not int(size, 16):
                break
            whole.append(body[end + 2 : end + 2 + int(size, 16)])
            at = end + 4 + int(size, 16)
        body = b"".join(whole) if whole else body
    if headers.get("Content-Encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        with contextlib.suppress(zlib.error):
            body = zlib.decompressobj(47).decompress(body)
    return headers, body


RESPONSE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("body", pa.binary()), ("date", pa.string()), ("source", pa.map_(pa.string(), pa.string()))])


def _read_responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            for record in _records(_unzipped(content.as_py())):
                if isinstance(record, Skipped):
                    continue
                head, block = record
                if head.get("warc-type") == "response" and (found := _payload(block)):
                    given = {k: head[k.lower()] for k in ("WARC-Record-ID", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-IP-Address") if k.lower() in head}
                    row = {"page_id": None, "url": head.get("warc-target-uri", "").strip("<>") or None, "body": found[1], "date": head.get("warc-date"), "source": list((found[0] | given).items())}
                    yield pa.RecordBatch.from_pylist([row], RESPONSE)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            kinds: dict[tuple[str, str], list[int]] = {}
            for record in _records(_unzipped(content.as_py())):
                if isinstance(record, Skipped):
                    key, size = ("skipped", record.reason), record.size
                else:
                    key, size = (record[0].get("warc-type", ""), ""), len(record[1])
                    if key[0] == "response" and not _payload(record[1]):
                        key = ("skipped", "no HTTP response")
                now = kinds.setdefault(key, [0, 0])
                now[0], now[1] = now[0] + 1, now[1] + size
            rows = [[path] * len(kinds), [k for k, _ in kinds], [r or None for _, r in kinds], [n for n, _ in kinds.values()], [b for _, b in kinds.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "kind", "reason", "records", "bytes"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    session_defaults(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The responses of WARC files as build_derivatives takes them. A gzip file can't be split, so each file is read by one
    task, which holds it as it is packed and one record of it; Spark reads files of up to 2 GB so. Damaged records and
    gzip members are passed over, and the ones after them read; `read_report` counts them."""
    return _files(spark, path).select("content").mapInArrow(_read_responses, "page_id long, url string, body binary, date string, source map<string,string>")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (a WARC type, or skipped), reason, records and bytes: what each file holds, and what of it can't be read."""
    return _files(spark, path).select("path", "content").mapInArrow(_report, "path string, kind string, reason string, records long, bytes long")


def write_warc(records: DataFrame, path: str) -> None:
    """The records as WARC files, one for each partition."""
    records.select(F.concat("headers", F.lit("\r\n\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records written by write_warc: headers (a map) and block. No derived block begins like a record, so files can be split."""
    raw = spark.read.option("lineSep", f"\r\n\r\n{VERSION}\r\n").text(path)
    whole = F.regexp_replace(F.regexp_replace("value", f"^{re.escape(VERSION)}\r\n", ""), "\r\n\r\n\\z", "")
    raw = raw.select(whole.alias("value"), F.locate("\r\n\r\n", whole).alias("at"))
    raw = raw.withColumn("at", F.when(F.col("at") > 0, F.col("at")).otherwise(F.length("value") + 1))
    lines = F.split(F.substr("value", F.lit(1), F.col("at") - 1), "\r\n")
    pairs = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1), F.substr(x, F.locate(": ", x) + 2))))
    return raw.select(pairs.alias("headers"), F.substr("value", F.col("at") + 4).alias("block"))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """The table of pages as responses: what a crawl would have sent along is named in source."""
    source = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("HTTP-Status"), F.lit("200"), F.lit("Host"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    return pages.select("page_id", "url", F.col("html").alias("body"), source.alias("source"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page; the block is the metadata or the plain text."""
    return build_derivatives(responses_of_pages(documents(spark, sf_dir, "pages")))
