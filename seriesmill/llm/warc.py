"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response gives two records that refer to it (``WARC-Refers-To``) and to each other: a *metadata* record (JSON: the
response's WARC headers in their order, its HTTP status line and headers, lengths and digests, title, page metadata and links, and
the id of the conversion), and a *conversion* record (plain text of the page, one line per block). Both keep the
response's target, date and warcinfo id; their ids are derived from the response's, so reruns agree. Digests are ``sha1:`` in
base 32: the block digest of each new record, and in the metadata the response's stated and recomputed block and payload digests.

A record is a row of bytes: version line, header lines, blank line, block. Header names are kept as they stand and matched
without regard to case; values may hold continuation lines; repeated headers stay. Chunked and compressed payloads are
decoded for the text. A response that is no text or HTML gets a metadata record only. Records of other types give nothing. What cannot be read as a
record (NULL included) gives one row of kind ``invalid`` that says why, so nothing gets lost silently. Repeated records give repeated
results; an empty table gives an empty result. Columns other than id and record are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extraction import ENDS_PARAGRAPH, RAW_ENDS, tokens
from .shared import table

DATE = "2024-01-01T00:00:00Z"
BREAKS = ENDS_PARAGRAPH | {"br", "title", "option", "caption", "body", "html", "head", "li"}
LINK = re.compile(r"(?:^|[\s\"'])(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
META = re.compile(r"(name|property|http-equiv|content|charset)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>/]+))", re.IGNORECASE)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)
COLUMNS = ("kind", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", "record")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_headers(data: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers in order, and what follows the blank line."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark:
        head, mark, rest = data.partition(b"\n\n")
    if not mark:
        raise ValueError("no blank line after the headers")
    first, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
        elif line.strip():
            raise ValueError("a header line without a colon")
    return first.strip(), headers, rest


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode() + block + b"\r\n\r\n"


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content encodings; bytes that do not fit them stay as they are."""
    if "chunked" in (header(headers, "transfer-encoding") or "").lower():
        out, at = [], 0
        while True:
            end = body.find(b"\r\n", at)
            try:
                size = int(body[at:end].split(b";")[0], 16) if end >= 0 else 0
            except ValueError:
                break
            if size <= 0:
                body = b"".join(out)
                break
            out.append(body[end + 2 : end + 2 + size])
            at = end + 4 + size
    coding = (header(headers, "content-encoding") or "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for window in (47, -15):
            try:
                return _inflated(body, window)
            except zlib.error:
                continue
    return body


def _inflated(body: bytes, window: int) -> bytes:
    """All members of a compressed body; what follows them and is none is left out."""
    out: list[bytes] = []
    while body:
        member = zlib.decompressobj(window)
        try:
            out.append(member.decompress(body))
        except zlib.error:
            if not out:
                raise
            break
        body = member.unused_data if member.eof else b""
    return b"".join(out)


def text_of(body: bytes, content_type: str) -> str:
    found = CHARSET.search(content_type.encode()) or CHARSET.search(body)
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


MARKUP = frozenset("noscript template svg math select".split())  # raw elements whose contents may link


def page_parts(source: str) -> tuple[str, dict]:
    """Plain text of a page, and its title, metadata and links: every href and src of every tag, in page order but for
    those inside noscript and the like, which come at the end."""
    out: list[str] = []
    title, metas, links, inner = "", [], [], []

    def start(name: str, rest: str):
        links.extend({"path": name, "url": html.unescape("".join(found))} for found in LINK.findall(rest))

    for text, ends, name, rest in tokens(source):
        out.append(text)
        if name is None:
            continue
        if name in RAW_ENDS:
            if not ends:
                start(name, rest)
            elif name == "title":
                title = title or " ".join(html.unescape(re.sub(r"<[^>]*>", "", rest)).split())
                out.append("\n")
            elif name in MARKUP:
                inner.append(rest)
            continue
        if name in BREAKS:
            out.append("\0")
        if not ends:
            if name == "meta":
                metas.append({k.lower(): html.unescape("".join(v)) for k, *v in META.findall(rest)})
            start(name, rest)
    for part in inner:  # grows by what they hold
        for _, ends, name, rest in tokens(part):
            if name and not ends:
                start(name, rest)
            elif name in MARKUP and ends and rest:
                inner.append(rest)
    lines = (" ".join(html.unescape(line).split()) for line in "".join(x.replace("\n", " ") if x not in ("\0", "\n") else "\0" for x in out).split("\0"))
    return "\n".join(line for line in lines if line), {"Title": title, "Metas": metas, "Links": links}


def derivatives(record: bytes | None) -> list[tuple]:
    """Rows of COLUMNS for the records that *record* gives."""
    try:
        if record is None:
            raise ValueError("no record")
        version, headers, rest = split_headers(record)
        if not version.upper().startswith("WARC/"):
            raise ValueError("no WARC version line")
        kind, own = header(headers, "warc-type"), header(headers, "warc-record-id")
        if not kind:
            raise ValueError("no WARC-Type")
        if kind.lower() != "response":
            return []
        if not own:
            raise ValueError("no WARC-Record-ID")
        length = int(header(headers, "content-length") or "no Content-Length")
        if length > len(rest):
            raise ValueError("the block is shorter than Content-Length")
        block = rest[:length]
        status, http, body = split_headers(block) if block.startswith(b"HTTP/") else ("", [], block)
    except ValueError as problem:
        return [("invalid", None, None, None, None, None, None, None, None, str(problem).encode())]
    content_type = header(http, "content-type") or header(headers, "content-type") or ""
    names = {k: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {k}').urn}>" for k in ("metadata", "conversion")}
    shared = [(k, v) for k, v in headers if k.lower() in ("warc-target-uri", "warc-date", "warc-warcinfo-id")]
    payload = decoded(http, body)
    is_html = "html" in content_type.lower() or (not content_type and b"<html" in payload.lower())
    is_text = is_html or content_type.lower().startswith("text/")
    source = text_of(payload, content_type) if is_text else ""
    text, page = page_parts(source) if is_html else ("\n".join(filter(None, (" ".join(x.split()) for x in source.splitlines()))), {})
    digests = {"block": sha1(block), "payload": sha1(body)}
    stated = {"block": header(headers, "warc-block-digest"), "payload": header(headers, "warc-payload-digest")}
    envelope = {
        "Source": {"Record-ID": own, "Version": version, "Headers": headers, "Block-Digest": digests["block"], "Payload-Digest": digests["payload"],
                   "Digests-Agree": {k: None if stated[k] is None else stated[k].lower() == v.lower() for k, v in digests.items()}},
        "HTTP": {"Status": status, "Headers": http, "Header-Length": len(block) - len(body), "Payload-Length": len(body)},
        "HTML": page,
        "Conversion": names["conversion"] if is_text else None,
    }
    made = [("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode())]
    if is_text:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    rows = []
    for kind, media, data in made:
        lines = [("WARC-Type", kind), ("WARC-Record-ID", names[kind]), ("WARC-Refers-To", own), *shared]
        if is_text:
            lines.append(("WARC-Concurrent-To", names["conversion" if kind == "metadata" else "metadata"]))
        lines += [("WARC-Block-Digest", sha1(data)), ("Content-Type", media), ("Content-Length", str(len(data)))]
        rows.append((
            kind, names[kind], own, header(headers, "warc-target-uri"), header(headers, "warc-date"), media, len(data), sha1(data),
            stated["payload"] or digests["payload"], record_bytes(lines, data),
        ))
    return rows


def derive(records: DataFrame, id: str = "id", record: str = "record") -> DataFrame:
    """Rows (id, kind, …, record), up to two per row of *records* (id, record)."""
    narrow = records.select(records[id].alias("id"), records[record].cast("binary").alias("record"))
    kinds = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                at, rows = [], []
                for n, one in enumerate(part.column(1)):
                    made = derivatives(one.as_py())
                    at += [n] * len(made)
                    rows += made
                columns = list(zip(*rows)) or [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", *COLUMNS]
                )

    return narrow.mapInArrow(run, _schema(narrow))


def _schema(narrow: DataFrame):
    plain = {"content_length": F.lit(0).cast("long"), "record": F.lit(b"")}
    return narrow.select("id", *(F.lit(None).cast("string").alias(c) if c not in plain else plain[c].alias(c) for c in COLUMNS)).schema


def page_responses(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html", date: str = DATE) -> DataFrame:
    """Response records (id, record) as a crawler would have written them for *pages*."""
    html_ = F.coalesce(pages[source].cast("string"), F.lit(""))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html_).cast("string"), F.lit("\r\n\r\n"))
    key = F.md5(F.concat_ws("\x1f", F.coalesce(pages[id].cast("string"), F.lit("")), F.coalesce(pages[url], F.lit(""))))
    name = F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    block = F.concat(status, html_)
    target = F.when(pages[url].isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(pages[url], "[\r\n]+", " "), F.lit("\r\n"))).otherwise("")
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), name, F.lit("\r\n"), target, F.lit(f"WARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(pages[id].alias("id"), F.concat(lines, block, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def op4_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return derive(page_responses(table(spark, folder, "pages"))).withColumnRenamed("id", "page_id").withColumn("record", F.col("record").cast("string"))


QUERIES = {"op4_warc_derivatives": (op4_warc_derivatives, None)}
