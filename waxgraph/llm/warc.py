"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response yields two records that refer to it: one of metadata (source headers,
status, digests, title and links, as JSON) and one of type conversion with the plain
text. Record ids are derived from the source's, so a job that runs again writes the same.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waxgraph.llm.common import batch_of, prepare

VERSION = "WARC/1.0"
_OUT = pa.schema([
    ("source_id", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
    ("target_uri", pa.string()), ("date", pa.string()), ("source_digest", pa.string()), ("block_digest", pa.string()),
    ("n_links", pa.int64()), ("record", pa.binary()), ("error", pa.string()),
])
_DDL = (
    "source_id long, type string, record_id string, refers_to string, target_uri string, date string, "
    "source_digest string, block_digest string, n_links long, record binary, error string"
)

# Elements whose content is not shown, and those that part lines.
_UNSEEN = re.compile(r"<!--|<(script|style|noscript|template)\b|<!\[CDATA\[|\]\]>", re.I)
_UNSEEN_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
_BREAKS = frozenset(
    "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav title blockquote pre hr dd dt main "
    "aside form body head html".split()
)
_TAG = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b")
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title", re.I)
_LINKED = frozenset("a area link img script iframe source".split())
_LINK = re.compile(r"[^>]*?\s(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Types that hold text; others have no conversion record.
_TEXT_TYPE = re.compile(r"\s*(?:text/|application/(?:xhtml|xml|json|javascript|[\w.+-]+\+(?:xml|json)))", re.I)
# Bytes up to which a compressed body is unpacked.
MOST_UNPACKED = 256 << 20
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record; digest and length are of the block."""
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    found: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append((name.strip(), value.strip()))
    return first, found


def _get(headers: list[tuple[str, str]], name: str, default: str = "") -> str:
    return next((value for key, value in headers if key.lower() == name.lower()), default)


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; an error tells what is wrong with it."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, headers = _headers(head)
    if not gap or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    length = _get(headers, "Content-Length")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("block shorter than its length")
    return headers, rest[: int(length)]


def _shown(page: str) -> str:
    """A page without comments, scripts and the like. Each character is looked at once or twice."""
    kept, at = [], 0
    while found := _UNSEEN.search(page, at):
        name, end = found[1], found.end()
        if name:
            end = page.find(">", end)
            if end < 0:
                break
            closed = _UNSEEN_END[name.lower()].search(page, end + 1)
            end = closed.end() if closed else len(page)
        elif found[0] == "<!--":
            closed = page.find("-->", end)
            end = closed + 3 if closed >= 0 else len(page)
        kept += [page[at : found.start()], " "]
        at = end
    return "".join([*kept, page[at:]])


def _tags(page: str):
    """Start and end of each tag. A tag that never closes is none, and neither is what follows it."""
    at = 0
    while found := _TAG.search(page, at):
        end = page.find(">", found.start())
        if end < 0:
            return
        yield found.start(), end + 1
        at = end + 1


def plain_text(page: str) -> str:
    """Text of a page: scripts, styles and comments removed, blocks on lines of their own, entities resolved."""
    page = _shown(page)
    kept, at = [], 0
    for start, end in _tags(page):
        name = _NAME.match(page, start)
        kept += [page[at:start], "\n" if name and name[1].lower() in _BREAKS else ""]
        at = end
    kept.append(page[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(kept)).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str | None:
    """The first title, if it is closed."""
    found = _TITLE.search(page)
    end = page.find(">", found.end()) if found else -1
    closed = _TITLE_END.search(page, end) if end >= 0 else None
    return html.unescape(" ".join(page[end + 1 : closed.start()].split())) if closed else None


def links(page: str, base: str) -> list[dict[str, str]]:
    """Links in order, one for a tag, resolved against the page's address; those in comments are none."""
    found = []
    page = _without_comments(page)
    for start, end in _tags(page):
        name = _NAME.match(page, start)
        if not name or page[start + 1] == "/" or name[1].lower() not in _LINKED:
            continue
        held = _LINK.match(page, name.end())
        target = html.unescape(next((v for v in held.groups()[1:] if v), "")).strip() if held else ""
        if target:
            try:
                target = urljoin(base, target)
            except ValueError:
                pass
            found.append({"path": f"{name[1].lower()}@{held[1].lower()}", "url": target})
    return found


def _without_comments(page: str) -> str:
    kept, at = [], 0
    while (start := page.find("<!--", at)) >= 0:
        end = page.find("-->", start + 4)
        kept += [page[at:start], " "]
        at = end + 3 if end >= 0 else len(page)
    return "".join([*kept, page[at:]])


def _unchunked(body: bytes) -> bytes:
    """A body in chunks, put together."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            raise ValueError("chunk without a size")
        length = int(size, 16)
        if not length:
            return b"".join(parts)
        if end + 2 + length > len(body):
            raise ValueError("chunk shorter than its size")
        parts.append(body[end + 2 : end + 2 + length])
        at = end + 2 + length + 2


def _unpacked(body: bytes, encoding: str) -> bytes:
    """A body without its content encodings; those not known are an error."""
    for name in reversed([e.strip().lower() for e in encoding.split(",") if e.strip()]):
        if name in ("gzip", "x-gzip", "deflate"):
            # Deflate comes with a header or, against the rules, without.
            raw = name == "deflate" and not (len(body) > 1 and (body[0] << 8 | body[1]) % 31 == 0)
            unpack = zlib.decompressobj(31 if "gzip" in name else -15 if raw else 15)
            try:
                body = unpack.decompress(body, MOST_UNPACKED)
            except zlib.error as fault:
                raise ValueError(f"broken {name}: {fault}") from fault
            if unpack.unconsumed_tail or not unpack.eof:
                raise ValueError(f"{name} body too long or cut off")
        elif name != "identity":
            raise ValueError(f"unknown encoding {name}")
    return body


def _page(payload: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type.encode()) or _CHARSET.search(payload[:1024])
    try:
        return payload.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(raw: bytes) -> list[tuple]:
    """Metadata and conversion record of one response: the columns of ``derivatives`` after ``source_id``."""
    headers, block = parse(raw)
    if _get(headers, "WARC-Type") != "response":
        return []
    source, target, date = (_get(headers, f"WARC-{name}") for name in ("Record-ID", "Target-URI", "Date"))
    head, _, payload = block.partition(b"\r\n\r\n")
    status, sent = _headers(head)
    kind = _get(sent, "Content-Type")
    fault, page, body, whole = None, None, payload, payload
    try:
        if "chunked" in _get(sent, "Transfer-Encoding").lower():
            whole = _unchunked(payload)
        body = _unpacked(whole, _get(sent, "Content-Encoding"))
        page = _page(body, kind) if not kind or _TEXT_TYPE.match(kind) else None
        fault = None if page is not None else f"no text: {kind}"
    except ValueError as broken:
        fault = str(broken)
    # The source's own digest stands; it is of the payload with or without its chunks.
    given = _get(headers, "WARC-Payload-Digest")
    source_digest = given or digest(payload)
    matches = source_digest in (digest(payload), digest(whole)) if source_digest.startswith("sha1:") else None
    if matches is False:
        fault = fault or "payload digest differs"
    found = links(page, target) if page is not None else []
    about = {
        "source": {"headers": headers, "payload-digest": source_digest, "payload-length": len(payload)},
        "response": {"status": status, "headers": sent},
        "html": {"title": title_of(page) if page is not None else None, "links": found},
    }
    if given:
        about["source"]["payload-digest-matches"] = matches
    blocks = {"metadata": ("application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace"))}
    if page is not None:
        blocks["conversion"] = ("text/plain", plain_text(page).encode("utf-8", "replace"))
    rows = []
    for name, (content_type, content) in blocks.items():
        record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {name}')}>"
        block_digest = digest(content)
        fields = [
            ("WARC-Type", name), ("WARC-Record-ID", record_id), ("WARC-Refers-To", source), ("WARC-Target-URI", target),
            ("WARC-Date", date), ("WARC-Source-Payload-Digest", source_digest), ("WARC-Block-Digest", block_digest),
            ("Content-Type", content_type),
        ]
        rows.append((name, record_id, source, target, date, source_digest, block_digest, len(found), record(fields, content), fault))
    return rows


def derivatives(responses: DataFrame, id_column: str = "source_id", record_column: str = "record") -> DataFrame:
    """Two rows for each response record: its metadata and its conversion record.

    Chunked and compressed (gzip, deflate) bodies are unpacked first. A body that is not
    text, or cannot be unpacked, has no conversion record; ``error`` of the metadata says
    why, or that the source's payload digest is not that of its payload.

    Records of other types give none. A null record and one that cannot be parsed give
    one row with ``error`` and nulls. Repeated rows and null ids are treated alike; an
    empty payload gives an empty text; an empty table gives an empty result; further
    columns are not looked at.
    """
    prepare(responses.sparkSession)
    plain = responses.select(F.col(id_column).cast("long").alias("source_id"), F.col(record_column).cast("binary").alias("raw"))

    def rows(batches):
        for batch in batches:
            out = []
            for source_id, raw in zip(batch["source_id"].to_pylist(), batch["raw"].to_pylist()):
                try:
                    out += [(source_id, *row) for row in derive(raw or b"")]
                except ValueError as fault:
                    out.append((source_id, *[None] * 9, str(fault)))
            if out:
                yield batch_of(_OUT, list(zip(*out)))

    return plain.mapInArrow(rows, _DDL)


def response_records(pages: DataFrame) -> DataFrame:
    """Response records ``source_id, record`` of ``page_id, url, html``; a null page is an empty one."""
    prepare(pages.sparkSession)
    schema = pa.schema([("source_id", pa.int64()), ("record", pa.binary())])

    def rows(batches):
        for batch in batches:
            out = []
            for page_id, url, text in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                payload = (text or "").encode("utf-8", "replace")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
                fields = [
                    ("WARC-Type", "response"),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"),
                    ("WARC-Target-URI", (url or "").replace("\r", "").replace("\n", "")),
                    ("WARC-Date", "2024-01-01T00:00:00Z"),
                    ("WARC-Payload-Digest", digest(payload)),
                    ("WARC-Block-Digest", digest(block)),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                out.append((page_id, record(fields, block)))
            yield batch_of(schema, list(zip(*out)) or [[], []])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        rows, "source_id long, record binary"
    )
