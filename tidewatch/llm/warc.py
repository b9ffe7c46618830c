"""WARC: reading records, and building derivatives of responses.

From each response come a metadata record (what its headers, title and links say, as JSON) and, if it holds text,
a conversion record (its plain text). Both name the response in WARC-Refers-To and carry its URI, date and payload
digest. Files are read as a stream of records, whatever their size; what doesn't parse is reported.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import small_batches, text_slices
from tidewatch.llm.dom import read

VERSION = "WARC/1.1"
#: What ends a record and begins the next one, but for the last digit of the version.
BOUNDARY = b"\r\n\r\nWARC/1."
DERIVED = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "source_payload_digest", "content_length", "block")
#: Bytes of records handled at once (a larger one alone), and rows.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 256
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def to_bytes(record: Record) -> bytes:
    """A record as a WARC file holds it."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in record.headers.items()), f"Content-Length: {len(record.block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + record.block + b"\r\n\r\n"


class Malformed(ValueError):
    """A record that doesn't parse."""


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that begins at a byte, and where it ends; Malformed if it breaks off or isn't one."""
    if not data.startswith(b"WARC/", at):
        raise Malformed(f"no WARC record at byte {at}")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Malformed(f"headers at byte {at} don't end")
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            headers[last] = value.strip()
    length = _get(headers, "Content-Length") or ""
    if not length.isascii() or not length.isdigit():
        raise Malformed(f"record at byte {at} has no Content-Length")
    size = int(length)
    if end + 4 + size > len(data):
        raise Malformed(f"record at byte {at} breaks off: {len(data) - end - 4} of {size} bytes")
    headers = {k: v for k, v in headers.items() if k.lower() != "content-length"}
    return Record(headers, data[end + 4 : end + 4 + size]), end + 4 + size + 4


def _get(headers: dict[str, str], name: str) -> str | None:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def response(uri: str | None, page: str | None, date: str, key: object) -> Record:
    """A response record of a page, as a crawler would have written it."""
    payload = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", uri or "", key), "WARC-Date": date}
    if uri:
        headers["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", uri)
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)}
    return Record(headers, block)


def _unchunked(data: bytes) -> bytes:
    """The body of chunks; what doesn't parse as chunks stays as it is."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(out) if out and at >= len(data) else data
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _decoded(data: bytes, encodings: list[str]) -> bytes | None:
    """The body without its content encodings; None if one is unknown or the body is damaged."""
    for kind in reversed(encodings):
        try:
            if kind in ("gzip", "x-gzip"):
                data = zlib.decompressobj(31).decompress(data)
            elif kind == "deflate":
                data = zlib.decompressobj(15 if data[:1] == b"\x78" else -15).decompress(data)
            elif kind == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif kind not in ("identity", ""):
                return None
        except Exception as e:  # zlib's and zstandard's errors have no common class but this
            if not isinstance(e, (zlib.error, OSError)) and type(e).__name__ != "ZstdError":
                raise
            return None
    return data


_META_CHARSET = re.compile(rb"<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def _text(body: bytes, kind: str) -> str:
    """A body's characters, in the charset that its header or its page names, else UTF-8."""
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    meta = _META_CHARSET.search(body[:2048])
    name = charset[1] if charset else meta[1].decode("latin-1") if meta else "utf-8"
    try:
        return body.decode(name, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def derivatives(source: Record) -> list[Record]:
    """The metadata record of a response and, if it holds text, the conversion record; none for records of other types."""
    if (_get(source.headers, "WARC-Type") or "").lower() != "response":
        return []
    head, _, payload = source.block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
    of = lambda name: next((v for k, v in http if k.lower() == name), "")
    kind, media = of("content-type"), of("content-type").split(";")[0].strip().lower()
    body = _unchunked(payload) if of("transfer-encoding").lower() == "chunked" else payload
    body = _decoded(body, [e.strip().lower() for e in of("content-encoding").split(",")])
    origin = _get(source.headers, "WARC-Record-ID") or ""
    known = _get(source.headers, "WARC-Payload-Digest") or digest(payload)
    meta = {"source": source.headers, "http": {"status": status, "headers": http}, "payload": {"digest": known, "length": len(payload)}}
    made: list[tuple[str, str, bytes]] = []
    if body is None:
        meta["payload"]["undecoded"] = of("content-encoding")
    elif media in ("", "text/html", "application/xhtml+xml"):
        blocks, title, links = read(_text(body, kind))
        meta["html"] = {"title": title, "links": [{"url": u, "text": t} for u, t in links]}
        made.append(("conversion", "text/plain; charset=utf-8", "\n".join(b.text for b in blocks).encode("utf-8", "replace")))
    elif media.startswith("text/"):
        made.append(("conversion", "text/plain; charset=utf-8", _text(body, kind).encode("utf-8", "replace")))
    made.insert(0, ("metadata", "application/json", json.dumps(meta, ensure_ascii=False).encode("utf-8", "replace")))
    out = []
    for name, content, block in made:
        headers = {"WARC-Type": name, "WARC-Record-ID": record_id(name, origin), "WARC-Refers-To": origin}
        for key, value in (("WARC-Target-URI", _get(source.headers, "WARC-Target-URI")), ("WARC-Date", _get(source.headers, "WARC-Date")), ("WARC-Refers-To-Payload-Digest", known)):
            if value:
                headers[key] = value
        out.append(Record(headers | {"Content-Type": content, "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(block)}, block))
    return out


def page_responses(pages: DataFrame, date: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of a table of pages: source_id, record (binary). Null pages have an empty payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw in text_slices(batches, SLICE_BYTES, SLICE_ROWS, "html"):
            ids, urls = piece.column(0), piece.column(1).to_pylist()
            made = [to_bytes(response(u, h.decode(), date, i)) for i, u, h in zip(ids.to_pylist(), urls, raw)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=["source_id", "record"])

    small_batches(pages.sparkSession)
    source = pages.select(F.col(page_id).cast("long").alias("source_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return source.mapInArrow(run, "source_id long, record binary")


def _joined(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes, str | None]]:
    """(file, record, error) of the pieces between boundaries. A boundary inside a block made several pieces of it;
    pieces are put together again until the block is as long as its header says."""
    name, held = "", b""
    for file, piece in pieces:
        if held and file == name:
            piece = held + BOUNDARY + piece
        elif held:
            yield name, held, _error(held)
        elif not piece.startswith(b"WARC/"):
            piece = b"WARC/1." + piece
        if held and file != name and not piece.startswith(b"WARC/"):
            piece = b"WARC/1." + piece
        name, held = file, b""
        error = _error(piece)
        if error and "breaks off" in error:
            held = piece
        else:
            yield file, piece, error
    if held:
        yield name, held, _error(held)


def _error(record: bytes) -> str | None:
    try:
        parse(record)
    except Malformed as e:
        return str(e)
    return None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files: source_id, record, error (null for a record that parses).

    Files are read as streams of records, so their size doesn't matter; large plain files are read in several
    tasks, a compressed one in one. source_id: MD5 of the file's path and the record. A block that holds the words
    of a record's beginning after an empty line is put together again, unless a split of a plain file
    happens to lie there; then its parts are reported. Files without records give none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[str, bytes]]:
            for piece, raw in text_slices(batches, SLICE_BYTES, SLICE_ROWS, "value"):
                yield from ((f, r) for f, r in zip(piece.column(0).to_pylist(), raw) if r.strip())

        rows: list[tuple[str, bytes, str | None]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            ids = [hashlib.md5(f.encode() + b"\0" + r, usedforsecurity=False).hexdigest() for f, r, _ in rows]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([r for _, r, _ in rows], pa.binary()), pa.array([e for _, _, e in rows], pa.string())],
                                              names=["source_id", "record", "error"])

        for row in _joined(pieces()):
            rows.append(row)
            size += len(row[1])
            if size >= SLICE_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    lines = spark.read.option("lineSep", BOUNDARY.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, "source_id string, record binary, error string")


def build_derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all responses among `records` (source_id, record).

    Columns: source_id, record_type, record_id, refers_to, target_uri (null if the response has none), date,
    content_type, payload_digest, block_digest, source_payload_digest, content_length, block (text). Identifiers
    are name-based, so a repeated run or task gives the same. Bodies are read without their transfer and content
    encodings; a response in an unknown encoding, or of no text type, has metadata only. Records of other types,
    records that don't parse (read_warc and record_errors report them) and null records give no rows, repeated rows
    give theirs each, an empty table an empty result. Records are handled SLICE_BYTES at a time, very long ones
    alone. Other columns are not read.
    """
    schema = T.StructType([T.StructField("source_id", records.schema["source_id"].dataType)] + [
        T.StructField(n, T.LongType() if n == "content_length" else T.StringType()) for n in DERIVED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw in text_slices(batches, SLICE_BYTES, SLICE_ROWS, "record"):
            rows: list[tuple] = []
            for k, data in enumerate(raw):
                if _error(data):
                    continue
                for r in derivatives(parse(data)[0]):
                    h = r.headers
                    rows.append((k, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h.get("WARC-Date"), h["Content-Type"],
                                 h["WARC-Payload-Digest"], h["WARC-Block-Digest"], h["WARC-Refers-To-Payload-Digest"], len(r.block), r.block.decode()))
            columns = [piece.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            columns += [pa.array([r[k + 1] for r in rows], pa.int64() if n == "content_length" else pa.string()) for k, n in enumerate(DERIVED)]
            yield pa.RecordBatch.from_arrays(columns, names=["source_id", *DERIVED])

    return records.select("source_id", "record").filter(F.col("record").isNotNull()).mapInArrow(run, schema)


def record_errors(records: DataFrame) -> DataFrame:
    """(source_id, error) of the records that don't parse."""
    schema = T.StructType([T.StructField("source_id", records.schema["source_id"].dataType), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw in text_slices(batches, SLICE_BYTES, SLICE_ROWS, "record"):
            found = [(k, e) for k, data in enumerate(raw) if (e := _error(data))]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array([k for k, _ in found], pa.int64())), pa.array([e for _, e in found], pa.string())], names=["source_id", "error"])

    return records.select("source_id", "record").filter(F.col("record").isNotNull()).mapInArrow(run, schema)
