"""WARC records in ZIP-packaged archives, written and read back by range.

Every task packs its records into one archive: a ZIP whose members are stored, not
compressed, so that offsets inside a member are offsets inside the file. One member holds
the records as gzip members of their own, another an index of their offsets and lengths.
The reader takes only the end of the file, the central directory (ZIP64 included), the
index and then the byte range of each record; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.arrays import slices
from urbanweave.llm.spark import checkpoint, shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the headers alone. A page without an id has an empty one."""
    page_id = "" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, level: int) -> Iterator[pa.RecordBatch]:
    """Write the partition's records to one archive of a fresh name; yields its path and number of records."""
    fs, base = pafs.FileSystem.from_uri(folder)
    path, lines, n, at = f"{base}/{uuid.uuid4().hex}.wacz", [], 0, 0
    sink = archive = member = None
    for batch in (part for whole in batches for part in slices(whole, "html")):
        for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if archive is None:
                sink = fs.open_output_stream(path)
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                member = archive.open(DATA, "w", force_zip64=True)
            data = _gzip(_record(page_id, url, (html or "").encode("utf-8"), refers_to), level)
            member.write(data)
            lines.append(json.dumps({"page": page_id, "offset": at, "length": len(data)}))
            at += len(data)
            n += 1
    if archive is not None:
        member.close()
        archive.writestr(INDEX, "\n".join(lines))
        archive.close()
        if not sink.closed:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])


def central_directory(source: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Names of stored members with the offset of their data and their size, from the directory at the end of a ZIP."""
    size = source.size()
    tail_at = max(0, size - 65_557)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack("<H", tail[end + 10 : end + 12])[0], *struct.unpack("<II", tail[end + 12 : end + 20])
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = tail[end - 20 : end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = source.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        entries, length, start = struct.unpack("<QQQ", record[32:56])
    directory, at, out = source.read_at(length, start), 0, {}
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, names, extras, comments, local = (struct.unpack_from(kind, directory, at + where)[0] for kind, where in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        name = directory[at + 46 : at + 46 + names].decode("utf-8")
        extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: only the fields that do not fit are there, in this order
                wide, j = extra[k + 4 : k + 4 + n], 0
                if plain == 0xFFFFFFFF:
                    plain, j = struct.unpack_from("<Q", wide, j)[0], j + 8
                if packed == 0xFFFFFFFF:
                    packed, j = struct.unpack_from("<Q", wide, j)[0], j + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", wide, j)[0]
            k += 4 + n
        if method == 0:
            header = source.read_at(30, local)
            out[name] = (local + 30 + sum(struct.unpack("<HH", header[26:30])), plain)
        at += 46 + names + extras + comments
    return out


def _list(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The index of every archive: path, file offset and length of each record."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with fs.open_input_file(path) as source:
                members = central_directory(source)
                base = members[DATA][0]
                at, size = members[INDEX]
                rows = [json.loads(x) for x in source.read_at(size, at).decode("utf-8").splitlines()]
            for k in range(0, len(rows), 4096):
                some = rows[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([base + r["offset"] for r in some], pa.int64()), pa.array([r["length"] for r in some], pa.int64())], ["path", "offset", "length"])


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response's digest and size are those of the payload that was read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda x: int(x.rsplit(":", 1)[1].rstrip(">"))
    own = fields["WARC-Record-ID"]
    kind = fields["WARC-Type"]
    stated = fields["WARC-Payload-Digest"].split(":", 1)[1]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its record states")
    return {"page_id": None if own == "<urn:page:>" else page(own), "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None, "url": fields.get("WARC-Target-URI"), "payload": payload.decode("utf-8") if kind == "response" else None}


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    fs, _ = pafs.FileSystem.from_uri(folder)
    name, source = None, None
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.string()}
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part, found = batch.slice(k, 256), []
            for path, offset, length in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if path != name:
                    if source is not None:
                        source.close()
                    name, source = path, fs.open_input_file(path)
                row = parse_record(zlib.decompress(source.read_at(length, offset), 31))
                found.append(row if with_payload else row | {"payload": None})
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in kinds.items()], list(kinds))
    if source is not None:
        source.close()


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = 3) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) and return the manifest (path, records).

    Of records with equal payloads of at least `least` bytes the one with the smallest
    page_id is a response and the others revisit it. Null html is an empty payload. Each
    attempt of a task writes a file of its own; only those in the manifest count.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest: Column = F.sha1(F.encode("html", "UTF-8"))
    marks = rows.where(F.octet_length("html") >= least).select("page_id", digest.alias("digest"), F.octet_length("html").alias("bytes"))
    firsts = marks.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    refers = checkpoint(marks.join(firsts, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct())
    few = len(refers.limit(200_001).select(F.lit(1)).take(200_001)) <= 200_000
    out = rows.withColumn("digest", digest).join(F.broadcast(refers) if few else refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return checkpoint(out.mapInArrow(partial(_write, folder=folder, level=level), "path string, records long"))


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives of a manifest, each read by its own byte range."""
    ranges = manifest.select("path").mapInArrow(partial(_list, folder=folder), "path string, offset long, length long")
    return ranges.mapInArrow(partial(_read, folder=folder, with_payload=with_payload), _RECORDS)


def round_trip(pages: DataFrame, least: int = 0, with_payload: bool = False) -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back, record by record.

    Returns page_id, payload_bytes, payload_digest (bare base-32 SHA-1 of the full payload),
    record_type, refers_to, url, and payload (of responses, on request). Rows that repeat a
    page_id and payload are each written, all as responses if the page_id is the smallest.
    A row with a null page_id is a response, and no other record refers to it. Payloads of
    any size are written and read whole, one record at a time. An empty table gives an empty result.
    """
    root = shared_folder(pages.sparkSession)
    folder = f"{root.rstrip('/')}/archives-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return read_archives(write_archives(pages, folder, least), folder, with_payload)
