"""Legacy archives: ARC 1 and 2 to WARC, written and read back.

The converter parses an ARC stream by its version block (whose field line
differs between versions) and by each record's declared length, then
synthesises what WARC wants and ARC lacks: record ids (UUID 5 of target,
date and digest), ISO timestamps, record types, block and payload digests.

Equal payloads are found by a narrow aggregation on the digest.  A bounded
bitmap of the repeated digests splits the rows inside the scan; only rows with
a possible twin meet the exact join.  Tasks write archive files straight into
the shared folder and return a manifest; only files in the manifest exist for
readers, so the files of a lost or repeated task attempt are never read.

Defined results: a null payload is empty; a null id or URL is written as such
and read back as null; rows that repeat the largest id of their payload are all
responses; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, chunks, discard, materialize, scratch_path, utf8_list

# Field lines of the two ARC versions.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:panelweave:arc-to-warc")
_BATCH_BYTES = 8 << 20
#: Bytes (compressed) after which a task starts its next file.
FILE_BYTES = 64 << 20
_READ = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --------------------------------------------------------------------------- #
# ARC
# --------------------------------------------------------------------------- #
@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes


def write_arc(records: list[dict], version: int, name: str, date: str) -> bytes:
    """An ARC file; each record has url, ip, date, type and body (bytes)."""
    block = f"{version} {0 if version == 1 else 1} panelweave\n{' '.join(FIELDS[version])}\n\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    out = io.BytesIO()

    def put(fields: dict[str, str], body: bytes) -> None:
        known = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(out.tell()), "Filename": name, "Archive-length": str(len(body))} | fields
        out.write(" ".join(known[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n")

    put(head, block)
    for r in records:
        put({"URL": r["url"], "IP-address": r.get("ip", "0.0.0.0"), "Archive-date": r["date"], "Content-type": r["type"]}, r["body"])
    return out.getvalue()


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC stream, the version block first.

    A header line is split from the right: only the URL may hold spaces.  The
    body is as long as declared, whatever it contains.
    """
    version = None
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\n", b"\r\n"):
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if version is None:
            length = int(text.rsplit(" ", 1)[-1])
            body = stream.read(length)
            version = int(body.split(None, 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            parts = text.rsplit(" ", 4)  # the version block has the short line in both versions
            if version == 2 and len(text.split(" ")) >= len(FIELDS[2]):
                parts = text.rsplit(" ", len(FIELDS[2]) - 1)
                yield ArcRecord(version, dict(zip(FIELDS[2], parts, strict=True)), body)
                continue
            yield ArcRecord(version, dict(zip(FIELDS[1], parts, strict=True)), body)
            continue
        names = FIELDS[version]
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"an ARC {version} header line has {len(parts)} fields")
        fields = dict(zip(names, parts, strict=True))
        length = int(fields["Archive-length"])
        body = stream.read(length)
        if len(body) != length:
            raise ValueError("an ARC record is shorter than declared")
        yield ArcRecord(version, fields, body)


# --------------------------------------------------------------------------- #
# WARC
# --------------------------------------------------------------------------- #
@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""

    def http(self) -> tuple[bytes, bytes]:
        """(HTTP head with its blank line, payload); no head outside HTTP."""
        if not self.headers.get("Content-Type", "").startswith("application/http"):
            return b"", self.block
        head, sep, payload = self.block.partition(b"\r\n\r\n")
        return head + sep, payload


def iso_date(stamp: str) -> str:
    """ARC's 14 digits (shorter: zero-filled fields) as a WARC date."""
    d = re.sub(r"\D", "", stamp)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(uri: str, date: str, digest: str, place: str = "") -> str:
    """``place`` (a file and a number in it) tells records apart that are equal in all else."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{uri} {date} {digest} {place}'.rstrip())}>"


def arc_to_warc(record: ArcRecord, place: str = "") -> WarcRecord:
    """The WARC record that says the same; ``place`` as in :func:`record_id`."""
    f = record.fields
    uri, date = f["URL"], iso_date(f["Archive-date"])
    if uri.startswith("filedesc:"):
        block = f"software: panelweave\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC {record.version}\r\n".encode()
        kind, ctype, payload, filename = "warcinfo", "application/warc-fields", block, uri[len("filedesc://") :]
    else:
        block, filename = record.body, None
        if block.startswith(b"HTTP/"):
            kind, ctype = "response", "application/http; msgtype=response"
            payload = block.partition(b"\r\n\r\n")[2]
        else:
            kind = "response" if uri.startswith("dns:") else "resource"
            ctype, payload = f["Content-type"] or "application/octet-stream", block
    digest = base32_sha1(payload)
    h = {"WARC-Type": kind, "WARC-Record-ID": record_id(uri, date, digest, place), "WARC-Date": date}
    if filename is None:
        h |= {"WARC-Target-URI": uri, "WARC-IP-Address": f["IP-address"], "WARC-Payload-Digest": f"sha1:{digest}"}
    else:
        h["WARC-Filename"] = filename
    h |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": ctype, "Content-Length": str(len(block))}
    return WarcRecord(h, block)


def as_revisit(record: WarcRecord, uri: str, date: str) -> WarcRecord:
    """``record`` without its payload, referring to the response at ``uri`` of ``date``.

    The response is named by its URI and date; its id depends on its place in
    a file that another task writes.
    """
    head, _ = record.http()
    h = record.headers | {
        "WARC-Type": "revisit",
        "WARC-Profile": REVISIT_PROFILE,
        "WARC-Refers-To-Target-URI": uri,
        "WARC-Refers-To-Date": date,
        "WARC-Block-Digest": f"sha1:{base32_sha1(head)}",
        "Content-Length": str(len(head)),
    }
    return WarcRecord(h, head)


def warc_bytes(record: WarcRecord) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in record.headers.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogateescape") + record.block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Gunzip(io.RawIOBase):
    """Reads a stream of gzip members, in bounded memory."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.ready, self.rest = raw, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.ready:
            data = self.rest or self.raw.read(_READ)
            if not data:
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.ready = self.z.decompress(data, _READ)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        n = min(len(b), len(self.ready))
        b[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def read_warc(raw: BinaryIO, gz: bool = True) -> Iterator[WarcRecord]:
    """Records of a WARC stream, one in memory at a time."""
    stream = io.BufferedReader(_Gunzip(raw), _READ) if gz else raw
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record has no version line")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(":")
            headers[k] = v.strip()
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a WARC record is shorter than declared")
        yield WarcRecord(headers, block)


# --------------------------------------------------------------------------- #
# tables to archives and back
# --------------------------------------------------------------------------- #
def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def page_uri(page_id, url) -> str:
    """Target of a page: its id, then its URL, both reversible."""
    return f"urn:page:{'' if page_id is None else page_id}:{'' if url is None else 'u' + urllib.parse.quote(url, safe='/:?=&')}"


def url_of(uri: str) -> str | None:
    """The URL that :func:`page_uri` was given."""
    part = uri.split(":", 3)[3]
    return urllib.parse.unquote(part[1:]) if part else None


def page_of(uri: str) -> int | None:
    part = uri.split(":", 3)[2]
    return int(part) if part else None


def _http_body(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def _writer(folder: str, file_bytes: int):
    """Task: rows -> ARC segments -> WARC files; returns the manifest's rows.

    Of each batch every second row goes into an ARC file of either version.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, path, records, size = None, None, 0, 0
        done = []

        def converted() -> Iterator[tuple[ArcRecord, tuple | None]]:
            """ARC records, and for a revisit its response's id, URL and date."""
            for big in batches:
                for b in chunks(big, "html", _BATCH_BYTES):
                    rows = list(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "date", "ref_id", "ref_url", "ref_date", "revisit")), utf8_list(b.column("html")), strict=True))
                    for version in FIELDS:
                        own = rows[version - 1 :: len(FIELDS)]
                        if own:
                            segment = [{"url": page_uri(r[0], r[1]), "date": r[2], "type": "text/html", "body": _http_body(r[7])} for r in own]
                            arc = read_arc(io.BytesIO(write_arc(segment, version, f"pages-{version}.arc", own[0][2])))
                            yield next(arc), None
                            yield from ((record, r[3:6] if r[6] else None) for record, r in zip(arc, own, strict=True))

        for arc, ref in converted():
            info = arc.fields["URL"].startswith("filedesc:")
            if out is None:
                name = uuid.uuid4().hex
                path = f"{folder}/{name}.warc.gz"
                out = fs.open_output_stream(_filesystem(path)[1], compression=None)
                size, members = 0, 0
            record = arc_to_warc(arc, f"{name} {members}")
            if ref is not None:
                record = as_revisit(record, page_uri(ref[0], ref[1]), iso_date(ref[2]))
            data = gzip_member(warc_bytes(record))
            out.write(data)
            size, members, records = size + len(data), members + 1, records + (not info)
            if size >= file_bytes and not info:
                out.close()
                done.append((path, records, size))
                out, records = None, 0
        if out is not None:
            out.close()
            done.append((path, records, size))
        cols = zip(*done, strict=True) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, min_revisit_bytes: int = 0, date: Column | str = "20000101000000", file_bytes: int = FILE_BYTES, filter_bits: int | None = None) -> DataFrame:
    """Writes one WARC record a row; returns the manifest (path, records, bytes).

    Of records with equal payloads of at least ``min_revisit_bytes``, the one
    with the largest id is a response and the others revisit it.  ``date`` is
    the time of retrieval as ARC writes it, for all rows or a column (null: 1970).
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    when = F.lit(date) if isinstance(date, str) else F.coalesce(date, F.lit("19700101000000"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), when.alias("date"), F.coalesce(F.col(payload), F.lit("")).alias("html")
    ).withColumn("key", F.sha1("html"))
    long_enough = rows.where(F.octet_length("html") >= min_revisit_bytes)
    groups = long_enough.groupBy("key").agg(F.max(F.struct("page_id", "url", "date")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("key", F.col("top.page_id").alias("ref_id"), F.col("top.url").alias("ref_url"), F.col("top.date").alias("ref_date"))
    groups = materialize(groups, "warc-twins", reduced=True)
    flagged = HashFilter(groups, "key", filter_bits).flag(rows, "key", "may")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ref_id", "long"), ("ref_url", "string"), ("ref_date", "string"))]
    alone = flagged.where(~F.col("may")).select("page_id", "url", "date", "html", *none, F.lit(False).alias("revisit"))
    differs = F.col("ref_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("ref_id")) & (F.octet_length("html") >= min_revisit_bytes)
    paired = flagged.where("may").join(groups, "key", "left")
    paired = paired.select("page_id", "url", "date", "html", "ref_id", "ref_url", "ref_date", F.coalesce(differs, F.lit(False)).alias("revisit"))
    manifest = alone.unionByName(paired).mapInArrow(_writer(folder, file_bytes), "path string, records bigint, bytes bigint")
    out = materialize(manifest, "warc-manifest")
    discard(groups)
    return out


RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, target_uri string, warc_date string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row a response or revisit record of the manifest's files.

    Digests of stored payloads are computed again and compared, and each file's
    records are counted against the manifest, so that a file cut off between
    two records is an error; a revisit's length is the one its HTTP head declares.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows_of(path: str) -> Iterator[tuple]:
        fs, root = _filesystem(path)
        with fs.open_input_stream(root, compression=None) as raw:
            for r in read_warc(raw):
                h = r.headers
                if h["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, payload = r.http()
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if base32_sha1(r.block) != h["WARC-Block-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"{path}: a block does not have its digest")
                ref = None
                if h["WARC-Type"] == "revisit":
                    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", head)[1])
                    ref = page_of(h["WARC-Refers-To-Target-URI"])
                else:
                    size = len(payload)
                    if base32_sha1(payload) != digest:
                        raise ValueError(f"{path}: a payload does not have its digest")
                yield page_of(h["WARC-Target-URI"]), size, digest, h["WARC-Type"], ref, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                found = 0
                for row in rows_of(path):
                    found += 1
                    done.append(row)
                    if len(done) >= 10000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                        done = []
                if found != records:
                    raise ValueError(f"{path} has {found} records, not {records} as its manifest says")
        cols = zip(*done, strict=True) if done else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    # an explicit width: the rows are tiny, so adaptive execution would put all files in one task
    width = max(1, manifest.count())
    return manifest.select("path", "records").repartition(width, "path").mapInArrow(run, RECORDS)
