"""WARC archives: index first, then coalesced range reads.

Writing tasks put one gzip member per record into archive files in the shared folder and
return one index row per record: file, offset, length, URL, digest.  Reading selects
index rows, sorts them by place, joins neighbouring byte ranges into few large reads and
parses only the selected records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, create, filesystem, scratch, slices, stored
from .skew import with_totals

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Ranges closer than this are read together, up to so many bytes at once.
GAP, READ = 64 << 10, 8 << 20
#: Compressed bytes that a reading task is meant for.
TASK_BYTES = 8 << 20
#: Archive files are closed beyond this size.
FILE_BYTES = 1 << 30
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
_index = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_record = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_NOT_IN_HEADERS = re.compile(r"[\x00-\x20\x7F-\x9F]")


def _framed(kind: str, name: str, date: str, fields: list[str], content: str, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", *fields, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def information(name: str, date: str) -> bytes:
    """The record that opens a file."""
    return _framed("warcinfo", name, date, [], "application/warc-fields", b"software: docloom\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, name: str) -> bytes:
    """One record, not compressed.  Control characters of URLs are percent-encoded.  The
    page and the page that a revisit refers to have fields of their own, as page_ids may
    repeat or be null and record ids must not."""
    digest = hashlib.sha1(payload).digest()
    url = _NOT_IN_HEADERS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if page_id is not None:
        fields.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return _framed("revisit" if revisit else "response", name, date, fields, "application/http;msgtype=response", http if revisit else http + payload)


def _page(own: str | None) -> int | None:
    return None if own is None else int(own)


def parse(data: bytes) -> tuple:
    """(page_id, url, payload, payload bytes, hex digest, type, refers_to) of a record.  A
    revisit has no payload; its size is that of its HTTP header.  A wrong digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return _page(fields.get("WARC-Page-ID")), fields["WARC-Target-URI"], payload if kind == "response" else None, size, digest, kind, _page(fields.get("WARC-Refers-To-Page-ID"))


class Archive:
    """An archive file that is being written."""

    def __init__(self, folder: str, level: int, date: str):
        self.id, self.at = uuid.uuid4(), 0
        self.uri = f"{folder}/{self.id.hex}.warc.gz"
        self.out = create(self.uri)
        self.add(information(self.name(), date), level)

    def name(self) -> str:
        """The next record's id, of its file and place."""
        return f"<urn:uuid:{uuid.uuid5(self.id, str(self.at))}>"

    def add(self, data: bytes, level: int) -> tuple[int, int]:
        zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
        data, at = zipped.compress(data) + zipped.flush(), self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)


def write_archives(pages: DataFrame, folder: str, level: int = 4, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the index, a
    stored table.

    Among equal payloads of at least 1000 bytes the largest page_id is the response and
    the others revisit it.  Null html is an empty payload, null URLs are empty, a null
    page_id is never a revisit's target unless all have none; of repeated page_ids in
    such a group one row is the response.  An empty table gives an empty index.  Files of
    retried tasks are not in the index.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= REVISIT_BYTES
    own = pages.where(large).select("page_id", digest.alias("digest"))
    # narrow rows, dealt by salt as one payload may be very frequent; then by page_id
    revisits = with_totals(own, "digest", "page_id", target=("max", "page_id")).where("page_id < target").groupBy("page_id").agg(F.max("target").alias("target"))
    rows = pages.select("page_id", "url", "html").join(revisits, "page_id", "left")

    def write(batches):
        archive = None
        for batch in slices(batches, 1024):
            out = [[] for _ in _index.names]
            for page, url, html, target in zip(*(batch.column(f).to_pylist() for f in ("page_id", "url", "html", "target"))):
                payload = (html or "").encode()
                revisit = target is not None and len(payload) >= REVISIT_BYTES
                if archive is None or archive.at > FILE_BYTES:
                    if archive:
                        archive.out.close()
                    archive = Archive(folder, level, date)
                place = archive.add(record(page, url, payload, target, revisit, date, archive.name()), level)
                for x, v in zip(out, (page, url, hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", archive.uri, *place)):
                    x.append(v)
            yield batch_of(_index, out)
        if archive:
            archive.out.close()

    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def coalesce(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges joined into (offset, length, parts) to be read at
    once; a range of its own may be longer than ``READ``."""
    out: list = []
    for at, n in ranges:
        if out and at - (out[-1][0] + out[-1][1]) <= GAP and at + n - out[-1][0] <= READ:
            out[-1][1] = max(out[-1][1], at + n - out[-1][0])
            out[-1][2].append((at, n))
        else:
            out.append([at, n, [(at, n)]])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, parsed and checked against their digests."""

    def read(batches):
        name, file = None, None
        for batch in slices(batches, 4096):
            rows = sorted(zip(*(batch.column(f).to_pylist() for f in ("file", "offset", "length"))))
            for uri in dict.fromkeys(x[0] for x in rows):
                if uri != name:
                    if file:
                        file.close()
                    files, path = filesystem(uri)
                    name, file = uri, files.open_input_file(path)
                for at, n, parts in coalesce([x[1:] for x in rows if x[0] == uri]):
                    file.seek(at)
                    data = file.read(n)
                    found = [parse(zlib.decompress(data[a - at : a - at + m], 31)) for a, m in parts]
                    if not payloads:
                        found = [(*x[:2], None, *x[3:]) for x in found]
                    yield batch_of(_record, list(map(list, zip(*found))))
        if file:
            file.close()

    # the index is small beside what it points to: tasks are counted by the archives' bytes
    tasks = int((index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES) + 1
    block = F.floor(F.col("offset") / F.lit(TASK_BYTES))
    places = index.select("file", "offset", "length").repartition(tasks, "file", block).sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, RECORD)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    from .common import table

    index = write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
