"""WARC archives (operator 4): a writer with revisit records and a sequential reader.

One gzip member per record.  The reader inflates incrementally, frames each block
by its Content-Length, and checks block and payload digests.  Archives live in
the shared folder and are opened through pyarrow's file systems, so local paths,
HDFS and object stores work alike from any executor.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import IdFilter, fresh, saved, scratch

#: Smaller payloads are always written in full.
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 16
#: A task starts another archive when its present one has grown to this.
MAX_ARCHIVE_BYTES = 1 << 30


def _b32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = 2) -> bytes:
    """One record as a gzip member.  With ``refers_to`` it is a revisit: its block
    is the HTTP head alone, which still states the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_b32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else "WARC-Target-URI: " + url)
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Members:
    """The inflated bytes of a file's gzip members, one member after another."""

    def __init__(self, stream) -> None:
        self.stream, self.rest = stream, b""

    def start(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        self.z, self.got = zlib.decompressobj(31), b""
        return bool(self.rest)

    def more(self) -> bool:
        """Inflate the next piece of this member; False at its end."""
        while not self.z.eof:
            data = self.rest or self.stream.read(READ_BYTES)
            if not data:
                raise ValueError("archive ends inside a record")
            out = self.z.decompress(data, READ_BYTES * 16)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                self.got += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        at = -1
        while (at := self.got.find(mark)) < 0:
            if not self.more():
                raise ValueError("record head without end")
        head, self.got = self.got[:at], self.got[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes, in pieces."""
        while n:
            if not self.got and not self.more():
                raise ValueError("record is shorter than its Content-Length")
            piece, self.got = self.got[:n], self.got[n:]
            n -= len(piece)
            yield piece


def read_records(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of an open archive, in order.

    Each is a dict of type, page_id, url, refers_to, payload_bytes, sha1 (hex,
    of the full payload) and, if asked for, payload (None for revisits).  A block
    that is shorter or longer than stated, or differs from a stated digest,
    raises ValueError.
    """
    m = _Members(stream)
    while m.start():
        lines = m.until(b"\r\n\r\n").decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        whole, body, kept, http, n = hashlib.sha1(), hashlib.sha1(), [], b"", 0
        in_body = False
        for piece in m.take(int(head["content-length"])):
            whole.update(piece)
            if not in_body:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                in_body, piece, http = True, http[at + 4 :], http[:at]
            body.update(piece)
            n += len(piece)
            if with_payload:
                kept.append(piece)
        if b"".join(m.take(4)) != b"\r\n\r\n" or m.got or m.more():
            raise ValueError("record is longer than its Content-Length")
        if head.get("warc-block-digest", _b32(whole.digest())) != _b32(whole.digest()):
            raise ValueError(f"block digest differs in {head['warc-record-id']}")
        kind, stated = head["warc-type"], head["warc-payload-digest"]
        if kind == "response":
            if stated != _b32(body.digest()):
                raise ValueError(f"payload digest differs in {head['warc-record-id']}")
        else:
            n = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        id_of = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
        yield {
            "record_type": kind,
            "page_id": id_of(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "refers_to": id_of(head.get("warc-refers-to")),
            "payload_bytes": n,
            "payload_digest": base64.b32decode(stated.removeprefix("sha1:")).hex(),
            "payload": b"".join(kept) if with_payload and kind == "response" else None,
        }


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, level: int = 2) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html, and refers_to:
    null, or the page that this one revisits) and return a saved table (path,
    n_records, n_bytes) of the archives.

    An attempt writes to names of its own, and the table lists those of the
    attempts that counted; what lost or repeated attempts wrote is in no list.
    """
    max_bytes = MAX_ARCHIVE_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at = [], None, None
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    files.append(at := [f"{folder}/{name}", 0, 0])
                data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py(), level)
                out.write(data)
                at[1] += 1
                at[2] += len(data)
                if at[2] >= max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files, strict=True)], ["path", "n_records", "n_bytes"])

    columns = pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"))
    return saved(columns.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-list")


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(archives: DataFrame, with_payload: bool = False, batch_rows: int = 1000) -> DataFrame:
    """The records of the archives in column ``path``, one task reading whole
    archives one after another.  ``payload`` (binary) is added if asked for."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _open(path)
                with system.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream, with_payload):
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if len(rows) >= batch_rows or size > 1 << 24:
                            yield pack()
                            rows, size = [], 0
        if rows:
            yield pack()

    n = max(1, min(archives.count(), 100_000))
    schema = FIELDS + (", payload binary" if with_payload else "")
    return archives.select("path").repartition(n).mapInArrow(read, schema)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: of pages with equal payloads
    of at least ``min_bytes`` bytes, the largest page_id for all but itself.

    Rows that share the largest page_id are all responses; a null page_id
    revisits the largest one there is, and if there is none, nothing.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    n, d, keep = fresh([*pages.columns, "refers_to"], "n", "d", "keep")
    keyed = pages.select("page_id", "url", "html", F.octet_length(payload).alias(n), F.sha1(payload).alias(d))
    groups = keyed.where(F.col(n) >= min_bytes).groupBy(d, n).agg(F.max("page_id").alias(keep), F.count("*").alias("k")).where("k > 1")
    # only payloads that occur again are shuffled; the written table lets the join be split at frequent ones
    groups = saved(groups.select(d, n, keep), "repeated-payloads")
    again = IdFilter(groups, d)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col(keep)), F.col(keep)).alias("refers_to")
    some = keyed.where(again.holds(d)).join(groups, [d, n], "left").select("page_id", "url", "html", refers)
    return keyed.where(~again.holds(d)).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(some)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.  Null html is an empty payload; an
    empty table writes nothing and gives no rows."""
    archives = write_archives(mark_revisits(pages), scratch(pages.sparkSession, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
