"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own, frames into bundles.
Behind its frames a bundle has the seek table of the seekable format: a skippable
frame (0x184D2A5E) with the compressed and decompressed size of every frame, their
number, and the magic number 0x8F92EAB1. An index maps record ids to a frame and the
offset in it, so one record costs one frame. Bundles are rows of a table in the shared
folder (any store Spark writes to); ``export`` puts them in .warc.zst files.

Of records with equal payloads of 1000 bytes or more, the one with the largest page_id
is the response and the others revisit it (rows that repeat with that page_id are all
responses). Null html is an empty payload; null ids are kept and never referred to
unless all ids of a payload are null. An empty table gives no bundle and no row. Other
columns are not read.

A record id is made of the row's place in the input, its page_id and digest, so rows that
repeat have ids of their own, a revisit can name its response's record wherever that is
written (WARC-Refers-To), and reruns agree as long as the files are split alike. Each
bundle begins with a warcinfo record, which the index leaves out; its name is a hash of
its record ids, so no two bundles share one. Where the groups of equal payloads outgrow a
broadcast, those that hold a 1024th of all rows still are one (1024 at most).
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import join_facts, materialize

LEAST = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NONE = uuid.UUID(int=0)
_BUNDLE = "bundle string, data binary, records array<struct<record_id string, frame int, offset int, length int>>"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_CRLF = b"\r\n"


def record_id(row_key: int, page_id, digest: str) -> str:
    return str(uuid.uuid5(_NONE, f"{row_key} {page_id} {digest}"))


def info_bytes(bundle: str) -> bytes:
    """The warcinfo record that a bundle begins with."""
    body = b"software: umbra\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NONE, bundle)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {bundle}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return _CRLF.join(x.encode() for x in lines) + _CRLF * 2 + body + _CRLF * 2


def record_bytes(record_id: str, page_id, url, kind: str, digest: str, size: int, payload: bytes, refers_to, refers_to_record=None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest and size."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to_record is not None:
            lines.append(f"WARC-Refers-To: <urn:uuid:{refers_to_record}>")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
        body = b""
    else:
        body = payload
    lines += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}"]
    return _CRLF.join(x.encode() for x in lines) + _CRLF * 2 + body + _CRLF * 2


def parse_records(data: bytes):
    """(offset, headers, body) of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(_CRLF * 2, at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        body = end + 4
        length = int(head["Content-Length"])
        if data[body + length : body + length + 4] != _CRLF * 2:
            raise ValueError("a record doesn't end where its length says")
        yield at, head, data[body : body + length]
        at = body + length + 4


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frame_bytes, self.frames, self.table, self.records = frame_bytes, [], [], []
        self.open, self.open_size, self.size = [], 0, 0

    def add(self, record_id: str, record: bytes):
        self.records.append((record_id, len(self.frames) + 1, self.open_size, len(record)))  # frame 0 is the warcinfo record's
        self.open.append(record)
        self.open_size += len(record)
        self.size += len(record)
        if self.open_size >= self.frame_bytes:
            self._frame()

    def _frame(self):
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.frames.append(packed)
            self.table.append((len(packed), self.open_size))
            self.open, self.open_size = [], 0

    def name(self) -> str:
        return hashlib.sha1("".join(x[0] for x in self.records).encode()).hexdigest()

    def finish(self) -> bytes:
        """The bundle, behind a frame of its own for the warcinfo record."""
        self._frame()
        info = info_bytes(self.name())
        packed = self.compressor.compress(info)
        table = [(len(packed), len(info)), *self.table]
        entries = b"".join(struct.pack("<II", *x) for x in table)
        footer = struct.pack("<IBI", len(table), 0, SEEKABLE)
        return packed + b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    start, out = 0, []
    for packed, full in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((start, packed, full))
        start += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    import zstandard

    start, packed, full = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=full)


def read_record(data: bytes, frame: int, offset: int, length: int) -> tuple[dict, bytes]:
    _, head, body = next(parse_records(read_frame(data, frame)[offset : offset + length]))
    return head, body


def _write(batches):
    writer = BundleWriter()

    def out():
        data = writer.finish()
        entries = [dict(zip(("record_id", "frame", "offset", "length"), x)) for x in writer.records]
        kinds = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
        return pa.record_batch([pa.array([writer.name()]), pa.array([data], pa.binary()), pa.array([entries], kinds)], names=["bundle", "data", "records"])

    for b in batches:
        for row_key, page_id, url, html, digest, size, kind, refers, refers_key in zip(*(b.column(i).to_pylist() for i in range(9))):
            own = record_id(row_key, page_id, digest)
            other = record_id(refers_key, refers, digest) if kind == "revisit" else None
            writer.add(own, record_bytes(own, page_id, url, kind, digest, size, (html or "").encode(), refers, other))
            if writer.size >= BUNDLE_BYTES:
                yield out()
                writer = BundleWriter()
    if writer.records:
        yield out()


def _read(batches):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    whole = lambda x: None if x is None else int(x)
    for b in batches:
        for data in b.column(0).to_pylist():
            for frame in range(len(seek_table(data))):
                rows = []
                for _, head, body in parse_records(read_frame(data, frame)):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest, size, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), head["WARC-Type"]
                    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError("a payload differs from its digest")
                    rows.append((whole(head.get("X-Page-ID")), size, digest, kind, whole(head.get("X-Refers-To-Page-ID")), head.get("WARC-Target-URI"), body))
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=[x.split()[0] for x in _READ.split(", ")])


def write_bundles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Bundles of all ``pages(page_id, url, html)`` as a table in the shared folder."""
    rows = pages.select(F.monotonically_increasing_id().alias("row_key"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    # groups are known before html moves, so that few of them need no shuffle of it
    large = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "row_key")).alias("top"), F.count("*").alias("n"))
    groups = materialize(large.where("n > 1").select("digest", F.col("top.page_id").alias("top"), F.col("top.row_key").alias("top_key"), "n"), "payloads")
    typed = join_facts(rows, groups, "digest", "n")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    typed = typed.select("row_key", "page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("top")).alias("refers_to"), F.when(revisit, F.col("top_key")).alias("refers_key"))
    return materialize(typed.mapInArrow(_write, _BUNDLE), "bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles, payloads checked against their digests."""
    return bundles.select("data").mapInArrow(_read, _READ)


def index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset (in the decompressed frame) and length."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def export(bundles: DataFrame, folder: str) -> int:
    """Writes each bundle to ``folder``/<bundle>.warc.zst on the driver, one at a time."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in bundles.select("bundle", "data").toLocalIterator():
        with open(f"{folder}/{row['bundle']}.warc.zst", "wb") as f:
            f.write(row["data"])
        n += 1
    return n
