"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each with some whole WARC/1.1 records, and a seek table in a
skippable frame at its end (the public seekable format: for each frame its compressed and decompressed size, then the
frame count, a descriptor byte and a magic number). An index row maps a record identifier to bundle, frame and offset
inside the decompressed frame, so that one record costs one range read and one frame.

Writing is a map: each task writes bundles of up to `bundle_bytes` in the shared folder under names of their own attempt,
and only bundles that the index table names count, so a lost or repeated task leaves no wrong records. Of equal payloads
of at least `least` bytes the smallest page_id is the response; the table of those groups is a partial aggregation over
digests, and no html moves for it. A bitmap of the revisits' page_ids then parts the pages: those that it excludes are written
where they are read, the others meet the revisits in a join.

Null html: an empty payload. Rows that repeat a page_id: each is a record; with equal payloads, all are the response, with
others each payload is decided on its own. Null page_id: a record without a number, read back as null; it never is the
response of others, nor a revisit. An empty table: no bundle. A very long html is one record in a frame of its own. Other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, materialize, release, shared_dir

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that pyarrow opens for a Hadoop style URI."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri.removeprefix("file:"))


class BundleWriter:
    """Writes records into frames of about frame_bytes."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held = io.BytesIO()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the decompressed frame) of the record."""
        if self.held.tell() and self.held.tell() + len(record) > self.frame_bytes:
            self._flush()
        where = len(self.frames), self.held.tell()
        self.held.write(record)
        return where

    def _flush(self) -> None:
        raw = self.held.getvalue()
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.size += len(packed)
        self.frames.append((len(packed), len(raw)))
        self.held = io.BytesIO()

    def close(self) -> None:
        if self.held.tell():
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(read, size: int) -> list[tuple[int, int]]:
    """(compressed offset, compressed size) of each frame; read(offset, length) reads the bundle of that size."""
    count, _, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    raw, at, out = read(size - 9 - 8 * count, 8 * count), 0, []
    for k in range(count):
        n, _ = struct.unpack_from("<II", raw, 8 * k)
        out.append((at, n))
        at += n
    return out


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A WARC record; a revisit has no block but keeps the full payload's digest and length."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and where the next begins."""
    end = raw.index(b"\r\n\r\n", at)
    first, *lines = raw[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines)
    n = int(head["Content-Length"])
    return head, raw[end + 4 : end + 4 + n], end + 4 + n + 4


def _page(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def response_of(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the revisits among pages(page_id, payload)."""
    # of page_id and digest alone: no payload is written
    brief = materialize(pages.where("page_id is not null").where(F.octet_length("payload") >= least).select("page_id", F.sha2(F.col("payload").cast("binary"), 256).alias("digest")), "digests")
    firsts = brief.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("digest", "refers_to")
    firsts = materialize(firsts, "firsts")
    return brief.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, where: str, least: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 64 << 20) -> DataFrame:
    """Writes pages(page_id, url, html) under `where`; returns the index (page_id, bundle, frame, offset)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    # a page_id may repeat with another payload, so the digest decides as well
    revisits = materialize(response_of(pages, least), "revisits")
    wanted = IdFilter(revisits, "page_id")
    digest = F.when(F.octet_length("payload") >= least, F.sha2(F.col("payload").cast("binary"), 256))
    placed = pages.withColumn("place", wanted.column("page_id"))

    def possible(batches):
        for b in batches:
            yield b.select(["page_id", "url", "payload"]).filter(pa.array(wanted.passes(b.column("place").to_numpy())))

    def others(batches):
        for b in batches:
            some = b.select(["page_id", "url", "payload"]).filter(pa.array(~wanted.passes(b.column("place").to_numpy())))
            yield some.append_column("refers_to", pa.nulls(some.num_rows, pa.int64()))

    moved = placed.mapInArrow(possible, "page_id long, url string, payload string").withColumn("digest", digest).join(revisits, ["page_id", "digest"], "left")

    def write(batches):
        fs = None
        writer = out = name = None
        for b in batches:
            if fs is None:
                fs, root = filesystem(where)
                fs.create_dir(root, recursive=True)
            ids, bundle, frame, offset = [], [], [], []
            for i, url, payload, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(out, frame_bytes)
                f, o = writer.add(record(i, url, payload.encode(), ref))
                ids.append(i)
                bundle.append(name)
                frame.append(f)
                offset.append(o)
                if writer.size >= bundle_bytes:
                    writer.close()
                    out.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bundle, pa.string()), pa.array(frame, pa.int32()), pa.array(offset, pa.int64())], names=["page_id", "bundle", "frame", "offset"])
        if writer is not None:
            writer.close()
            out.close()

    index = "page_id long, bundle string, frame int, offset long"
    stay = placed.mapInArrow(lambda batches: write(others(batches)), index)
    out = materialize(stay.unionByName(moved.select("page_id", "url", "payload", "refers_to").mapInArrow(write, index)), "warc-index")
    release(revisits)
    return out


def read_archives(index: DataFrame, where: str) -> DataFrame:
    """Records at the index's places: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def read(batches):
        fs = root = None
        last, table, frames, source = None, [], {}, None
        for b in batches:
            if fs is None:
                fs, root = filesystem(where)
            rows = []
            for name, f, offsets in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offsets")), strict=True):
                if name != last:
                    source = fs.open_input_file(f"{root}/{name}")
                    table = seek_table(lambda at, n, s=source: s.read_at(n, at), source.size())
                    last = name
                at, n = table[f]
                raw = zstandard.ZstdDecompressor().decompress(source.read_at(n, at))
                for o in offsets:
                    head, block, _ = parse(raw, o)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    ref = head.get("WARC-Refers-To")
                    if ref is None and (hashlib.sha256(block).hexdigest() != digest or len(block) != int(head["X-Payload-Length"])):
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    rows.append((_page(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, head["WARC-Type"], None if ref is None else _page(ref), head.get("WARC-Target-URI"), None if ref else block))
                if len(rows) >= 512:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    by_frame = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return by_frame.sortWithinPartitions("bundle", "frame").mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes archives under the shared folder and reads every record back."""
    where = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, where, least), where)
