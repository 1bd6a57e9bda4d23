"""WARC archives as seekable Zstandard bundles.

A bundle holds the records of one batch of pages. Groups of records are compressed as
independent frames; after them comes a skippable frame with the seek table of the public
seekable format (for each frame its compressed and full size), so a reader with any
one record's frame and offset decompresses that frame alone. The index maps each
record id to (bundle, frame, offset in the frame, length).

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the smallest
id is a response and the others are revisits that refer to it. Which those are is settled
on a table of digests alone, before any page is written; pages join it by id.

Bundles and index are rows of tables that Spark's own writer commits, so they
work on any store, and a task that is run again replaces what the lost one wrote.
``export`` copies bundles out as files.

Defined cases: a null or empty html is an empty payload, always a response; repeated
ids are kept as records of their own: of equal payloads under the smallest id the rows with
the smallest url are responses and the others revisit that id; a null url is written as an
empty target; a null id is written as an empty id and never referred to while there is
another; an empty table gives no bundles.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from fathomline.scratch import Scratch

REVISIT_BYTES = 100
#: Full bytes of a frame and of a bundle from which the next one begins.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CRLF = "\r\n"


# ---- one record -------------------------------------------------------------------


def record_bytes(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload of its own."""
    body = b"" if refers_to is not None else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{record_id}>",
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(lines).encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one decompressed frame: header fields, offset, length, payload and its stated size."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines if ": " in line) | {line[:-1]: "" for line in lines if line.endswith(":")}
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
        until = end + 4 + size + 4
        yield {"fields": fields, "offset": at, "length": until - at, "payload": payload, "payload_bytes": stated}
        at = until


# ---- one bundle -------------------------------------------------------------------


class BundleWriter:
    """Collects records into frames; ``close`` gives the bundle with its seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.pending_size = self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its offset there."""
        place = len(self.frames), self.pending_size
        self.pending.append(record)
        self.pending_size += len(record)
        self.total += len(record)
        if self.pending_size >= self.frame_bytes:
            self._cut()
        return place

    def _cut(self) -> None:
        if self.pending:
            frame = self.packer.compress(b"".join(self.pending))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.pending_size))
            self.pending, self.pending_size = [], 0

    def close(self) -> bytes:
        self._cut()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class BundleReader:
    """Reads frames of a bundle by its footer."""

    def __init__(self, bundle: bytes):
        self.bundle = bundle
        count, flags, magic = struct.unpack("<IBI", bundle[-9:])
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("no seek table at the end of the bundle")
        table = bundle[len(bundle) - 9 - 8 * count : len(bundle) - 9]
        self.offsets, self.sizes = [0], []
        for packed, full in struct.iter_unpack("<II", table):
            self.offsets.append(self.offsets[-1] + packed)
            self.sizes.append(full)
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> bytes:
        return self.unpacker.decompress(self.bundle[self.offsets[k] : self.offsets[k + 1]], max_output_size=self.sizes[k])

    def record(self, frame: int, offset: int, length: int) -> dict:
        return next(parse_records(self.frame(frame)[offset : offset + length]))


# ---- tables -----------------------------------------------------------------------

BUNDLE = StructType(
    [
        StructField("bundle_id", StringType()),
        StructField("bundle", BinaryType()),
        StructField("record_id", StringType()),
        StructField("frame", IntegerType()),
        StructField("offset", LongType()),
        StructField("length", LongType()),
    ]
)


def revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """The records that revisit another: page_id, url_hash and html digest, with refers_to. Only digests are shuffled."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).filter(F.col("size") >= least)
    key = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    first = rows.groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first, "digest").select("page_id", "url", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("first_url"))


def _plan(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """Every page as (page_id, url, html, refers_to); refers_to is null for responses."""
    again = revisits(pages, page_id, url, html, least)
    # rows with the first's id and url are responses, however often they are repeated
    again = again.filter(~(F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("url") == F.col("first_url"))))
    again = again.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("digest").alias("d"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")).alias("refers_to")).distinct()
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_bundles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """One row for each bundle (bundle set) and one for each record in it (bundle null): the archive and its index."""
    planned = _plan(pages, page_id, url, html, least)
    arrow = to_arrow_schema(BUNDLE)

    def run(batches):
        writer, index, digest = BundleWriter(frame_bytes), [], hashlib.sha256()

        def flush():
            bundle = writer.close()
            name = digest.hexdigest()[:32]
            rows = [{"bundle_id": name, "bundle": bundle}, *({"bundle_id": name, "record_id": r, "frame": f, "offset": o, "length": n} for r, f, o, n in index)]
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            for pid, address, text, sha, refers in zip(*(batch.column(i) for i in range(5))):
                record_id = "" if pid.as_py() is None else str(pid.as_py())
                record = record_bytes(record_id, address.as_py(), text.as_py().encode(), sha.as_py(), refers.as_py())
                frame, offset = writer.add(record)
                digest.update(record)
                index.append((record_id, frame, offset, len(record)))
                if writer.total >= bundle_bytes:
                    yield flush()
                    writer, index, digest = BundleWriter(frame_bytes), [], hashlib.sha256()
        if index:
            yield flush()

    return planned.mapInArrow(run, BUNDLE)


RECORD = StructType(
    [
        StructField("bundle_id", StringType()),
        StructField("record_id", StringType()),
        StructField("url", StringType()),
        StructField("record_type", StringType()),
        StructField("refers_to", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("payload", BinaryType()),
    ]
)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, from their frames. Digests of responses are computed anew and must match the header."""
    arrow = to_arrow_schema(RECORD)
    bare = lambda urn: urn[len("<urn:page:") : -1]

    def run(batches):
        for batch in batches:
            for name, bundle in zip(batch.column(0), batch.column(1)):
                reader = BundleReader(bundle.as_py())
                for k in range(len(reader)):
                    rows = []
                    for r in parse_records(reader.frame(k)):
                        f = r["fields"]
                        digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                        if f["WARC-Type"] == "response" and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["payload_bytes"]):
                            raise ValueError(f"damaged record {f['WARC-Record-ID']}")
                        refers = f.get("WARC-Refers-To")
                        rows.append({"bundle_id": name.as_py(), "record_id": bare(f["WARC-Record-ID"]), "url": f["WARC-Target-URI"], "record_type": f["WARC-Type"], "refers_to": refers and bare(refers), "payload_bytes": r["payload_bytes"], "payload_digest": digest, "payload": r["payload"] if payloads and f["WARC-Type"] == "response" else None})
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return bundles.filter("bundle IS NOT NULL").select("bundle_id", "bundle").mapInArrow(run, RECORD)


def archive(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Writes the bundles to the shared folder and returns the table of bundles and index."""
    return Scratch(spark, "warc").save(write_bundles(pages, **columns), "bundles")


def fetch(bundles: DataFrame, record_ids: list[str]) -> dict[str, dict]:
    """Single records by the index: each costs one frame. For a few ids."""
    index = bundles.filter(F.col("record_id").isin(record_ids)).collect()
    names = sorted({r["bundle_id"] for r in index})
    held = {r["bundle_id"]: BundleReader(bytes(r["bundle"])) for r in bundles.filter("bundle IS NOT NULL").filter(F.col("bundle_id").isin(names)).collect()}
    return {r["record_id"]: held[r["bundle_id"]].record(r["frame"], r["offset"], r["length"]) for r in index}


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Copies each bundle to ``folder``/<bundle_id>.warc.zst, a folder that all executors mount; returns bundle_id and bytes."""
    schema = StructType([StructField("bundle_id", StringType()), StructField("bytes", LongType())])

    def run(batches):
        for batch in batches:
            for name, bundle in zip(batch.column(0).to_pylist(), batch.column(1)):
                path, data = f"{folder}/{name}.warc.zst", bundle.as_py()
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                yield pa.RecordBatch.from_pylist([{"bundle_id": name, "bytes": len(data)}], schema=to_arrow_schema(schema))

    return bundles.filter("bundle IS NOT NULL").select("bundle_id", "bundle").mapInArrow(run, schema)
