"""WARC archives in the seekable Zstandard layout: independent frames of some records each, a seek table as footer.

A bundle is one file: frames (each a whole Zstandard frame), then a skippable frame that lists every frame's sizes.
A record is found by (bundle, frame, offset in the frame's plain bytes, length): its frame alone is read and unpacked.
Writers are Spark tasks; each attempt writes files of names of its own, and only the rows of the attempt that Spark
accepts name its files.  What lost and second attempts have left is removed when all are done, and a manifest lists the
bundles that count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialise, shared_folder
from skyloom.sources.shared import open_store

# Fixed values of the public seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
ENTRIES = "page_id long, record_type string, refers_to long, bundle string, frame int, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def clean(value: str | None) -> str:
    """One line: a line break would end the header."""
    return " ".join((value or "").split())


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record holds the payload; a revisit names the record that does, and the payload's length."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/octet-stream",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: (packed, plain) sizes.  Entries, then number of frames, descriptor 0 (no checksums) and magic."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class Bundle:
    """A file to read frames of, by its own seek table."""

    def __init__(self, uri: str) -> None:
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(n * width, size - 9 - n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def write_bundles(records: DataFrame, folder: str, *, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """records: page_id, url, payload binary, sha1 (hexadecimal), record_type, refers_to.  Returns the index."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=level)
        out = name = None
        written = 0
        frames: list[tuple[int, int]] = []
        index: list[tuple] = []
        plain = bytearray()

        def flush() -> None:
            nonlocal plain, written
            if plain:
                packed = packer.compress(bytes(plain))
                out.write(packed)
                written += len(packed)
                frames.append((len(packed), len(plain)))
                plain = bytearray()

        def close() -> pa.RecordBatch:
            nonlocal out
            flush()
            out.write(seek_table(frames))
            out.close()
            out = None
            cols = zip(*index, strict=True)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            names = ["page_id", "record_type", "refers_to", "bundle", "frame", "offset", "length"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in rows:
            for page, url, payload, sha1, kind, refers in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    frames, index, written = [], [], 0
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                revisit = kind.as_py() == "revisit"
                raw = warc_record(page.as_py(), url.as_py(), payload.as_py(), digest, refers.as_py(), revisit)
                if plain and len(plain) + len(raw) > frame_bytes:
                    flush()
                index.append((page.as_py(), kind.as_py(), refers.as_py(), f"{folder}/{name}", len(frames), len(plain), len(raw)))
                plain += raw
                if written > bundle_bytes:
                    yield close()
        if out is not None:
            yield close()

    return records.select("page_id", "url", "payload", "sha1", "record_type", "refers_to").mapInArrow(write, ENTRIES)


def read_records(index: DataFrame, *, task_bytes: int = 16 << 20, run: int = 8) -> DataFrame:
    """Read records back by their places: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Tasks take runs of ``run`` neighbouring frames, about ``task_bytes`` of records each.
    """

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = bundle = frame = None
        plain = b""
        for batch in rows:
            out = []
            for b, f, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != uri:
                    uri, bundle, frame = b, Bundle(b), None
                if f != frame:
                    frame, plain = f, bundle.frame(f)
                fields, body = parse_record(plain[offset : offset + length])
                kind = fields["WARC-Type"]
                page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(body) != said:
                    raise ValueError(f"record of page {page} is damaged")
                out.append((int(page) if page else None, fields["WARC-Target-URI"], kind, int(refers) if refers else None, int(fields["X-Payload-Length"]), said, body if kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            cols = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    places = index.select("bundle", "frame", "offset", "length")
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return (
        places.repartition(max(1, -(-int(total) // task_bytes)), "bundle", F.floor(F.col("frame") / run))
        .sortWithinPartitions("bundle", "frame", "offset")
        .mapInArrow(read, schema)
    )


def sweep(index: DataFrame, folder: str) -> None:
    """Removes the bundles that no row of the index names, and writes the manifest of the others."""
    spark = index.sparkSession
    named = index.select(F.element_at(F.split("bundle", "/"), -1).alias("name"), "frame")
    manifest = named.groupBy("name").agg(F.count("*").alias("records"), (F.max("frame") + 1).alias("frames"))
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    stray = there.join(spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest").select("name"), "name", "left_anti")

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in rows:
            for name in batch.column(0).to_pylist():
                if store.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                    store.delete_file(f"{base}/{name}")
            yield batch

    stray.mapInArrow(remove, "name string").count()


def archive_pages(
    pages: DataFrame, folder: str | None = None, *, salts: int = 16, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> tuple[DataFrame, str]:
    """Write one record per page and return (the index, the folder).

    Payload: the html's UTF-8 bytes, a null html being empty.  Of equal payloads the largest page_id is the response
    and all others revisit it, null page_ids too; rows that repeat both payload and page_id share one fate, and equal
    payloads without any page_id are all responses.  A payload longer than a frame is one frame of its own, however long.
    An empty table writes nothing.  Other columns are ignored.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc"
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1")
    )
    # Only repeated payloads are looked up, by salted digests: one payload may be a third of all pages.
    repeated = (
        rows.groupBy("sha1")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha1", "response", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    marked = salted.join(repeated, ["sha1", "salt"], "left").withColumn(
        "revisit", F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    )
    records = marked.select(
        "page_id",
        "url",
        "payload",
        "sha1",
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("revisit"), F.col("response")).alias("refers_to"),
    )
    index = materialise(write_bundles(records, folder, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes), "index")
    if not index.isEmpty():
        sweep(index, folder)
    return index, folder
