"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole
records, then a skippable frame with the record index (record id, frame, offset inside the
frame's content, length), then the seek table of the seekable format (a
skippable frame: sizes of every frame, and a footer that tells where it begins).
So one record is read with three ranged reads: the footer, the tables, one frame.

Equal payloads (by SHA-1 and length) are stored once: the record with the largest page id is
the response, the others are revisits that name it.

Executors write bundles under names of their own attempt; only names that a
finished task returned are ever read, so repeated and lost tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import map_arrow, materialize, new_path, slices

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEAST_PAYLOAD = 0
DATE = "2024-01-01T00:00:00Z"
_SKIP_SEEK, _SKIP_INDEX = 0x184D2A5E, 0x184D2A50
_SEEK_MAGIC = 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest}"


def page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return int(page) if page else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of the record refers_to."""
    digest = base32_sha1(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split("\r")).replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    block = _HTTP % len(payload) + (b"" if refers_to else payload)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at a position."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record here")
    heads = dict(line.split(": ", 1) for line in lines[1:])
    size = int(heads["Content-Length"])
    block = data[stop + 4 : stop + 4 + size]
    return heads, block[block.index(b"\r\n\r\n") + 4 :], stop + 4 + size + 4


class BundleWriter:
    """Collects records into frames of a bundle; finish() gives its bytes' end."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, name: str, data: bytes) -> None:
        if self.held and self.size + len(data) > self.frame_bytes:
            self.close_frame()
        self.index.append((name, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def close_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.written += len(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def finish(self) -> None:
        self.close_frame()
        body = self.packer.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", _SKIP_INDEX, len(body)) + body)
        # the index frame is listed too, with no content, so that sizes add up to its end
        entries = [*self.frames, (8 + len(body), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _SKIP_SEEK, len(table)) + table)


class BundleReader:
    """Reads a bundle through an object with size, seek and read."""

    def __init__(self, source, size: int):
        self.source = source
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        raw = self._at(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, content = struct.unpack_from("<II", raw, 8 * i)
            self.frames.append((at, packed, content))
            at += packed
        place, packed, _ = self.frames.pop()
        self.index = [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(self._at(place + 8, packed - 8)))]

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, i: int) -> bytes:
        at, packed, content = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self._at(at, packed), max_output_size=content)

    def record(self, name: str) -> bytes:
        """The first record with an id, from its frame alone."""
        _, i, offset, size = next(x for x in self.index if x[0] == name)
        return self.frame(i)[offset : offset + size]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Rows (page_id, sha, len, response) of the records that revisit another one, each once.

    Of the rows with equal payloads of at least `least` bytes, response is the
    largest page id. Only ids and digests are moved, never payloads.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("len")).filter(F.col("len") >= least)
    rows = materialize(rows.distinct(), "digests")
    # written first, so that both sides of the join are plain exchanges and a hot payload is split
    last = materialize(rows.groupBy("sha", "len").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n"), "payloads")
    return rows.join(last, ["sha", "len"]).filter(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")))


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write every row (page_id, url, html) as one record; rows (path, size, records) of the bundles.

    Null html is empty, a null url is left out, a null page id has an empty place
    in the record id. Rows that share the largest page id of their payload are
    all responses. Other columns are ignored; an empty table writes nothing.
    Pages are moved only if the table of revisits is too large to send to every
    task, which Spark decides by its size; then they are dealt by page id and
    payload together, so copies of one payload are spread.
    """
    known = materialize(revisits(pages, least), "revisits")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("len"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = rows.withColumn("page", page).join(known.select(page.alias("page"), "sha", "len", "response"), ["page", "sha", "len"], "left").select("page_id", "url", "html", "response")

    def run(batches):
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        writer = None

        def close():
            writer.finish()
            writer.out.close()
            return pa.record_batch([[writer.path], [files.get_file_info(f"{root}/{writer.path}").size], [len(writer.index)]], names=["path", "size", "records"])

        for part in slices(batches, "html"):
            for page, url, html, response in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(files.open_output_stream(f"{root}/{name}", compression=None))
                    writer.path = name
                body = (html or "").encode()
                digest = base32_sha1(body)
                refers = None if response is None else record_id(response, digest)
                writer.add(record_id(page, digest), record(page, url, body, refers))
                if writer.written >= BUNDLE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return map_arrow(rows, run, "path string, size long, records long")


def read_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Rows of all records of the listed bundles, with digests of verified payloads.

    A response whose payload does not match its digest raises. Payloads may be
    empty or longer than a frame; repeated records are repeated rows; bundles
    without records and an empty list give no rows; other columns are ignored.
    """

    def run(batches):
        files, root = _filesystem(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{root}/{path}") as source:
                    reader = BundleReader(source, size)
                    for i in range(len(reader.frames)):
                        data, at, out = reader.frame(i), 0, []
                        while at < len(data):
                            heads, payload, at = read_record(data, at)
                            digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
                            kind = heads["WARC-Type"]
                            if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(heads["X-Payload-Length"])):
                                raise ValueError(f"payload of {heads['WARC-Record-ID']} in {path} is damaged")
                            refers = heads.get("WARC-Refers-To")
                            out.append((page_of(heads["WARC-Record-ID"].strip("<>")), int(heads["X-Payload-Length"]), digest, kind, page_of(refers.strip("<>")) if refers else None))
                        cols = list(zip(*out, strict=True))
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return map_arrow(bundles, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_path(spark, "warc")
    bundles = materialize(write_bundles(pages, folder), "bundles")
    return read_bundles(bundles.select("path", "size").repartition(max(1, spark.sparkContext.defaultParallelism)), folder)


QUERY = ("op9_warc_bundles", query)

ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d, LATERAL (
  SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || '0' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1), '' ORDER BY i) AS payload_digest
  FROM range(32) t(i)) b
"""
