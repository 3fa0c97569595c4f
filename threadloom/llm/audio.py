"""MPEG audio columns: write a payload into frames, resynchronise, verify, index.

Writing: an ID3v2.4 tag with the unpadded size, a Xing frame (variable-bitrate
table: frames, bytes, 100 seek points), then one MPEG-2 Layer III frame of 576
samples for each 576 payload bytes. A frame's CRC-16 covers its header and side
information; the payload bytes and their CRC-32 lie in the frame's ancillary
data, so the stored form is a valid (silent) stream and the payload is lossless.

Reading works on any MPEG-1/2/2.5 Layer I-III stream: tags at both ends are parsed,
frame headers are found again after junk (a header counts once the next frame
or the end of the audio follows where it says), checksums are verified, and
durations are exact rationals of samples over rate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.shared import map_arrow, map_text, slices

UNIT = 576
#: Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Our frames: MPEG-2 Layer III, CRC, 16 kHz, mono; 144 kbit/s (648 bytes) and, for the table, 48 kbit/s (216 bytes).
RATE = 16000
_DATA_HEAD = bytes([0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0])
_TABLE_HEAD = bytes([0xFF, 0xF2, 6 << 4 | 2 << 2, 0xC0])
_SIDE = bytes(9)
_BODY = 4 + 2 + len(_SIDE)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, initially all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(4096)
def header(head: bytes) -> dict | None:
    """Fields of a 4-byte frame header; None if it isn't one (free-format streams are not read)."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    bitrate, rate = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or head[3] & 3 == 2:
        return None
    first = version == 3
    bits, hertz, pad = BITRATES[first, layer][bitrate - 1] * 1000, RATES[version][rate], head[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    mono = head[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return {"size": size, "samples": samples, "rate": hertz, "side": side, "crc": not head[1] & 1, "layer": layer, "kind": (version, layer, hertz)}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _from_synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _frame(head: bytes, rest: bytes) -> bytes:
    size = header(head)["size"]
    out = head + crc16(head[2:4] + _SIDE).to_bytes(2, "big") + _SIDE + rest
    return out + bytes(size - len(out))


def padded(data: bytes) -> bytes:
    """data, followed by bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def encode(data: bytes) -> bytes:
    """The stored form of data."""
    body = padded(data)
    text = b"\x03payload_bytes\x00" + str(len(data)).encode()
    field = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _synchsafe(len(field)) + field
    n = len(body) // UNIT
    step = header(_DATA_HEAD)["size"]
    total = header(_TABLE_HEAD)["size"] + n * step
    toc = bytes(min(255, 256 * (header(_TABLE_HEAD)["size"] + (n * p // 100) * step) // total) for p in range(100))
    table = _frame(_TABLE_HEAD, b"Xing" + struct.pack(">III", 7, n, total) + toc)
    start = _DATA_HEAD + crc16(_DATA_HEAD[2:4] + _SIDE).to_bytes(2, "big") + _SIDE
    end = bytes(step - _BODY - UNIT - 4)
    parts = [tag, table]
    for at in range(0, len(body), UNIT):
        block = body[at : at + UNIT]
        parts += [start, block, zlib.crc32(block).to_bytes(4, "big"), end]
    return b"".join(parts)


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text fields of the ID3v2 tag, and where the rest begins and ends."""
    fields, begin, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        begin = min(end, 10 + _from_synchsafe(data[6:10]) + (10 if data[5] & 0x10 else 0))
        at = 10
        while at + 10 <= begin and data[at : at + 1].isalnum():
            raw = data[at + 4 : at + 8]
            size = _from_synchsafe(raw) if data[3] >= 4 else int.from_bytes(raw, "big")
            name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                fields[key] = value.rstrip("\0")
            at += 10 + size
    return fields, begin, end


def _old_tag(data: bytes, at: int, fields: dict[str, str]) -> None:
    """Adds the text fields of the ID3v1 tag at `at` that are not there yet."""
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
        if value := data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip():
            fields.setdefault(name, value)


def _table(frame: bytes, head: dict) -> dict | None:
    """The variable-bitrate table in a frame, if it has one; fields that would lie beyond the frame are missing."""
    at = 4 + 2 * head["crc"] + head["side"]
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        size, frames = struct.unpack_from(">II", frame, 46)
        return {"frames": frames, "bytes": size, "toc": b""}
    if frame[at : at + 4] not in (b"Xing", b"Info") or len(frame) < at + 8:
        return None
    flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
    got = {"frames": None, "bytes": None, "toc": b""}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            if at + 4 <= len(frame):
                got[name] = int.from_bytes(frame[at : at + 4], "big")
            at += 4
    if flags & 4 and at + 100 <= len(frame):
        got["toc"] = frame[at : at + 100]
    return got


def parse(data: bytes | None) -> dict:
    """Tags, table, exact duration, seek offsets, checksum counts and payload of a stream.

    Empty or null data has no frames. Junk between frames is skipped and counted;
    a payload block counts only if its CRC-32 holds. The last 128 bytes are an ID3v1
    tag if they begin with TAG and no frame reaches into them.
    """
    data = data or b""
    fields, at, end = _tags(data)
    tail = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    out = {"tags": fields, "table": None, "frames": 0, "samples": 0, "seconds": Fraction(0), "offsets": [], "crc_good": 0, "crc_bad": 0, "junk": 0, "bad_blocks": 0}
    blocks, locked, first = [], None, True
    while at + 4 <= end and at != tail:
        head = header(data[at : at + 4])
        fits = head and at + head["size"] <= end and (locked is None or head["kind"] == locked)
        if fits and (at + head["size"] in (tail, end) or header(data[at + head["size"] : at + head["size"] + 4])):
            locked, after = head["kind"], at + head["size"]
            if head["crc"] and head["layer"] == 3:
                covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head["side"]]
                good = crc16(covered) == int.from_bytes(data[at + 4 : at + 6], "big")
                out["crc_good" if good else "crc_bad"] += 1
            if first and (found := _table(data[at:after], head)):
                out["table"] = found
            else:
                out["frames"] += 1
                out["samples"] += head["samples"]
                out["offsets"].append(at)
                block = data[at + _BODY : at + _BODY + UNIT]
                if head["size"] >= _BODY + UNIT + 4:
                    if zlib.crc32(block) == int.from_bytes(data[at + _BODY + UNIT : at + _BODY + UNIT + 4], "big"):
                        blocks.append(block)
                    else:
                        out["bad_blocks"] += 1
            first, at = False, after
            if at > tail:
                tail = end  # a frame reaches into the last bytes, so they are no tag
            continue
        nxt = data.find(b"\xff", at + 1, tail)
        nxt = tail if nxt < 0 else nxt
        out["junk"] += nxt - at
        at = nxt
    if tail < end:
        _old_tag(data, tail, fields)
        end = tail
    out["junk"] += max(0, end - at) if at < end else 0
    if locked:
        out["seconds"] = Fraction(out["samples"], locked[2])
    out["payload"] = b"".join(blocks)
    return out


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, media) of every row of df: the text's UTF-8 in its stored form; null is empty.

    Null keys and repeated rows are kept; other columns are ignored whatever
    their names; an empty table gives no rows.
    """
    source = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        media = [encode((t or "").encode()) for t in part.column(1).to_pylist()]
        return pa.record_batch([part.column(0), pa.array(media, pa.binary())], names=["key", "media"])

    kind = source.schema["key"].dataType.simpleString()
    return map_text(source, run, f"key {kind}, media binary").withColumnRenamed("key", key)


def parse_column(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Rows with tags, exact duration (samples, rate), seek offsets, checksum results and payload of every stored form.

    Any bytes are read, see parse(); null keys and repeated rows are kept; other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    source = df.select(df[key].alias("key"), df[media].alias("media"))
    kind = source.schema["key"].dataType.simpleString()
    names = "frames samples crc_good crc_bad bad_blocks junk".split()

    def run(batches):
        for part in slices(batches, "media"):
            found = [parse(m) for m in part.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array([list(f["tags"].items()) for f in found], pa.map_(pa.string(), pa.string())),
                    *(pa.array([f[n] for f in found], pa.int64()) for n in names),
                    pa.array([f["seconds"].numerator for f in found], pa.int64()),
                    pa.array([f["seconds"].denominator for f in found], pa.int64()),
                    pa.array([f["offsets"] for f in found], pa.list_(pa.int64())),
                    pa.array([f["payload"] for f in found], pa.binary()),
                ],
                names=["key", "tags", *names, "seconds_num", "seconds_den", "offsets", "payload"],
            )

    schema = f"key {kind}, tags map<string,string>, {', '.join(n + ' long' for n in names)}, seconds_num long, seconds_den long, offsets array<long>, payload binary"
    return map_arrow(source, run, schema).withColumnRenamed("key", key)


def digests(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """What parse() reads back from every stored form, as digests.

    A null or empty stored form has no frames, and digests of the empty payload;
    null keys and repeated rows are kept; other columns are ignored whatever
    their names; an empty table gives no rows.
    """
    source = stored.select(stored[key].alias("key"), stored[media].alias("media"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "media"):
            rows = []
            for raw in part.column(1).to_pylist():
                got = parse(raw)
                body = got["payload"]
                seek = zlib.crc32(struct.pack(f">{len(got['offsets'])}Q", *got["offsets"]))
                feature = f"seconds={got['seconds']};frames={got['frames']};table={got['table']['frames'] if got['table'] else '-'};crc={got['crc_good']}/{got['crc_good'] + got['crc_bad']};bad={got['bad_blocks']};junk={got['junk']};seek={seek:08x}"
                rows.append((int(got["tags"].get("payload_bytes", 0)), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), feature))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(source, run, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERY = ("op4_mpeg_audio", query)
