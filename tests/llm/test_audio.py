import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from threadloom.llm import audio as A


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000])
def test_payload_round_trip(size):
    data = random.Random(size).randbytes(size)
    got = A.parse(A.encode(data))
    assert got["payload"] == A.padded(data) and len(got["payload"]) % 576 == 0 and len(got["payload"]) > 0
    n = len(got["payload"]) // 576
    assert got["frames"] == got["table"]["frames"] == n and got["samples"] == 576 * n and got["seconds"] == Fraction(576 * n, 16000)
    assert (got["crc_good"], got["crc_bad"], got["bad_blocks"], got["junk"]) == (n + 1, 0, 0, 0)
    assert int(got["tags"]["payload_bytes"]) == size
    raw = A.encode(data)
    assert all(A.header(raw[o : o + 4]) for o in got["offsets"]) and [b - a for a, b in zip(got["offsets"], got["offsets"][1:])] == [648] * (n - 1)
    assert got["table"]["bytes"] == len(raw) - (got["offsets"][0] - 216)


def test_sync_bytes_in_the_payload_do_not_mislead():
    data = bytes([0xFF, 0xF2, 13 << 4 | 2 << 2, 0xC0]) * 500 + b"\xff" * 700
    assert A.parse(A.encode(data))["payload"] == A.padded(data)


def test_resynchronisation_after_junk_and_damage():
    data = bytes(range(256)) * 9
    raw = A.encode(data)
    offsets = A.parse(raw)["offsets"]
    # the frame before the junk has no follower where it should, so it goes with it
    cut = raw[: offsets[2]] + b"junk\xff\xe0junk" + raw[offsets[2] :]
    got = A.parse(cut)
    assert got["junk"] == 648 + 10 and got["frames"] == len(offsets) - 1 and got["payload"] == data[:576] + A.padded(data)[1152:]
    side = bytearray(raw)
    side[offsets[1] + 8] ^= 1
    assert A.parse(bytes(side))["crc_bad"] == 1
    body = bytearray(raw)
    body[offsets[1] + 40] ^= 1
    assert A.parse(bytes(body))["bad_blocks"] == 1
    assert A.parse(None)["frames"] == 0 and A.parse(b"\xff" * 50)["junk"] == 50


def test_headers_by_hand():
    assert A.header(bytes([0xFF, 0xFB, 0x90, 0x00])) | {} == {"size": 417, "samples": 1152, "rate": 44100, "side": 32, "crc": False, "layer": 3, "kind": (3, 3, 44100)}
    assert A.header(b"\xff\xff\xff\xff") is None and A.header(b"\xff\xfb\x00\x00") is None
    assert A.crc16(b"123456789") == 0xAEE7


def test_old_tags():
    tail = b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65)
    got = A.parse(A.encode(b"x") + tail)
    assert got["tags"]["TIT2"] == "Title" and got["tags"]["TPE1"] == "Artist" and got["junk"] == 0


@pytest.mark.parametrize("blocks", [1, 3])
def test_a_payload_that_looks_like_an_old_tag(blocks):
    data = (b"x" * (576 * (blocks - 1) + 505) + b"TAGTitle").ljust(576 * blocks, b"y")
    raw = A.encode(data)
    assert raw[-128:-125] == b"TAG"
    got = A.parse(raw)
    assert got["payload"] == data and (got["frames"], got["junk"]) == (blocks, 0) and set(got["tags"]) == {"payload_bytes"}
    tail = b"TAG" + b"Title".ljust(125, b"\0")
    got = A.parse(raw + tail)
    assert got["payload"] == data and got["junk"] == 0 and got["tags"]["TIT2"] == "Title"
    # junk between the frames and a tag leaves the tag
    got = A.parse(raw + bytes(50) + tail)
    assert got["payload"] == data[:-576] and got["tags"]["TIT2"] == "Title"


def test_table(spark):
    df = spark.createDataFrame([(1, "aé", b"z"), (None, None, b"z"), (1, "aé", b"z"), (2, "x" * 200_000, b"z")], "doc_id long, text string, media binary")
    stored = A.encode_column(df)
    got = {(r.doc_id, r.n_bytes): r for r in A.digests(stored).collect()}
    one = got[1, 3]
    payload = A.padded("aé".encode())
    assert one.payload_bytes == 576 and one.tail_crc32 == zlib.crc32(payload[-32:]) and got[None, 0].payload_bytes == 576 and got[2, 200_000].payload_bytes == 576 * 348
    assert A.parse_column(stored).filter("crc_bad = 0 and size(offsets) = frames").count() == 4
    assert A.digests(A.encode_column(df.limit(0))).count() == 0


def test_table_fields_beyond_the_stream():
    frame = bytes([0xFF, 0xF2, 0x10, 0xC0]).ljust(36, b"\0") + b"VBRI"
    head = A.header(frame[:4])
    for cut in range(len(frame)):
        A.parse(frame[:cut])
    assert A.parse(frame[: head["size"]] * 2)["frames"] == 2


def test_any_bytes_are_read():
    rng = random.Random(4)
    raw = A.encode(b"some text" * 200)
    tags = [b"ID3\x04\0\0\0\0\0\x10", b"ID3\x03\0\x10\x7f\x7f\x7f\x7f", b"TAG", b"TXXX\0\0\0\xff", b"Xing\0\0\0\x0f", b"VBRI", b"\xff\xfb\x90\0", b"\xff\xf3\x10\xc0", b"\xff\xff"]
    for _ in range(3000):
        data = b"".join(rng.choice([rng.choice(tags), rng.randbytes(rng.randrange(40)), raw[(at := rng.randrange(len(raw))) : at + rng.randrange(900)]]) for _ in range(rng.randrange(8)))
        got = A.parse(data)
        assert got["frames"] >= 0 and 0 <= got["junk"] <= len(data)


def plain_stream(data):
    """The stored form, built field by field from its description."""
    body = data + b"\xff" * (-len(data) % 576 if data else 576)
    blocks = [body[i : i + 576] for i in range(0, len(body), 576)]

    def crc(bits):
        register = 0xFFFF
        for bit in bits:
            top = register >> 15 ^ bit
            register = register << 1 & 0xFFFF ^ (0x8005 if top else 0)
        return register.to_bytes(2, "big")

    def frame(rate_index, inside, size):
        head = bytes([0b11111111, 0b11110010, rate_index << 4 | 0b1000, 0b11000000])  # MPEG-2 Layer III with CRC, 16 kHz, mono
        covered = head[2:] + bytes(9)
        return (head + crc([b >> k & 1 for b in covered for k in range(7, -1, -1)]) + bytes(9) + inside).ljust(size, b"\0")

    total = 216 + 648 * len(blocks)
    toc = bytes(min(255, (216 + len(blocks) * p // 100 * 648) * 256 // total) for p in range(100))
    text = b"\x03payload_bytes\0" + str(len(data)).encode()
    tag = b"ID3\x04\0\0" + bytes([0, 0, 0, 10 + len(text)]) + b"TXXX" + bytes([0, 0, 0, len(text), 0, 0]) + text
    return tag + frame(6, b"Xing" + bytes([0, 0, 0, 7]) + len(blocks).to_bytes(4, "big") + total.to_bytes(4, "big") + toc, 216) + b"".join(frame(13, b + zlib.crc32(b).to_bytes(4, "big"), 648) for b in blocks)


def test_digests_equal_plainly_built_streams(spark):
    texts = [None, "", "a", "é日🙂" * 100, "TAG" * 400, "x" * 576, "y" * 577, "\x00\xff" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in A.digests(A.encode_column(df)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        media, n = plain_stream(data), len(payload) // 576
        start = len(media) - 648 * n
        seek = zlib.crc32(b"".join((start + 648 * k).to_bytes(8, "big") for k in range(n)))
        feature = f"seconds={Fraction(576 * n, 16000)};frames={n};table={n};crc={n + 1}/{n + 1};bad=0;junk=0;seek={seek:08x}"
        want = (i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        assert tuple(got[i]) == want
