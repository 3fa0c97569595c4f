"""Secret scans: keyword automaton, anchored patterns near its hits, embedded checksums.

1. One Aho-Corasick pass over the lower-cased text finds keywords; a block test
   on the character classes finds places that may hold long hexadecimal runs
   (which have no keyword).
2. Each pattern is matched only at its keyword's hits.
3. Kinds whose values carry a checksum or a structure are kept only if it holds:
   CRC-32 in base 62 at the end of host tokens, decodable headers of signed web
   tokens, closed private-key blocks.

Time is linear in the text, whatever it says: a run of token characters is read
once for all hits in it, and ends of key blocks are listed once.

Spans are [start, end) in code points. Matches of one kind never overlap.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import string
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.shared import map_text

#: Order in which kinds with equal starts are listed.
KINDS = ("assign", "access", "hex", "host", "webtoken", "key")
#: Keyword -> kind.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "host",
    "gho_": "host",
    "ghu_": "host",
    "ghs_": "host",
    "ghr_": "host",
    "npm_": "host",
    "eyj": "webtoken",
    "-----begin ": "key",
}
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
HEX_LEAST, HEX_BLOCK = 32, 16

#: Matched on the text with A-Z lowered, which keeps every position.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HOST = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_WEB_RUN = re.compile(r"[\w-]++", re.ASCII)
_WEB_REST = re.compile(r"\.[\w-]++\.[\w-]++", re.ASCII)
_KEY = re.compile(r"-----BEGIN ((?:[A-Z0-9]++ )*?)PRIVATE KEY-----")
_KEY_END = re.compile(r"(?=-----END ((?:[A-Z0-9]++ )*?)PRIVATE KEY-----)")
_JSON_SPACE = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def crc_base62(body: str) -> str:
    """The six base-62 digits that such host tokens end with."""
    rest, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        out = BASE62[digit] + out
    return out


class _WebRun:
    """A run of web-token characters: which of its positions begin a header, and where the token ends.

    Headers that begin at places equal modulo 4 end in the same bytes, so the
    run is decoded four times at most, however many hits it has.
    """

    def __init__(self, text: str, start: int):
        self.text, self.stop = text, _WEB_RUN.match(text, start).end()
        rest = _WEB_REST.match(text, self.stop)
        self.end = rest.end() if rest else None
        self.decoded: dict[int, tuple[int, str, int]] = {}

    def opens(self, start: int) -> bool:
        """Whether the characters from start to the run's end are a JSON object with a member `alg`."""
        size = self.stop - start
        if self.end is None or size % 4 == 1:
            return False
        if start % 4 not in self.decoded:
            raw = base64.urlsafe_b64decode(self.text[start : self.stop] + "=" * (-size % 4))
            # one character for each byte where bytes are ASCII, as they are up to the strings
            body = raw.decode("latin-1")
            good = _valid_from(raw) if body.rstrip(" \t\n\r").endswith("}") else len(body)
            self.decoded[start % 4] = (start, body, good)
        first, body, good = self.decoded[start % 4]
        at = (start - first) // 4 * 3
        if at < good:
            return False
        try:
            got, end = _DECODER.raw_decode(body, at)
        except (ValueError, RecursionError):
            return False
        return _JSON_SPACE.match(body, end).end() == len(body) and isinstance(got, dict) and "alg" in got


def _valid_from(raw: bytes) -> int:
    """The first place from which all bytes are UTF-8; bytes before an ASCII character do not matter to it."""
    try:
        raw.decode()
        return 0
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "surrogateescape")
    last = max((m.end() for m in re.finditer("[\udc80-\udcff]", text)), default=0)
    return len(text[:last].encode("utf-8", "surrogateescape"))


def _hex_spans(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 32 or more; each holds a whole aligned block of 16 such characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blocks = len(codes) // HEX_BLOCK
    if blocks == 0:
        return []
    codes = codes[: blocks * HEX_BLOCK]
    digit = ((codes - 48) < 10) | ((codes - 97) < 6)
    out, end = [], 0
    for block in np.flatnonzero(digit.reshape(blocks, HEX_BLOCK).all(axis=1)).tolist():
        start = block * HEX_BLOCK
        if start < end:
            continue
        while start > 0 and text[start - 1] in "0123456789abcdef":
            start -= 1
        end = _HEX.match(text, start).end()
        if end - start >= HEX_LEAST:
            out.append((start, end))
    return out


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then kind as listed; null is empty."""
    if not text:
        return []
    lowered = text.encode().lower().decode()  # bytes lower only A-Z
    out: list[tuple[int, int, str]] = [(a, b, "hex") for a, b in _hex_spans(text)]
    done = dict.fromkeys(KINDS, 0)
    run: _WebRun | None = None
    ends: dict[str, list[int]] | None = None
    hits = sorted((last + 1 - size, kind) for last, (size, kind) in _AUTOMATON.iter(lowered))
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(lowered, start):
                done[kind] = m.end()
                if m.end(1) - m.start(1) >= 8:
                    out.append((start, m.end(), kind))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - start >= 16:
                    out.append((start, m.end(), kind))
        elif kind == "host":
            if (m := _HOST.match(text, start)) and crc_base62(m[1]) == m[2]:
                done[kind] = m.end()
                out.append((start, m.end(), kind))
        elif kind == "webtoken":
            if not text.startswith("eyJ", start):
                continue
            if run is None or start >= run.stop:
                run = _WebRun(text, start)
            if run.opens(start):
                done[kind] = run.end
                out.append((start, run.end, kind))
        elif m := _KEY.match(text, start):
            if ends is None:
                ends = {}
                for e in _KEY_END.finditer(text):
                    ends.setdefault(e[1], []).append(e.start())
            places = ends.get(m[1], ())
            nth = bisect_left(places, m.end())
            if nth < len(places):
                done[kind] = places[nth] + len(f"-----END {m[1]}PRIVATE KEY-----")
                out.append((start, done[kind], kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Replace each union of overlapping spans by a mark that names its first kind."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, spans array<struct<start,end,kind>>, redacted) of every row of df.

    Null and empty texts have no spans; null keys and repeated rows are kept;
    other columns are ignored whatever their names; an empty table gives none.
    """
    source = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        found = [find_spans(t) for t in texts]
        rows = [[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.record_batch(
            [part.column(0), pa.array(rows, kind), pa.array(map(redact, texts, found), pa.string())],
            names=["key", "spans", "redacted"],
        )

    kind = source.schema["key"].dataType.simpleString()
    return map_text(source, run, f"key {kind}, spans array<struct<start:int,end:int,kind:string>>, redacted string").withColumnRenamed("key", key)


def redact_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df with every secret in the text replaced by a mark; all other columns stay."""
    place = df.columns.index(text)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        clean = [redact(t, find_spans(t)) for t in part.column(place).to_pylist()]
        return part.set_column(place, part.schema.field(place), pa.array(clean, part.schema.field(place).type))

    return map_text(df, run, df.schema, text)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds and the listed spans of every row, as scan() finds them."""
    source = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, bases, alls = {k: [] for k in KINDS[:3]}, [], []
        for t in part.column(1).to_pylist():
            spans = find_spans(t)
            for k, c in counts.items():
                c.append(sum(s[2] == k for s in spans))
            bases.append(hashlib.sha256(_joined([s for s in spans if s[2] in counts]).encode()).hexdigest())
            alls.append(_joined(spans))
        return pa.record_batch(
            [part.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(bases, pa.string()), pa.array(alls, pa.string())],
            names=["key", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    kind = source.schema["key"].dataType.simpleString()
    return map_text(source, run, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op2_secret_scan", query)
