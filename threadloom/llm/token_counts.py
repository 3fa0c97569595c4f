"""Token counts of whole texts; longer ones are encoded in overlapping chunks and spliced.

A text of more than CHUNK characters is cut into chunks that overlap. Both
encodings of an overlap carry offsets; they are spliced at the first position where

* the text has a space after a character that is not white space, before one
  that is not either. The pre-tokenizer starts a piece there whatever stands
  further away: a space can only open a piece, and only white space may run
  into it from the left; no added token contains white space;
* both encodings have a token start there.

Tokens before that position come from the left chunk, those from it on from the
right chunk. Where an overlap has no such position (long runs without a space),
the overlap doubles and the right chunk is encoded anew, up to the whole rest.
Only two chunks are held at a time, however long the text is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.shared import map_text

CHUNK, OVERLAP = 2048, 64
MAX_TOKENS = 1024
TOKENIZER = "byte_bpe_50k.json"
_STABLE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer in the file, loaded once in a worker; it uses the worker's one thread."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _common(text: str, left, start: int, right, low: int, stop: int) -> tuple[int, int, int] | None:
    """The first stable position in (low, stop) with a token start in both encodings, and those tokens' numbers."""
    for m in _STABLE.finditer(text, low + 1, stop):
        at = m.start()
        if at + 1 >= stop:
            break
        a, b = left.char_to_token(at - start), right.char_to_token(at - low)
        if a is not None and b is not None and left.token_to_chars(a)[0] == at - start and right.token_to_chars(b)[0] == at - low:
            return at, a, b
    return None


def spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple]:
    """(encoding, first, last) of the chunks whose token ranges, joined, are the tokens of the whole text."""
    start, first, begin, size = 0, 0, 0, len(text)  # the accepted tokens of `left` begin at `begin` in the text
    stop = min(chunk, size)
    left = tok.encode(text[:stop], add_special_tokens=False)
    while stop < size:
        wide = overlap
        while True:
            low = max(begin + 1, stop - wide)
            high = min(size, low + max(chunk, 2 * (stop - low)))
            right = tok.encode(text[low:high], add_special_tokens=False)
            found = _common(text, left, start, right, low, stop)
            if found is not None:
                begin, last, after = found
                yield left, first, last
                left, start, first, stop = right, low, after, high
                break
            if low == begin + 1:  # nothing to splice at: take more text at once
                stop = min(size, stop + 2 * (stop - start))
                left = tok.encode(text[start:stop], add_special_tokens=False)
                break
            wide *= 2
    yield left, first, len(left)


def encode_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of text, encoded in chunks; equal to those of the whole text."""
    return [i for part, first, last in spliced(tok, text, chunk, overlap) for i in part.ids[first:last]]


def count_text(tok, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text; null has none."""
    return sum(last - first for _, first, last in spliced(tok, text, chunk, overlap)) if text else 0


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit) of every row of df.

    Null and empty texts count 0; null keys and repeated rows are kept; other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    path = path or vocabulary_path()
    source = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        col = part.column(1)
        tok = tokenizer(path)
        n = pa.array([count_text(tok, t) for t in col.to_pylist()], pa.int64())
        size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
        return pa.record_batch([part.column(0), size, n, pc.greater(n, max_tokens)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["key"].dataType.simpleString()
    return map_text(source, run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op8_token_counts", query)
