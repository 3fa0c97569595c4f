"""Language identification with n-gram filters whose cells are language bitmasks.

The filter is one array of 64-bit cells for each 64 languages; bit l of a cell
belongs to language l, so one lookup of an n-gram (the AND of its HASHES cells)
returns every language that contains it: the Bloom filters of all languages,
sliced by bit. Every language with labels has a bit. A text's
n-grams are looked up, hits are counted for each language, and the counts are
corrected by each filter's false-positive rate. The language with the largest
corrected share of n-grams wins (ties: the first by code point).

Training takes the TRAIN_DOCS labelled documents of each language that come first by a
hash of their id (the stated bound of the sample; the whole text of each is
used). An n-gram enters a language's filter if its rate there is at least
KEEP_RATIO of its highest rate in any language and it was seen MIN_COUNT times
over documents, so n-grams that strayed in with quoted passages stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import map_arrow, map_text, materialize

ORDERS = (3, 4)
CELL_BITS = 20
HASHES = 2
TRAIN_DOCS = 1500
MIN_COUNT, KEEP_RATIO = 3, 0.3
HELD_OUT_OF = 5
#: The bits of a cell; more languages have more arrays of cells.
LANGUAGES = 64
UNKNOWN = "und"
#: Texts below this score are rejected where texts are filtered, unless their label agrees
#: or the best language leads the second by CLEAR_LEAD and has a score of CLEAR_SCORE.
LEAST_SCORE = 0.5
CLEAR_SCORE, CLEAR_LEAD = 0.3, 0.25
#: Code points that are looked at in one step; the n-grams across steps are kept.
STEP = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters with every run of other characters as one space, space at both ends."""
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32)


_LETTER = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter (str.isalpha)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def normalized(text: str) -> np.ndarray:
    codes = _codes(text)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, codes, np.uint32(32))[keep]


def ngram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams whose inside is not a space alone."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ wide[k : len(codes) - n + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _all_hashes(text: str):
    codes = normalized(text)
    for at in range(0, max(len(codes), 1), STEP):
        for n in ORDERS:
            yield ngram_hashes(codes[at : at + STEP + n - 1], n)


def _cells(h: np.ndarray, k: int) -> np.ndarray:
    return ((h * (_MIX2 + np.uint64(2 * k))) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _words(languages: int) -> int:
    """How many arrays of cells so many languages need."""
    return max(1, -(-languages // LANGUAGES))


class Filters:
    """Bit-sliced Bloom filters; language l is bit l % 64 of the cells of word l // 64."""

    def __init__(self, languages: list[str], cells: np.ndarray | None = None):
        self.languages = languages
        shape = (_words(len(languages)), 1 << CELL_BITS)
        self.cells = np.zeros(shape, np.uint64) if cells is None else cells.reshape(shape)

    def add(self, index: int, hashes: np.ndarray) -> None:
        for k in range(HASHES):
            self.cells[index // LANGUAGES, _cells(hashes, k)] |= np.uint64(1 << index % LANGUAGES)

    def lookup(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """Bitmask of the languages of a word that (seem to) contain each n-gram."""
        cells = self.cells[word]
        out = cells[_cells(hashes, 0)]
        for k in range(1, HASHES):
            out = out & cells[_cells(hashes, k)]
        return out

    def _counts(self, word: int, masks: np.ndarray) -> list[int]:
        """How many of a word's masks have the bit of each of its languages."""
        n = min(LANGUAGES, len(self.languages) - word * LANGUAGES)
        return [np.count_nonzero(masks & np.uint64(1 << i)) for i in range(n)]

    def rates(self) -> np.ndarray:
        """False-positive rate of each language: its share of set bits to the power of HASHES."""
        share = np.array([c for w, cells in enumerate(self.cells) for c in self._counts(w, cells)]) / self.cells.shape[1]
        return share**HASHES

    def shares(self, text: str | None, rates: np.ndarray) -> np.ndarray | None:
        """Corrected share of the text's n-grams in each language; None without n-grams or languages."""
        if not text or not self.languages or not _letters()[_codes(text)].any():
            return None
        hits, total = np.zeros(len(self.languages)), 0
        for h in _all_hashes(text):
            total += len(h)
            hits += [c for w in range(len(self.cells)) for c in self._counts(w, self.lookup(h, w))]
        if not total:
            return None
        return np.clip((hits / total - rates) / np.maximum(1 - rates, 1e-9), 0, 1)

    def predict(self, text: str | None, rates: np.ndarray) -> tuple[str, float]:
        share = self.shares(text, rates)
        if share is None:
            return UNKNOWN, 0.0
        best = int(share.argmax())
        return self.languages[best], float(share[best])

    def identified(self, text: str | None, lang: str | None, rates: np.ndarray, least: float = LEAST_SCORE) -> bool:
        """Whether a text has an identifiable language. A small lead alone rejects no text, as texts may mix languages."""
        share = self.shares(text, rates)
        if share is None:
            return False
        best = int(share.argmax())
        second = np.partition(share, -2)[-2] if len(share) > 1 else share[best]
        clear = share[best] >= CLEAR_SCORE and share[best] - second >= CLEAR_LEAD
        return bool(share[best] >= least or clear or (share[best] > 0 and lang == self.languages[best]))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = TRAIN_DOCS) -> Filters:
    """Filters from at most `docs` rows of each language, the first by a hash of their key."""
    rows = df.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    # twice the rows that are wanted, by a threshold on the hash, then the first of them:
    # no task sees more than about 2 * docs rows of a language, however many there are
    share = F.element_at(F.create_map(*[x for r in seen for x in (F.lit(r["lang"]), F.lit(2.0 * docs / r["n"]))]), F.col("lang")) if seen else F.lit(1.0)
    few = rows.select("lang", "h").filter(F.col("h") / float(1 << 64) + 0.5 < share).distinct()
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= docs).select("lang", "h")
    sample = materialize(rows.join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text"), "sample")

    def run(batches):
        # counts of n-grams in one batch; the sum over batches follows in Spark
        held: dict[str, list] = {}
        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(_all_hashes(body))
                held.setdefault(language, []).append(np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64))
        for language, arrays in held.items():
            h, n = np.unique(np.concatenate(arrays), return_counts=True)
            yield pa.record_batch([pa.array([language] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    grams = map_arrow(sample, run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    rate = F.col("n") / F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang")) if sizes else F.lit(0.0)
    best = Window.partitionBy("h")
    kept = grams.withColumn("rate", rate).withColumn("top", F.max("rate").over(best)).filter(F.col("rate") >= KEEP_RATIO * F.col("top"))
    # a cell is the OR of masks: the result is the filter itself, bounded by 2**CELL_BITS cells for each 64 languages
    index = F.element_at(F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))]), F.col("lang")) if languages else F.lit(0)
    bit = F.element_at(F.create_map(*[x for i in range(LANGUAGES) for x in (F.lit(i), F.lit(np.uint64(1 << i).astype(np.int64).item()))]), F.col("index") % LANGUAGES)
    masks = kept.withColumn("index", index).groupBy("h", F.floor(F.col("index") / LANGUAGES).cast("int").alias("word")).agg(F.bit_or(bit).alias("mask"))
    filters = Filters(languages)

    def place(batches):
        words: dict[int, np.ndarray] = {}
        for batch in batches:
            h, m = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 2))
            word = batch.column(1).to_numpy(zero_copy_only=False)
            for w in np.unique(word).tolist():
                cells = words.setdefault(w, np.zeros(1 << CELL_BITS, np.uint64))
                own = word == w
                for k in range(HASHES):
                    np.bitwise_or.at(cells, _cells(h[own], k), m[own])
        for w, cells in words.items():
            at = np.flatnonzero(cells)
            yield pa.record_batch([pa.array(np.full(len(at), w, np.int32)), pa.array(at.astype(np.int32)), pa.array(cells[at].view(np.int64))], names=["word", "cell", "mask"])

    cells = map_arrow(masks.select("h", "word", "mask"), place, "word int, cell int, mask long").groupBy("word", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    filters.cells[cells.column("word").to_numpy(), cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return filters


def identify(df: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score) of every row of df.

    Null texts and texts without a letter are `und` with score 0; null keys and
    repeated rows are kept; other columns are ignored whatever their names;
    without training rows every row is `und`.
    """
    source = df.select(df[key].alias("key"), df[text].alias("text"))
    sent = df.sparkSession.sparkContext.broadcast((filters.languages, filters.cells.tobytes(), filters.rates()))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        languages, cells, rates = sent.value
        here = Filters(languages, np.frombuffer(cells, np.uint64))
        found = [here.predict(t, rates) for t in part.column(1).to_pylist()]
        return pa.record_batch([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["key", "lang_pred", "score"])

    kind = source.schema["key"].dataType.simpleString()
    return map_text(source, run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_identified(df: DataFrame, filters: Filters, text: str = "text", least: float = LEAST_SCORE, lang: str = "lang") -> DataFrame:
    """The rows of df whose text has an identifiable language (see Filters.identified()); all columns stay. Labels are read where df has them."""
    sent = df.sparkSession.sparkContext.broadcast((filters.languages, filters.cells.tobytes(), filters.rates()))
    place, label = df.columns.index(text), df.columns.index(lang) if lang in df.columns else None

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        languages, cells, rates = sent.value
        here = Filters(languages, np.frombuffer(cells, np.uint64))
        labels = [None] * part.num_rows if label is None else part.column(label).to_pylist()
        return part.filter(pa.array([here.identified(t, k, rates, least) for t, k in zip(part.column(place).to_pylist(), labels, strict=True)], pa.bool_()))

    return map_text(df, run, df.schema, text)


def held_out(key) -> F.Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERY = ("op10_language_id", query)
