"""N-gram Jaccard self-join with PartEnum signatures; components of the links.

A document is the set of its word n-grams (64-bit hashes). Two sets link when
den * |A & B| >= num * |A | B|. That bounds how many elements can differ: with
d = |A| + |B| - 2|A & B|, d <= (|A| + |B|)(den - num)/(den + num).

Signatures. Sizes are cut into bands of ratio BAND. In a band with at most K
differing elements the feature domain is cut into partitions by hash, and
subsets of partitions are enumerated; a signature is the hash of a set's
elements in one subset.
* K = 0: one signature of the whole set.
* small K: n2 partitions, every subset of n2 - K of them; K differences touch at
  most K partitions, so one subset is equal in both sets.
* larger K: first-level partitions, each with subsets of one; more than K hold
  elements, so at least one of those is equal in both sets.
A set signs its own band and every band that a larger partner may be in.
Subsets without elements sign nothing; a set with too few partitions that hold elements for the
argument (checked for each set, chance about 1e-6) also signs with the band's name
alone, which suffices because a pair is at risk only if both its sets are such.
A band's partitions exceed its differences by a margin, so linked sets share
several signatures; sets that share fewer with all others together are left out
before classes are made and texts are moved.

Verification. Sets that share a signature are joined into coarse classes (star
edges found in a range-partitioned sort, which splits hot signatures, then
connected components). Every pair of sets of a coarse class whose sizes allow a
link is compared exactly, in tasks of bounded size, by counting common elements;
a task returns only a spanning forest of the links it finds. Exact copies have one set and
take part once.

No pair is lost and none is listed. In a coarse class of m different sets, b of
them in a band of sizes, about m * b comparisons are made inside tasks, and every
set is moved to two tasks, or to b / BLOCK where bands are that large.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import components, discard, map_arrow, materialize, slices

WORDS, NUM, DEN = 4, 85, 100
BAND = 1.4
#: Sets and n-grams of a class, and of a window of sizes, that one task compares; and sets of a block where a window has more.
CLASS_SETS, CLASS_ITEMS = 512, 1 << 18
WINDOW_SETS, WINDOW_ITEMS = 3072, 1 << 20
BLOCK, BLOCK_ITEMS = 1024, 1 << 19
#: N-grams in up to so many sets of a task are counted pair by pair, others by matrix products.
RARE = 32
#: K -> partitions, where subsets of several partitions are enumerated.
SUBSET_PARTITIONS = {0: 1, 1: 8, 2: 6, 3: 7}
#: Low bits of a signature that hold the band.
BAND_MASK = 63
#: Entries of a worker's cache of word hashes, and of sets already signed by a task.
CACHE = 1 << 18
#: Bits for each wanted value, and at most (8 MB), of the filters that keep rows without a candidate from being moved.
FILTER_SHARE, FILTER_BITS = 16, 1 << 26
COLUMNS = 4096
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _WordHashes()


def _forget() -> None:
    _WORDS.clear()
    _plan.cache_clear()
    _band_of.cache_clear()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words, A-Z lowered; the whole sequence if shorter."""
    words = (text or "").encode().lower().split()  # bytes split at ASCII white space, lower A-Z
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _A + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def set_hash(s: np.ndarray) -> int | None:
    """Identity of a set as a signed 64-bit number; None for the empty set."""
    if not len(s):
        return None
    total = np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)
    return int((mix(total) ^ mix(s * _C).sum()).view(np.int64)[0])


@lru_cache
def bands(last: int) -> list[tuple[int, int]]:
    """Size bands (first, last) that reach the size `last`."""
    out, low = [], 1
    while not out or out[-1][1] < last:
        out.append((low, max(low, int(low * BAND))))
        low = out[-1][1] + 1
    return out


def _band_of(size: int) -> int:
    return next(i for i, (_, high) in enumerate(bands(1 << max(4, size.bit_length()))) if size <= high)


_band_of = lru_cache(1 << 16)(_band_of)


@lru_cache(1 << 12)
def _plan(band: int, num: int, den: int):
    """(K, partitions, subsets) of a band; subsets is None where each has one partition."""
    high = bands(1 << 40)[band][1]
    k = 2 * high * (den - num) // (den + num)
    if k in SUBSET_PARTITIONS:
        n = SUBSET_PARTITIONS[k]
        picks = np.zeros((comb(n, n - k), n), np.uint64)
        for i, c in enumerate(combinations(range(n), n - k)):
            picks[i, list(c)] = 1
        return k, n, picks
    return k, k + 4 + k // 16, None


def signatures(s: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, list[int]]:
    """Signatures of a set as signed 64-bit numbers with the band in the low bits, and how many of each band's any linked set must share.

    Of the partitions that hold elements all but the differing ones are shared, so
    in a band with at most d differing elements that many less d.
    """
    size = len(s)
    if not size:
        return np.empty(0, np.int64), []
    out, need = [], []
    partner = size * den // num
    reach = (size + partner) * (den - num) // (den + num)
    value = mix(s * _A)
    for band in range(_band_of(size), _band_of(partner) + 1):
        k, n, picks = _plan(band, num, den)
        part = ((mix(s + np.uint64(band + 1)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, first = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(value[order], first)
        name = (np.array([band + 1], np.uint64) * _C)[0]
        if picks is None:
            found = mix(sums + name + held.astype(np.uint64) * _A)
        else:
            full = np.zeros(n, np.uint64)
            full[held] = mix(sums + held.astype(np.uint64))
            some = np.zeros(n, np.uint64)
            some[held] = 1
            used = np.flatnonzero((picks * some).sum(1))
            found = mix((picks * full).sum(1)[used] + name + used.astype(np.uint64) * _A)
        if len(held) <= min(k, reach) and k:
            found = np.append(found, mix(np.array([name], np.uint64)))
        need.append(max(1, len(held) - min(k, reach)) if picks is None else 1)
        out.append(found & ~np.uint64(BAND_MASK) | np.uint64(band & BAND_MASK))
    return np.concatenate(out).view(np.int64), need


def _once(seen: set, key: int | None) -> bool:
    """Whether key is new to this task, as far as the bounded memory tells."""
    if key is None or key in seen:
        return False
    if len(seen) >= CACHE:
        seen.clear()
    seen.add(key)
    return True


def _sign(source: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Rows (key, th, tk, n, name, signs, band, need); a task signs each set once."""

    def run(batches):
        seen: set = set()
        for part in slices(batches, "text"):
            sizes, names, signs, firsts, needs = [], [], [], [], []
            for text in part.column(3).to_pylist():
                s = shingles(text, words)
                sizes.append(len(s))
                names.append(set_hash(s))
                made, need = signatures(s, num, den) if _once(seen, names[-1]) else (None, None)
                signs.append(made)
                needs.append(need)
                firsts.append(_band_of(len(s)) & BAND_MASK if need else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(firsts, pa.int32()), pa.array(needs, pa.list_(pa.int32()))]
            yield pa.record_batch([*part.columns[:3], *columns], names=["key", "th", "tk", "n", "name", "signs", "band", "need"])

    kind = source.schema["key"].dataType.simpleString()
    return map_arrow(source, run, f"key {kind}, th long, tk int, n long, name long, signs array<long>, band int, need array<int>", _forget)


def _buckets(signed: DataFrame) -> DataFrame:
    """A stored table of what the sorted signatures show.

    kind 0: edges (a, b) between sets with an equal signature; kind 1: the first and last
    signature b of a sorted partition and its hub a, as a signature may run on in
    the next one; kind 2: set a has n signatures of band b that some other set has too.
    """
    rows = signed.select(F.explode("signs").alias("sign"), "name").repartitionByRange("sign", "name").sortWithinPartitions("sign", "name")

    def run(batches):
        def batch_of(kind, a, b, n=None):
            return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64) if n is None else n)], names=["kind", "a", "b", "n"])

        hub_sign = hub = None
        ends: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sign, name = (batch.column(i).to_numpy() for i in (0, 1))
            opens = hub_sign is None
            if opens:
                hub_sign, hub = int(sign[0]), int(name[0])
                ends.append((hub_sign, hub))
            new = np.empty(len(sign), bool)
            new[0] = sign[0] != hub_sign
            new[1:] = sign[1:] != sign[:-1]
            at = np.maximum.accumulate(np.where(new, np.arange(len(sign)), -1))
            hubs = np.where(at >= 0, name[np.maximum(at, 0)], hub)
            differ = hubs != name
            pairs = np.unique(np.stack([hubs[differ], name[differ]]), axis=1)
            yield batch_of(0, pairs[0], pairs[1])
            # shared: the run of its signature has another name; runs at the batch's ends may, and count
            run_of = np.cumsum(new)
            shared = np.zeros(run_of[-1] + 1, bool)
            shared[run_of[differ]] = True
            shared[0] = shared[run_of[-1]] = shared[run_of[0]] = True
            again = np.zeros(len(sign), bool)
            again[1:] = ~new[1:] & (name[1:] == name[:-1])
            kept = np.flatnonzero(shared[run_of] & ~again)
            found, n = np.unique(np.stack([name[kept], sign[kept] & BAND_MASK]), axis=1, return_counts=True)
            yield batch_of(2, found[0], found[1], n.astype(np.int64))
            hub_sign, hub = int(sign[-1]), int(hubs[-1])
        if hub_sign is not None and ends[-1][0] != hub_sign:
            ends.append((hub_sign, hub))
        yield batch_of(1, np.array([e[1] for e in ends], np.int64), np.array([e[0] for e in ends], np.int64))

    return materialize(map_arrow(rows, run, "kind int, a long, b long, n long"), "buckets")


def _able(signed: DataFrame, buckets: DataFrame) -> DataFrame:
    """The signed sets that share as many signatures of a band as a link there takes."""
    shared = buckets.filter("kind = 2").groupBy(F.col("a").alias("name"), F.col("b").cast("int").alias("at")).agg(F.sum("n").alias("shared"))
    needs = signed.select("name", F.posexplode("need").alias("step", "least"), "band").distinct()
    needs = needs.withColumn("at", (F.col("band") + F.col("step")) % (BAND_MASK + 1))
    able = materialize(shared.join(needs, ["name", "at"]).filter(F.col("shared") >= F.col("least")).select("name").distinct(), "names")
    return _may_have(able, signed.select("name", "signs"), "name").join(able, "name", "left_semi")


def _edges(buckets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets with an equal signature."""
    ends = buckets.filter("kind = 1").select(F.col("b").alias("sign"), "a")
    across = ends.join(ends.groupBy("sign").agg(F.min("a").alias("b")), "sign").select("a", "b")
    return buckets.filter("kind = 0").select("a", "b").union(across)


def _may_have(wanted: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Rows whose hash in a column may be among those of `wanted`, by a bit filter whose size grows with them up to FILTER_BITS."""
    bits = min(FILTER_BITS, 1 << max(16, (FILTER_SHARE * wanted.count()).bit_length()))
    word = (F.pmod(F.col(column), F.lit(bits)) / 64).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    masks = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    kept = rows.withColumn("word", word).join(F.broadcast(masks), "word")
    return kept.filter(F.col("mask").bitwiseAND(bit) != 0).drop("word", "mask")


def link_matrix(sets: list[np.ndarray], left: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Which of the sets link; with `left`, only pairs of one left and one other set are compared."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.concatenate([[True], items[1:] != items[:-1]])
    run = np.cumsum(new) - 1
    counts = np.bincount(run)
    inter = np.zeros(m * m, np.float32)  # counts below 2**24 are exact
    rare = (counts > 1) & (counts <= RARE)  # elements of one set alone add to no intersection
    some = rare[run]
    rare_run, rare_owner = run[some], owner[some]
    for step in range(1, min(RARE, len(rare_run))):
        both = np.flatnonzero(rare_run[step:] == rare_run[:-step])
        if not len(both):
            break
        pair = rare_owner[both] * m + rare_owner[both + step]
        np.add.at(inter, pair, np.float32(1))
    inter = inter.reshape(m, m)
    inter += inter.T.copy()
    often = (counts > RARE)[run]
    run, owner = run[often], owner[often]
    if len(run):
        column = np.cumsum(np.concatenate([[True], run[1:] != run[:-1]])) - 1
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            block = np.zeros((m, int(column[b - 1]) - low + 1), np.float32)
            block[owner[a:b], column[a:b] - low] = 1
            inter += block @ block.T
    # den * i >= num * (a + b - i), row by row in 64 bits
    links = np.stack([(den + num) * row.astype(np.int64) >= num * (size + sizes) for row, size in zip(inter, sizes, strict=True)])
    np.fill_diagonal(links, False)
    if left is not None:
        links &= left[:, None] != left[None, :]
    return links


def forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least row of its component."""
    label = np.arange(len(links))
    a, b = np.nonzero(np.triu(links))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tasks(members: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (root, lo, hi, i, j, left, ...) from rows (root, name, n, ...): the comparisons that each set takes part in.

    A small class is one task. In others, as sets that link have sizes within a
    ratio of num / den, bands of that ratio are made and window w holds bands w
    and w + 1. A window is one task; if it has too many sets, its pairs of
    blocks are (band w with itself and with band w + 1). i = -1 marks whole tasks.
    """
    width = math.log(den / num) * (1 + 1e-9)
    rows = members.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    sizes = rows.groupBy("root", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("items"))
    band_of = F.map_from_entries(F.collect_list(F.struct("band", F.struct("sets", "items"))))
    classes = sizes.groupBy("root").agg(band_of.alias("bands"), F.sum("sets").alias("sets"), F.sum("items").alias("items"))
    rows = rows.join(classes, "root")
    of = lambda band, what: F.coalesce(F.element_at("bands", band)[what], F.lit(0))
    blocks = lambda band: F.ceil(F.greatest(of(band, "sets") / BLOCK, of(band, "items") / BLOCK_ITEMS)).cast("int")
    fits = lambda w: (of(w, "sets") + of(w + 1, "sets") <= WINDOW_SETS) & (of(w, "items") + of(w + 1, "items") <= WINDOW_ITEMS)
    band = F.col("band")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("name"), blocks(band)).cast("int"))
    own = F.col("own")
    task = lambda lo, hi, i, j, left: F.struct(lo.alias("lo"), hi.alias("hi"), i.alias("i"), j.alias("j"), left.alias("left"))
    none = F.lit(-1)
    every = lambda other: F.filter(F.sequence(F.lit(0), blocks(other)), lambda k: k < blocks(other))
    inside = F.transform(every(band), lambda k: task(band, band, F.least(own, k), F.greatest(own, k), own <= k))
    above = F.transform(every(band + 1), lambda k: task(band, band + 1, own, k, F.lit(True)))
    below = F.transform(every(band - 1), lambda k: task(band - 1, band, k, own, F.lit(False)))
    here = F.when(fits(band), F.array(task(band, band, none, none, F.lit(True)))).otherwise(F.concat(inside, above))
    empty = F.filter(inside, lambda t: F.lit(False))
    under = F.when(of(band - 1, "sets") == 0, empty).when(fits(band - 1), F.array(task(band - 1, band - 1, none, none, F.lit(True)))).otherwise(below)
    small = (F.col("sets") <= CLASS_SETS) & (F.col("items") <= CLASS_ITEMS)
    tasks = F.when(small, F.array(task(none, none, none, none, F.lit(True)))).otherwise(F.concat(here, under))
    rest = [c for c in members.columns if c != "root"]
    return rows.withColumn("t", F.explode(tasks)).select("root", "t.*", *rest)


def _compare(members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Spanning links (a, b) of rows (root, lo, hi, i, j, left, name, text)."""
    key_columns = ["root", "lo", "hi", "i", "j"]
    rows = members.select(*key_columns, "left", "name", "text").repartition(*key_columns).sortWithinPartitions(*key_columns, "left", "name")

    def found(key, held):
        if len(held) < 2:
            return [], []
        _, lo, hi, i, j = key
        left = None if lo == hi and i == j else np.array([x[0] for x in held])
        if left is not None and (left.all() or not left.any()):
            return [], []
        sets, names = [shingles(x[2], words) for x in held], [x[1] for x in held]
        label = forest(link_matrix(sets, left, num, den))
        at = np.flatnonzero(label != np.arange(len(label)))
        return [names[i] for i in at], [names[label[i]] for i in at]

    def run(batches):
        key, held = None, []
        for batch in batches:
            a, b = [], []
            for root, lo, hi, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, lo, hi, i, j) != key:
                    x, y = found(key, held)
                    a += x
                    b += y
                    key, held = (root, lo, hi, i, j), []
                held.append(rest)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = found(key, held)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long", _forget)


def join_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Rows (key, n_shingles, component_id) of every row of df.

    component_id is the smallest key reachable by links, the row's own included.
    Null and empty texts and texts without words have size 0 and are linked with
    nothing; a null key gives a null component only where no other key is
    reachable; repeated rows are kept; other columns are ignored whatever their
    names; an empty table gives no rows.
    """
    body = df[text]
    source = df.select(df[key].alias("key"), F.xxhash64(body).alias("th"), F.hash(body).alias("tk"), body.alias("text"))
    signed, by_name = _classes(source, words, num, den)
    least = signed.filter("name is not null").groupBy("name").agg(F.min("key").alias("least"))
    least = least.join(by_name, "name", "left").withColumn("root", F.coalesce("root", "name"))
    best = least.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = least.join(best, "root").select("name", "component_id")
    out = signed.select("key", "n", "name").join(ids, "name", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def _classes(source: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (key, th, tk, n, name, first) of all documents, and (name, root) of linked sets."""
    everything = materialize(_sign(source, words, num, den), "signatures")
    signed = materialize(everything.select("key", "th", "tk", "n", "name", F.col("signs").isNotNull().alias("first")), "sets")
    every = everything.filter("signs is not null")
    seen = _buckets(every)
    # what cannot link is left out, so that it chains no classes together
    discard()  # the exchanged signatures are on disk still
    able = materialize(_able(every, seen), "able")
    discard(everything, seen)
    buckets = _buckets(able)
    coarse = components(_edges(buckets))
    discard(buckets, able)
    texts = signed.filter("first").groupBy("name").agg(F.min(F.struct("th", "tk")).alias("t"), F.first("n").alias("n"))
    wanted = coarse.withColumnRenamed("node", "name").join(texts, "name").select("root", "name", "n", "t.th", "t.tk")
    wanted = materialize(_tasks(wanted, num, den), "wanted")
    ids = wanted.select("th", "tk").distinct()
    once = _may_have(ids, source.select("th", "tk", "text"), "th").groupBy("th", "tk").agg(F.first("text").alias("text"))
    members = once.join(wanted, ["th", "tk"])
    links = materialize(_compare(members, words, num, den), "links")
    discard(wanted)
    return signed, components(links).withColumnRenamed("node", "name")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of df without those that repeat another's text nearly: of each component the row with the least key stays.

    Rows without words all stay; rows equal in key and text count as one. Columns are df's.
    """
    hashed = df.withColumns({"__th": F.xxhash64(text), "__tk": F.hash(text)})
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = hashed.filter(worded)
    signed, by_name = _classes(rows.select(F.col(key).alias("key"), F.col("__th").alias("th"), F.col("__tk").alias("tk"), F.col(text).alias("text")), words, num, den)
    placed = signed.select("key", "th", "tk", "name").join(by_name, "name", "left").withColumn("root", F.coalesce("root", "name"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "th", "tk")).alias("s"))
    stay = first.select(F.col("s.key").alias("__k"), F.col("s.th").alias("__h"), F.col("s.tk").alias("__j"))
    rest = [c for c in df.columns if c != key]
    once = rows.groupBy(key, "__th", "__tk").agg(*[F.first(c).alias(c) for c in rest])
    same = once[key].eqNullSafe(stay["__k"]) & (once["__th"] == stay["__h"]) & (once["__tk"] == stay["__j"])
    return once.join(stay, same, "left_semi").select(*df.columns).union(df.filter(~worded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op3_ngram_jaccard", query)

ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, rid, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS grams FROM d),
t AS (SELECT any_value(rid) AS tid, grams, list(rid) AS rids FROM s WHERE len(grams) > 0 GROUP BY list_sort(grams), grams),
g AS (SELECT tid, unnest(grams) AS gram FROM t),
e AS (SELECT a.tid AS a, b.tid AS b FROM g a JOIN g b ON a.gram = b.gram AND a.tid <> b.tid JOIN t x ON x.tid = a.tid JOIN t y ON y.tid = b.tid
      GROUP BY a.tid, b.tid, len(x.grams), len(y.grams) HAVING 100 * count(*) >= 85 * (len(x.grams) + len(y.grams) - count(*))),
r AS (SELECT tid AS a, tid AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT tid, min(doc_id) AS least FROM (SELECT tid, unnest(rids) AS rid FROM t) JOIN s USING (rid) GROUP BY tid),
c AS (SELECT r.a AS tid, min(m.least) AS component_id FROM r JOIN m ON m.tid = r.b GROUP BY r.a)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, CASE WHEN len(s.grams) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
FROM s LEFT JOIN (SELECT tid, unnest(rids) AS rid FROM t) o USING (rid) LEFT JOIN c USING (tid)
"""
