"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside them.

Only vectors with the same non-null label and length are compared. Equal vectors
are one vector with a count. Each (label, length) is a group; a group is split
into cells by spherical k-means, fitted on at most SAMPLE of its vectors, and
cells that are still large are split again in the same way, level by level, as
long as the sample says that it saves work. So the number of cells has no limit,
and no task holds more than one group's centroids (CELLS at most).

No link is lost at cell borders. With unit vectors x (nearest centroid c) and y
(nearest c') at cosine >= t, their distance is at most r = sqrt(2 - 2t). Along
the unit normal between c and c' they lie on opposite sides of the border, so
one of them is within r / 2 of it. Every vector therefore also visits each cell
whose border to its own is that near. A pair is compared in one cell only: where
one of the two is at home, and if that holds in two cells, in the smaller one;
and so on at every level, for which a vector carries its home and the cells it
is placed in.

A cell's vectors are cut into blocks of BLOCK; a task gets two blocks,
multiplies them, and returns for each vector the number of its links and a
spanning forest, never the pairs. Vectors are moved as the bytes of their
components and are made unit vectors in double precision where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.ngram_join import forest
from threadloom.llm.shared import components, map_arrow, materialize

THRESHOLD = 0.93
#: Vectors that a k-means is fitted on, and the most cells that it makes (bits of a mask).
SAMPLE, CELLS, ROUNDS = 2048, 64, 10
#: Cells with more vectors may be split again; levels of cells at most.
CELL_ROWS, LEVELS = 4096, 6
#: Cost of moving one vector once, in comparisons; a further split must save that share of the work.
MOVE, SAVES = 1000, 0.25
BLOCK = 1024
#: Vectors that go to one task when cells are found.
DEALT = 50_000
GROUP = ["label", "dim", "path"]


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to k distinct unit centroids of unit vectors; the first ones are chosen far apart."""
    picked, nearest = [0], sample @ sample[0]
    while len(picked) < min(k, len(sample)):
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
        picked.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    centroids = sample[picked]
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centroids)
    return np.unique(centroids, axis=0)


def margins(scores: np.ndarray, home: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distance of each vector from the border between its cell and every other (0 for its own)."""
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-18))
    own = scores[np.arange(len(scores)), home]
    return (own[:, None] - scores) / apart[home]


def half_reach(threshold: float) -> float:
    return float(np.sqrt(2 - 2 * threshold) / 2 + 1e-9)


def place(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, and whether it is placed in each cell."""
    scores = x @ centroids.T
    home = scores.argmax(1)
    return home, margins(scores, home, centroids) <= half_reach(threshold)


def fit(sample: np.ndarray, rows: int, threshold: float, always: bool, most: int = CELLS, move: float = MOVE, saves: float = SAVES) -> np.ndarray | None:
    """Centroids with the least estimated work for a group of so many rows; None if a split saves too little.

    A row costs `move` for each block pair it goes to, and its comparisons; how
    many cells it is placed in is measured on the sample.
    """
    costs = []
    k = 2
    while k <= min(most, len(sample)):
        centroids = spherical_kmeans(sample, k)
        placed = place(sample, centroids, threshold)[1].sum(1).mean() if len(centroids) > 1 else 1.0
        inside = rows * placed / len(centroids)
        costs.append((placed * move * (1 + inside / BLOCK) + inside, k, centroids))
        k *= 2
    if not costs:
        return None
    cost, _, best = min(costs, key=lambda c: c[:2])
    whole = move * (1 + rows / BLOCK) + rows / 2
    return best if always or (len(best) > 1 and cost < (1 - saves) * whole) else None


def _vectors(column: pa.Array, width: np.dtype) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), width).reshape(len(column), -1))


def _groups(batches, n: int) -> Iterator[tuple]:
    """(key, table) of consecutive rows that agree in the first n columns, from sorted batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield key, pa.Table.from_batches(held)


def _fitted(rows: DataFrame, sizes: DataFrame, width: np.dtype, threshold: float, always: bool) -> DataFrame:
    """Rows (label, dim, path, n, centroids) of the groups that are split; sizes has their rows n."""
    share = F.xxhash64("vec") / float(1 << 64) + 0.5
    few = rows.join(sizes, GROUP).filter(share < 2.0 * SAMPLE / F.col("n")).select(*GROUP, "n", share.alias("share"), "vec")
    few = few.repartition(*GROUP).sortWithinPartitions(*GROUP, "share")
    kind = few.schema["label"].dataType.simpleString()
    options = CELLS, MOVE, SAVES

    def run(batches):
        for (label, dim, path, n), part in _groups(batches, 4):
            found = fit(_vectors(part.column("vec").slice(0, SAMPLE), width), n, threshold, always, *options)
            if found is not None:
                yield pa.record_batch([pa.array([label], part.schema.field(0).type), pa.array([dim], pa.int32()), pa.array([path], pa.string()), pa.array([n], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=[*GROUP, "n", "centroids"])

    return materialize(map_arrow(few, run, f"label {kind}, dim int, path string, n long, centroids binary"), "centroids")


def _placed(rows: DataFrame, centroids: DataFrame, width: np.dtype, threshold: float) -> DataFrame:
    """The rows of the groups that are split, once for each cell they are placed in, with longer path, homes and masks.

    Centroids are sent ahead of their group's rows; a large group is dealt to several tasks.
    """
    parts = F.greatest(F.ceil(F.col("n") / DEALT), F.lit(1)).cast("int")
    own = rows.join(centroids.select(*GROUP, parts.alias("parts")), GROUP).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    ahead = centroids.select(*GROUP, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), none("long").alias("uid"), none("long").alias("copies"), F.col("centroids").alias("vec"), none("array<int>").alias("homes"), none("array<long>").alias("masks"))
    both = own.select(*ahead.columns).union(ahead)
    both = both.repartition(*GROUP, "part").sortWithinPartitions(*GROUP, "part", F.col("uid").asc_nulls_first())
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        key = centres = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            uid = batch.column(4)
            start = 0
            while start < len(keys):
                if keys[start] != key:
                    key, path = keys[start], keys[start][2]
                    centres = np.frombuffer(batch.column(6)[start].as_py(), np.float64).reshape(-1, key[1])
                    start += 1
                    continue
                stop = start
                while stop < len(keys) and keys[stop] == key and stop - start < 4 * BLOCK:
                    stop += 1
                part = batch.slice(start, stop - start)
                home, cells = place(_vectors(part.column(6), width), centres, threshold)
                mask = np.bitwise_or.reduce(np.where(cells, np.uint64(1) << np.arange(len(centres), dtype=np.uint64), np.uint64(0)), axis=1).view(np.int64)
                r, c = np.nonzero(cells)
                take = pa.array(r)
                homes = [[*h, x] for h, x in zip(part.column(7).to_pylist(), home.tolist(), strict=True)]
                masks = [[*m, x] for m, x in zip(part.column(8).to_pylist(), mask.tolist(), strict=True)]
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), pa.array([f"{path}{x}." for x in c.tolist()], pa.string()), uid.slice(start, stop - start).take(take), part.column(5).take(take), part.column(6).take(take), pa.array([homes[i] for i in r.tolist()], pa.list_(pa.int32())), pa.array([masks[i] for i in r.tolist()], pa.list_(pa.int64()))],
                    names=[*GROUP, "uid", "copies", "vec", "homes", "masks"],
                )
                start = stop

    return map_arrow(both, run, f"label {kind}, dim int, path string, uid long, copies long, vec binary, homes array<int>, masks array<long>")


def cells(distinct: DataFrame, width: np.dtype, threshold: float) -> DataFrame:
    """Rows (label, dim, path, uid, copies, vec, homes, masks): every vector in its leaf cell and those that it visits."""
    empty = F.expr("array()")
    rows = distinct.select("label", "dim", F.lit("").alias("path"), "uid", "copies", "vec", empty.cast("array<int>").alias("homes"), empty.cast("array<long>").alias("masks"))
    done = None
    for level in range(LEVELS):
        sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).filter(F.col("n") > (1 if level == 0 else CELL_ROWS))
        centroids = _fitted(rows, sizes, width, threshold, level == 0)
        rest = rows.join(centroids.select(*GROUP), GROUP, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if centroids.isEmpty():
            break
        rows = materialize(_placed(rows, centroids, width, threshold), "cells")
    else:
        done = done.unionByName(rows)
    return done


def counted_once(a: np.ndarray, b: np.ndarray, path: list[int], homes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether each pair of rows (a, b) of a leaf cell is counted there, see above."""
    ok = np.ones(len(a), bool)
    for level, cell in enumerate(path):
        home, mask = homes[:, level], masks[:, level].view(np.uint64)
        in_a, in_b = home[a] == cell, home[b] == cell
        sees = lambda x, y, h=home, m=mask: (m[x] >> h[y].astype(np.uint64) & np.uint64(1)).astype(bool)
        ok &= in_a | in_b
        ok &= ~(in_a & ~in_b & sees(a, b) & (home[b] < cell))
        ok &= ~(in_b & ~in_a & sees(b, a) & (home[a] < cell))
    return ok


def _compare(leaves: DataFrame, width: np.dtype, threshold: float) -> DataFrame:
    """Rows (uid, links, root): links of a vector found in one task, and its place in that task's forest."""
    levels = F.size("homes")
    path = F.transform(F.filter(F.split("path", r"\."), lambda p: p != ""), lambda p: p.cast("int"))
    # bit l: at home at level l; two vectors can only be counted where each level has one of them at home
    at_home = F.aggregate(F.zip_with("homes", path, lambda h, p: (h == p).cast("int")), F.lit(0), lambda s, x: s * 2 + x)
    rows = leaves.withColumn("at_home", at_home)
    counts = rows.groupBy(*GROUP, "at_home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    kinds = counts.groupBy(*GROUP).agg(F.collect_list(F.struct("at_home", "blocks")).alias("kinds"))
    rows = rows.join(kinds, GROUP)
    code = lambda kind, slot: kind.cast("long") * (1 << 32) + slot
    own = F.get(F.filter("kinds", lambda k: k["at_home"] == F.col("at_home")), F.lit(0))["blocks"]
    rows = rows.withColumn("block", code(F.col("at_home"), F.pmod(F.xxhash64("uid"), own)))
    full = (F.pow(F.lit(2), levels) - 1).cast("int")
    fits = F.filter("kinds", lambda k: k["at_home"].bitwiseOR(F.col("at_home")) == full)
    others = F.flatten(F.transform(fits, lambda k: F.transform(F.sequence(F.lit(0), k["blocks"] - 1), lambda slot: code(k["at_home"], slot))))
    rows = rows.withColumn("other", F.explode(others))
    keys = [*GROUP, "i", "j"]
    rows = rows.select(*GROUP, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "copies", "vec", "homes", "masks")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "block", "uid")

    def found(key, part):
        x = _vectors(part.column("vec"), width)
        block, uid, copies = (part.column(c).to_numpy() for c in ("block", "uid", "copies"))
        links = np.triu(x @ x.T >= threshold, 1)
        if key[3] != key[4]:
            links &= block[:, None] != block[None, :]
        a, b = np.nonzero(links)
        path = [int(p) for p in key[2].split(".") if p]
        if path and len(a):
            homes, masks = (np.array(part.column(c).to_pylist(), np.int64) for c in ("homes", "masks"))
            ok = counted_once(a, b, path, homes, masks)
            links[a[~ok], b[~ok]] = False
        links |= links.T
        n = links @ copies
        at = np.flatnonzero(n)
        return pa.record_batch([pa.array(v, pa.int64()) for v in (uid[at], n[at], uid[forest(links)[at]])], names=["uid", "links", "root"])

    def run(batches):
        for key, part in _groups(batches, len(keys)):
            if part.num_rows > 1 and (key[3] == key[4] or part.column("block")[0] != part.column("block")[part.num_rows - 1]):
                yield found(key, part)

    return map_arrow(rows, run, "uid long, links long, root long")


def _packed(rows: DataFrame, width: np.dtype) -> DataFrame:
    """Rows (key, label, vec) with vectors as bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            begins = np.asarray(column.offsets, np.int64)
            flat = column.values.to_numpy(zero_copy_only=False).astype(width)
            raw = [None if bad else flat[i:j].tobytes() for bad, i, j in zip(column.is_null().to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["key", "label", "vec"])

    return map_arrow(rows.select("key", "label", "vector"), run, f"key {kinds['key']}, label {kinds['label']}, vec binary")


def deduplicate(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, n_links, component_id, kept) of every row of df.

    Rows with a null label or a vector that is null, empty, zero or has a null
    or non-finite component link with nothing. Each of several equal rows counts as another
    vector; all rows with the component's smallest key are kept. A null key is
    never smallest; a component of null keys alone has a null id and is kept.
    Other columns are ignored whatever their names; an empty table gives no rows.
    """
    width = np.dtype(np.float32 if df.schema[vector].dataType.elementType.typeName() == "float" else np.float64)
    numbers = F.transform(df[vector], lambda v: v.cast("double"))
    rows = df.select(df[key].alias("key"), df[label].alias("label"), numbers.alias("vector"))
    # + 0.0 makes negative zeros positive; a zero vector has no largest magnitude above 0
    good = F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("vector", F.when(good, F.transform("vector", lambda v: v + F.lit(0.0))))
    # equal vectors are known by 128 bits
    stored = materialize(_packed(rows, width).withColumns({"h1": F.xxhash64("label", "vec"), "h2": F.xxhash64(F.lit(1), "vec", "label")}), "vectors")
    valid = stored.filter("vec is not null")
    dim = (F.octet_length("vec") / width.itemsize).cast("int")
    distinct = valid.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("key").alias("least"))
    distinct = materialize(distinct.withColumns({"dim": dim, "uid": F.monotonically_increasing_id()}), "distinct")
    pairs = materialize(_compare(cells(distinct, width, threshold), width, threshold), "links")
    sums = pairs.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(pairs.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
    own = distinct.select("uid", "h1", "h2", "copies", "least").join(sums, "uid", "left").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    best = own.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = own.join(best, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = stored.select("key", "h1", "h2", F.col("vec").isNotNull().alias("valid")).join(linked, ["h1", "h2"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("key"))
    links = F.when(F.col("valid"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("key").alias(key), links.alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERY = ("op6_embedding_dedup", query)

ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
