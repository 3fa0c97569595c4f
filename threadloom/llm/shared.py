"""Scratch tables in the shared folder, bounded Arrow slices, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.storage import new_path, shared_dir

__all__ = ["SLICE_CHARS", "bound_batches", "components", "discard", "map_arrow", "map_text", "materialize", "new_path", "shared_dir", "slices"]

#: Characters of text that one slice of an Arrow batch holds at most, unless one text alone is longer.
SLICE_CHARS = 4_000_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; see storage.materialize(). discard() takes it away again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame, sweep: bool = True) -> None:
    """Delete tables that nothing needs any more; with sweep, let Spark drop shuffle files that nothing refers to.

    Spark finds the latter when the driver collects garbage, which a driver with
    little to do puts off while disks fill.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if sweep:
        gc.collect()
        SparkSession.getActiveSession()._jvm.System.gc()


def bound_batches(spark: SparkSession, limit: int = SLICE_CHARS) -> None:
    """Let this session hand at most about `limit` bytes at once to Python, unless it has a lower bound already.

    Spark's own bound is 64 MB. Each running task holds a batch in the worker and in the
    JVM, there in buffers of powers of two that are copied when they grow. Rows are
    grouped differently, nothing else changes.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= limit:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds at most about `limit` bytes of a string column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def give_back() -> None:
    """Return memory that is free inside this process to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it has no such call


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, forget: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow(run, schema), whose tasks leave nothing behind in their worker.

    Spark uses workers again in later stages, so what one operator keeps there
    would add to what the next one needs. `forget` clears the operator's caches.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return df.mapInArrow(task, schema)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: str = "text") -> DataFrame:
    """Apply fn to Arrow slices of df that are bounded by the size of a string column."""

    def run(batches):
        for part in slices(batches, column):
            yield fn(part)

    return map_arrow(df, run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the least node.

    Large-star and small-star rounds. Each takes minima by partial aggregation,
    writes them, and joins them back to the edges; as both sides of that join
    are plain exchanges, adaptive execution splits the edges of a node with very
    many neighbours over tasks. Every round is written to the shared folder. Raises if
    `rounds` rounds do not settle the forest (a path of n nodes needs about log n).
    Self-loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = materialize(edges, "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(edges)
    if not before[0]:
        return edges.select(a.alias("node"), b.alias("root"))
    for _ in range(rounds):
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.filter(b > a).join(least, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        down = large.join(lower, "a").filter(b != F.col("m")).select(b.alias("x"), F.col("m").alias("y"))
        small = down.union(lower.select("a", "m")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        old, edges = edges, materialize(small, "small")
        discard(large, old, least, lower, sweep=False)
        after = state(edges)
        if after == before:
            roots = edges.select(a.alias("node"), b.alias("root"))
            return roots.union(edges.select(b.alias("node"), b.alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
