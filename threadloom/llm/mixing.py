"""Mixing sources to target weights by weighted fair queueing, native.

Each source's documents queue in an order shuffled by a hash of their key and text. A
document's virtual finish time is the cumulative words of its source through
it, divided by the source's target; a second copy of the source queues behind
the first. All entries are served in order of finish time until the total
budget is reached, so sources are served in proportion to their targets at
every moment.

No queue is ever gathered: a source is cut into hash ranges, an exclusive prefix
sum over the (few) ranges gives each range its offset, and a window inside a
range gives each document its place, so a source with most of the rows is
spread over all tasks; so are rows with one key, by their texts. Documents
without words wait in no queue. The global order is cut the same way: finish times are
dealt into ranges, a prefix sum over ranges finds the one that holds the
cut-off, and only that range is sorted.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import materialize

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
CAP = 2
#: Rows that a range should hold, and how many ranges there may be.
RANGE_ROWS, MAX_RANGES = 500, 65_536
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Words of a text; null has none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def body_hash(text) -> F.Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, rank, target) from rows (source, source_size).

    Water-filling in closed form: with sources sorted by cap/weight, the level is
    the largest of (budget - caps before) / (weights from here on); a source gets
    the smaller of its cap and level * weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", pick.cast("long"))
    s = s.withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    budget = F.sum("source_size").over(every) * share.numerator / F.lit(share.denominator)
    s = s.withColumn("budget", budget).withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.max((F.col("budget") - F.col("caps")) / F.col("left")).over(every))
    return s.select("source", "source_size", "rank", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def schedule(rows: DataFrame, seed: str = "mix", weights=WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """Add source_size, target, copies and taken to rows (key, source, size, body, ...), where body tells texts apart.

    rows must be a stored table; all its columns are kept. Null sources are one
    source, listed last; null keys hash like the empty text; rows that are equal
    throughout are interchangeable; an empty table gives no rows. No document is
    taken more than `cap` times.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "copies": F.lit(0), "taken": F.lit(0).cast("long")})
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    per_source = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    same = F.col("source").eqNullSafe(F.col("of"))
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("body")).cast("binary"))
    # rows without words are never taken; there may be very many with one key and text
    idle, rows = rows.filter("size = 0"), rows.filter("size > 0").withColumn("h", h)
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    offsets = sums.select(
        F.col("source").alias("of"),
        F.col("range").alias("at"),
        F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "range").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("cum", F.sum("size").over(inside))
    queued = queued.join(offsets, same & (F.col("range") == F.col("at"))).withColumn("cum", F.col("cum") + F.col("offset")).drop("of", "at", "offset")
    queued = queued.join(per_source.withColumnRenamed("source", "of"), same).drop("of")
    queued = materialize(queued, "queued")
    idle = idle.join(per_source.withColumnRenamed("source", "of"), same).drop("of", "rank").withColumns({"copies": F.lit(0), "taken": F.lit(0).cast("long")})

    def entry(copy: int) -> F.Column:
        finish = (F.col("cum") + copy * F.col("source_size")) / F.col("target")
        return F.struct(finish.alias("finish"), F.col("rank").alias("rank"), F.lit(copy).alias("copy"), F.col("h").alias("h"), F.col("key").alias("key"), F.col("size").alias("size"))

    slot = lambda finish: F.least(F.floor(finish * ranges), F.lit(2 * ranges)).cast("long")
    # Served: words through an entry, in order of finish time, within the budget.
    entries = queued.select(F.explode(F.array(*[entry(c) for c in range(cap)])).alias("e")).withColumn("slot", slot(F.col("e.finish")))
    slots = entries.groupBy("slot").agg(F.sum("e.size").alias("words"))
    slots = slots.withColumn("through", F.sum("words").over(Window.orderBy("slot")))
    within = F.col("through") * share.denominator <= F.lit(total * share.numerator)
    first = slots.filter(~within).agg(F.min(F.struct("slot", "through", "words"))).first()[0]
    accept = [F.lit(True)] * cap
    if first is not None:
        base = first["through"] - first["words"]
        order = Window.orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
        edge = entries.filter(F.col("slot") == first["slot"]).withColumn("through", F.sum("e.size").over(order) + base)
        last = edge.filter(within).agg(F.max("e")).first()[0]
        for c in range(cap):
            at = slot(entry(c)["finish"])
            accept[c] = at < first["slot"]
            if last is not None:
                types = dict(rows.dtypes)
                cut = F.struct(F.lit(last["finish"]), F.lit(last["rank"]), F.lit(last["copy"]), F.lit(last["h"]), F.lit(last["key"]).cast(types["key"]), F.lit(last["size"]).cast("long"))
                accept[c] = accept[c] | ((at == first["slot"]) & (entry(c) <= cut))
    copies = sum((F.when(a, 1).otherwise(0) for a in accept), F.lit(0))
    out = queued.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop("h", "range", "cum", "rank").unionByName(idle)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Rows (key, size, source_size, target, taken) of every row of df.

    Null and empty texts have size 0 and are never taken; nulls, repeated rows
    and empty tables as in schedule(); other columns are ignored whatever their names.
    """
    rows = materialize(df.select(df[key].alias("key"), df[source].alias("source"), word_count(df[text]).alias("size"), body_hash(df[text]).alias("body")), "sized")
    return schedule(rows, **options).select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def mix_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of df that the mix takes, each as often as it is taken; columns as df's, whatever their names.

    Null and empty texts are taken never; null keys and sources count as in
    schedule(); an empty table gives no rows.
    """
    stored = materialize(df.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("kept")), "numbered")
    body = F.col("kept")[text]
    rows = stored.select("row", F.col("kept")[key].alias("key"), F.col("kept")[source].alias("source"), word_count(body).alias("size"), body_hash(body).alias("body"))
    picked = schedule(materialize(rows, "sized"), **options).filter("copies > 0").select("row", F.sequence(F.lit(1), F.col("copies")).alias("times"))
    return stored.join(picked, "row").select("kept", F.explode("times")).select(*[F.col("kept")[c].alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op1_mix_sources", query)

ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap,
             sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl
      FROM w),
t AS (SELECT source, source_size, rnk, least(cap::DOUBLE, max(lvl) OVER () * weight) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.rnk, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum,
             row_number() OVER () AS rid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT rid, 0 AS copy, cum / target AS finish, rnk, h, doc_id, size FROM q WHERE size > 0
      UNION ALL SELECT rid, 1, (cum + source_size) / target, rnk, h, doc_id, size FROM q WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rnk, copy, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS through, sum(size) OVER () / 2 AS total FROM e),
k AS (SELECT rid, sum(size)::BIGINT AS taken FROM o WHERE through * 2 <= total * 3 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (rid)
"""
