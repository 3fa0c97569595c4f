"""Deterministic compaction of logs, tables and JSON, and rebuilding of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import text as X
from threadloom.functions.python_udfs import MIN_RUN, compact_json_udf, touched_lines_udf
from threadloom.operators.scoring import BALANCED, Policy
from threadloom.operators.units import DEFAULT_OPTIONS, WARNING_RANK, ParsingOptions, any_identifier

UNIT = ["thread_id", "msg_idx", "unit_pos"]


def plan(classified: DataFrame) -> DataFrame:
    """The units that may be compacted, with `lossy`. Tables and JSON always may, logs if compressible; never system or fixed messages."""
    lossy = F.col("level") == "compressible"
    free = (F.col("role") != "system") & F.col("rewritable")
    return classified.filter(free & (F.col("kind").isin("table", "json") | ((F.col("kind") == "log") & lossy))).withColumn("lossy", lossy)


def similarity_lines(planned: DataFrame, options: ParsingOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Lines of log and table units with the key by which neighbours are alike; null keys are like nothing.

    Log lines are alike but for volatile parts, and for numbers below warnings;
    table rows only when equal. Lines with an identifier and blank lines have no key.
    """
    rows = planned.filter(F.col("kind").isin("log", "table"))
    # a match over several lines is found in the whole text only; such units are few
    spread = F.exists("identifiers", lambda i: i.rlike(f"[{P.BREAKS}]"))
    columns = [*UNIT, "kind", "first_line", F.posexplode(F.arrays_zip(X.lines(F.col("text")).alias("line"), F.col("line_severities").alias("severity"))).alias("at", "l"), "touched"]
    plain = rows.filter(~spread).withColumn("touched", F.lit(None).cast("array<int>")).select(*columns)
    mixed = rows.filter(spread).withColumn("touched", touched_lines_udf(tuple(options.identifiers))("text")).select(*columns)
    found = plain.union(mixed).select(*UNIT, "kind", "first_line", "at", F.col("l.line").alias("line"), F.col("l.severity").alias("severity"), "touched")
    named = F.coalesce(F.array_contains("touched", F.col("at")), any_identifier(F.col("line"), options))
    stable = X.mask_volatile(F.col("line"))
    masked = F.when(X.severity_rank(F.col("severity")) >= WARNING_RANK, stable).otherwise(X.mask_numbers(stable))
    blank = ~F.col("line").rlike(P.NOT_SPACE)
    log = F.when(~named & ~blank, X.collapse_space(masked))
    return found.withColumn("key", F.when(F.col("kind") == "table", F.when(~blank, X.strip(F.col("line")))).otherwise(log)).drop("touched", "severity", "kind")


def collapse_runs(planned: DataFrame, options: ParsingOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Rows (unit, new_text): runs of three or more alike lines keep their ends around a marker, if that is shorter."""
    rows = similarity_lines(planned, options)
    own = Window.partitionBy(*UNIT).orderBy("at")
    opens = F.col("key").isNull() | ~F.coalesce(F.lag("key").over(own) == F.col("key"), F.lit(False))
    rows = rows.withColumn("run", F.sum(opens.cast("int")).over(own))
    run = Window.partitionBy(*UNIT, "run")
    inside = run.orderBy("at")
    rows = rows.withColumns(
        {
            "n": F.count("*").over(run),
            "nth": F.row_number().over(inside),
            "first_at": F.min("at").over(run),
            "ending": F.first(X.terminator(F.col("line"))).over(inside),
            "chars": F.sum(F.length("line")).over(run) - F.first(F.length("line")).over(inside),
        }
    )
    text = lambda v: v.cast("string")
    low, high = F.col("first_line") + F.col("first_at") + 1, F.col("first_line") + F.col("first_at") + F.col("n") - 2
    marker = F.concat(F.lit("... "), text(F.col("n") - 2), F.lit(" similar lines omitted (lines "), text(low), F.lit("-"), text(high), F.lit(") ..."), F.col("ending"))
    last = F.max(F.when(F.col("nth") == F.col("n"), F.length("line"))).over(run)
    rows = rows.withColumn("marker", marker).withColumn("last", last)
    short = F.col("key").isNotNull() & (F.col("n") >= MIN_RUN) & (F.col("chars") - F.col("last") > F.length("marker"))
    piece = F.when(~short, F.col("line")).when(F.col("nth") == 1, F.concat("line", "marker")).when(F.col("nth") == F.col("n"), F.col("line"))
    kept = rows.withColumn("piece", piece).filter("piece is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda r: r["piece"])
    return kept.groupBy(*UNIT).agg(F.array_join(ordered, "").alias("new_text"))


def compact_json(planned: DataFrame, policy: Policy = BALANCED) -> DataFrame:
    """Rows (unit, new_text) of JSON units: minified, runs counted, long lists sampled only where loss is allowed."""
    mode = F.when(F.col("lossy"), F.lit(policy.json_mode)).otherwise("collapse" if policy.json_mode == "sample" else policy.json_mode)
    rows = planned.filter("kind = 'json' and document is not null")
    space = rf"(?U){P.SPACE}*"
    around = lambda side: F.regexp_extract("text", side, 0)
    return rows.select(*UNIT, F.concat(around(rf"\A{space}"), compact_json_udf("document", mode), around(rf"{space}\z")).alias("new_text"))


def compact(classified: DataFrame, policy: Policy = BALANCED, options: ParsingOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Rows (unit, text, new_text) of the units that become shorter."""
    planned = plan(classified)
    changed = collapse_runs(planned, options).union(compact_json(planned, policy))
    rows = planned.select(*UNIT, "text").join(changed, UNIT)
    return rows.filter(F.length("new_text") < F.length("text"))


def rebuild(messages: DataFrame, units: DataFrame, changed: DataFrame) -> DataFrame:
    """The messages with changed units replaced; messages without any are untouched."""
    key = ["thread_id", "msg_idx"]
    touched = changed.select(*key).distinct()
    parts = units.join(touched, key, "left_semi").select(*UNIT, "text").join(changed.select(*UNIT, "new_text"), UNIT, "left")
    listed = F.array_sort(F.collect_list(F.struct("unit_pos", F.coalesce("new_text", "text").alias("t"))))
    content = parts.groupBy(*key).agg(F.array_join(F.transform(listed, lambda r: r["t"]), "").alias("new_content"))
    out = messages.join(content, key, "left").withColumn("content", F.coalesce("new_content", "content"))
    return out.select(*messages.columns)
