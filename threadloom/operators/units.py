"""Decomposition: messages into lines, lines into typed content units that tile each message.

Line kinds come from expressions in priority order; fences and JSON documents
are atomic blocks; the rest is gaps and islands over the lines of a message.
All windows are partitioned by (thread_id, msg_idx), so one exchange serves
them and a long thread is spread over tasks by message.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError
from threadloom.functions import patterns as P
from threadloom.functions import text as X
from threadloom.functions.python_udfs import BLOCKS, blocks_udf, detector_udf
from threadloom.sources.storage import settle

WARNING_RANK, ERROR_RANK = P.SEVERITY_RANKS["WARNING"], P.SEVERITY_RANKS["ERROR"]


@dataclass(frozen=True)
class LinePattern:
    """A Java expression that gives a line its kind; a group `level` in it, its severity."""

    expression: str
    kind: str
    priority: int = 0
    severity: str | None = None
    level_group: int | None = None


DEFAULT_PATTERNS = (
    LinePattern(P.TRACEBACK, "error", 30, severity="ERROR"),
    LinePattern(P.TIMESTAMPED_LOG, "log", 20, level_group=1),
    LinePattern(P.LEVEL_LOG, "log", 20, level_group=1),
    LinePattern(P.LOGFMT_LOG, "log", 20, level_group=1),
    LinePattern(P.TABLE_ROW, "table", 10),
)


@dataclass(frozen=True)
class ParsingOptions:
    """How text is read: line patterns, kinds of routed lines, kinds of fenced blocks by tag, identifier expressions.

    `routes` are (expression, kind) pairs that come before everything else.
    `detector` names the language of a text or gives None; prose units for which
    it names one are code. One that raises leaves them prose.
    """

    patterns: Sequence[LinePattern] = DEFAULT_PATTERNS
    routes: Sequence[tuple[str, str]] = ()
    fence_kinds: Mapping[str, str] = field(default_factory=dict)
    identifiers: Sequence[str] = P.IDENTIFIERS
    detector: Callable[[str], str | None] | None = None

    def __post_init__(self):
        if isinstance(self.patterns, str) or not all(isinstance(p, LinePattern) for p in self.patterns):
            raise ConfigurationError("patterns must be LinePatterns")
        if not all(isinstance(r, tuple) and len(r) == 2 and all(isinstance(x, str) and x for x in r) for r in self.routes):
            raise ConfigurationError("routes must be (expression, kind) pairs")
        if not self.identifiers or not all(isinstance(x, str) and x for x in self.identifiers):
            raise ConfigurationError("identifiers must be expressions")
        if self.detector is not None and not callable(self.detector):
            raise ConfigurationError("detector must be callable")


DEFAULT_OPTIONS = ParsingOptions()


def _by_priority(options: ParsingOptions) -> list[LinePattern]:
    return sorted(options.patterns, key=lambda p: -p.priority)


def _hits(line: Column, options: ParsingOptions) -> dict[str, Column]:
    """One column for each expression, which is run once: the level it captured (empty: none), null without a match."""
    out = {}
    for i, p in enumerate(_by_priority(options)):
        captured = F.get(X.all_matches(line, p.expression, p.level_group), F.lit(0)) if p.level_group else None
        out[f"__p{i}"] = F.when(X.matches(line, p.expression), F.lit(p.severity or "")) if captured is None else captured
    return out | {f"__r{i}": X.matches(line, e) for i, (e, _) in enumerate(options.routes)}


def _kind_and_rank(options: ParsingOptions) -> tuple[Column, Column]:
    """Kind of a line by its first match in order of priority, and the highest severity of all its matches."""
    kind = F.lit("text")
    for i, p in reversed(list(enumerate(_by_priority(options)))):
        kind = F.when(F.col(f"__p{i}").isNotNull(), F.lit(p.kind)).otherwise(kind)
    ranks = [X.severity_rank(X.severity(F.col(f"__p{i}"))) for i in range(len(options.patterns))]
    rank = F.greatest(F.lit(0), F.lit(0), *ranks)
    for i, (_, name) in reversed(list(enumerate(options.routes))):
        kind, rank = F.when(F.col(f"__r{i}"), F.lit(name)).otherwise(kind), F.when(F.col(f"__r{i}"), F.lit(0)).otherwise(rank)
    return kind, rank


def classified_lines(messages: DataFrame, options: ParsingOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Rows (thread_id, msg_idx, line_no, line, kind, severity, block, document, ...) of messages that are not blank.

    A line carries the number of its block's first line; a document is carried by its first line alone.
    """
    role = F.when(F.col("lineage").isNotNull(), "summary").otherwise(F.col("role"))
    shown = messages.filter(F.col("content").rlike(P.NOT_SPACE))
    # only texts with a fence or a line that may open JSON go to Python
    block = F.regexp_like("content", F.lit(f"(?m){P.FENCE}")) | F.regexp_like("content", F.lit(f"(?m){P.JSON_START}"))
    order = [(e, k) for e, k in options.routes] + [(p.expression, p.kind) for p in _by_priority(options)]
    plain = shown.filter(~block).withColumn("blocks", F.lit(None).cast(BLOCKS))
    mixed = shown.filter(block).withColumn("blocks", blocks_udf(dict(options.fence_kinds), order)("content"))
    split = F.arrays_zip(X.lines(F.col("content")).alias("line"), F.coalesce("blocks", F.expr("array()").cast(BLOCKS)).alias("b"))
    rows = plain.unionByName(mixed).select("thread_id", "msg_idx", "id", role.alias("role"), "rewritable", F.posexplode(split).alias("line_no", "l"))
    rows = rows.select("thread_id", "msg_idx", "id", "role", "rewritable", "line_no", "l.line", "l.b")
    hits = _hits(F.col("line"), options)
    rows = settle(rows, **hits)
    kind, rank = _kind_and_rank(options)
    names = X.literal_map({rank: name for name, rank in P.SEVERITY_RANKS.items()})
    alone = F.col("b").isNull()
    severity = F.when(alone | F.col("b.body"), F.element_at(names, rank)).otherwise(X.severity(F.col("b.level")))
    return rows.withColumns(
        {
            "kind": F.when(alone, kind).otherwise(F.col("b.kind")),
            "severity": severity,
            "block": F.col("b.first"),
            "document": F.col("b.document"),
            "blank": ~F.col("line").rlike(P.NOT_SPACE),
        }
    ).drop("b", *hits)


def join_traces(lines: DataFrame) -> DataFrame:
    """Indented source lines between two stack-trace lines become part of the trace."""
    own = Window.partitionBy("thread_id", "msg_idx").orderBy("line_no")
    error = F.col("kind") == "error"
    gap = F.sum(error.cast("int")).over(own)
    closed = F.max(F.when(error, F.col("line_no"))).over(Window.partitionBy("thread_id", "msg_idx"))
    fits = F.col("line").rlike(r"\A[ \t]") & ~F.col("blank") & F.col("kind").isin("text", "code")
    rows = lines.withColumns({"gap": gap, "closed": closed})
    whole = F.min(F.when(error, F.lit(True)).otherwise(fits)).over(Window.partitionBy("thread_id", "msg_idx", "gap"))
    joined = ~error & (F.col("gap") > 0) & (F.col("line_no") < F.col("closed")) & whole
    return rows.withColumn("joined", joined).withColumns({"severity": F.when(F.col("joined"), F.coalesce("severity", F.lit("ERROR"))).otherwise(F.col("severity")), "kind": F.when(F.col("joined"), "error").otherwise(F.col("kind"))}).drop("gap", "closed", "joined")


def segmented_lines(messages: DataFrame, options: ParsingOptions = DEFAULT_OPTIONS) -> DataFrame:
    """The classified lines with `unit_pos`, the place of their unit in the message."""
    lines = join_traces(classified_lines(messages, options))
    own = Window.partitionBy("thread_id", "msg_idx").orderBy("line_no")
    elevated = (F.col("kind") == "log") & (X.severity_rank(F.col("severity")) >= WARNING_RANK)
    anchor = ~F.col("blank") | F.col("block").isNotNull()
    key = F.when(anchor, F.coalesce(F.concat(F.lit("#"), F.col("block").cast("string")), F.concat_ws("|", "kind", elevated.cast("string"))))
    rows = lines.withColumn("key", key)
    before = F.last("key", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.col("key").isNotNull() & ~F.coalesce(before == F.col("key"), F.lit(False)))
    # blank lines stay with what precedes them, leading ones with the first unit
    return rows.withColumn("unit_pos", F.greatest(F.sum(F.col("opens").cast("int")).over(own) - 1, F.lit(0)).cast("int")).withColumn("anchor", F.col("key").isNotNull()).drop("key", "opens")


def units(messages: DataFrame, options: ParsingOptions = DEFAULT_OPTIONS) -> DataFrame:
    """Rows (thread_id, msg_idx, unit_pos, unit_id, role, kind, text, first_line, line_severities, severity, has_error, identifiers, document, rewritable).

    The texts of a message's units, in order, are its content. unit_id is a label;
    (thread_id, msg_idx, unit_pos) is the key, as message ids may repeat.
    """
    lines = segmented_lines(messages, options)
    by_line = F.array_sort(F.collect_list(F.struct("line_no", "line", "severity", "anchor", "kind")))
    grouped = lines.groupBy("thread_id", "msg_idx", "unit_pos").agg(by_line.alias("rows"), F.first("role").alias("role"), F.first("id").alias("id"), F.first("rewritable").alias("rewritable"), F.max("document").alias("document"))
    severities = F.transform("rows", lambda r: r["severity"])
    ranks = F.transform(severities, X.severity_rank)
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "")
    first = F.get(F.filter("rows", lambda r: r["anchor"]), F.lit(0))["kind"]
    label = F.concat(F.coalesce(F.when(F.col("id") != "", F.col("id")), F.concat(F.lit("message-"), F.col("msg_idx").cast("string"))), F.lit(":"), F.col("unit_pos").cast("string"))
    out = grouped.select(
        "thread_id", "msg_idx", "unit_pos", label.alias("unit_id"), "role", first.alias("kind"), text.alias("text"), (F.get("rows", F.lit(0))["line_no"] + 1).alias("first_line"),
        severities.alias("line_severities"), F.array_max(ranks).alias("rank"), "document", "rewritable",
    )
    if options.detector is not None:
        prose = out.filter("kind = 'text'").withColumn("kind", F.when(detector_udf(options.detector)("text"), "code").otherwise("text"))
        out = prose.unionByName(out.filter("kind <> 'text'"))
    names = X.literal_map({rank: name for name, rank in P.SEVERITY_RANKS.items()})
    return out.withColumns(
        {
            "severity": F.element_at(names, F.col("rank")),
            "has_error": (F.col("kind") == "error") | (F.col("rank") >= ERROR_RANK),
            "identifiers": X.identifiers(F.col("text"), options.identifiers),
        }
    ).drop("rank")


def kind_counts(unit_rows: DataFrame) -> DataFrame:
    """Rows (thread_id, content_kinds): units of each kind, by kind."""
    counted = unit_rows.groupBy("thread_id", "kind").agg(F.count("*").cast("int").alias("n"))
    return counted.groupBy("thread_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("content_kinds"))


def any_identifier(line: Column, options: ParsingOptions) -> Column:
    return reduce(lambda a, b: a | b, [X.matches(line, p) for p in options.identifiers])
