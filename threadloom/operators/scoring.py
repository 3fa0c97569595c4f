"""Importance of units, and how freely each may be compacted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError
from threadloom.functions import patterns as P
from threadloom.functions import text as X

# Weights of the signals, and of repetition.
RECENCY, CORRECTED, CONSTRAINED, ERROR, DECIDED, IDENTIFIED, IDENTIFIED_IN_FAILURE = 0.25, 0.9, 0.75, 0.35, 0.2, 0.1, 0.35
RECENT, REPEATS, REPEAT_FACTOR, REPEAT_FLOOR = 0.8, 3, 0.2, 0.05
REASONS = ("recent", "user_correction", "active_constraint", "error_severity", "decision", "contains_identifier", "user_identifier", "identifier_in_failure_context", "repetitive_low_value")


@dataclass(frozen=True)
class Policy:
    """Thresholds of the levels, and how JSON is compacted: minify, collapse or sample."""

    name: str
    must: float
    should: float
    error_must: float
    json_mode: str = "collapse"

    def __post_init__(self):
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x <= 1 for x in (self.must, self.should, self.error_must)) or self.should > self.must:
            raise ConfigurationError("thresholds must lie in [0, 1], should not above must")
        if self.json_mode not in ("minify", "collapse", "sample"):
            raise ConfigurationError(f"unknown JSON mode {self.json_mode!r}")


# The built-in policies.
MAXIMUM_PRESERVATION = Policy("maximum_preservation", 0.60, 0.30, 0.45, "minify")
BALANCED = Policy("balanced", 0.75, 0.45, 0.60, "collapse")
MAXIMUM_COMPRESSION = Policy("maximum_compression", 0.90, 0.65, 0.80, "sample")


def repetition(units: DataFrame) -> DataFrame:
    """The units with `repeated`: all but the first and last of three or more that are equal but for volatile parts.

    Equal means kind, identifiers and normalized text; only groups of three or
    more by kind and identifiers are normalized.
    """
    rough = Window.partitionBy("thread_id", "kind", "identifiers")
    rows = units.withColumn("peers", F.count("*").over(rough))
    rows = rows.withColumn("norm", F.when(F.col("peers") >= REPEATS, X.normalize_volatile(F.col("text"))))
    same = Window.partitionBy("thread_id", "kind", "identifiers", "norm")
    rows = rows.withColumns({"size": F.count("*").over(same), "nth": F.row_number().over(same.orderBy("msg_idx", "unit_pos"))})
    middle = F.col("norm").isNotNull() & (F.col("size") >= REPEATS) & (F.col("nth") > 1) & (F.col("nth") < F.col("size"))
    return rows.withColumn("repeated", middle).drop("peers", "norm", "size", "nth")


def signals(units: DataFrame) -> DataFrame:
    """The units with one boolean column for each reason, and `recency`."""
    rows = repetition(units)
    text = X.normalize_apostrophes(F.col("text"))
    rows = rows.withColumn("reports", (F.col("kind") != "log") & X.mentions_failure(F.col("text")))
    message, thread = Window.partitionBy("thread_id", "msg_idx"), Window.partitionBy("thread_id")
    rows = rows.withColumn("failing", F.max(F.col("has_error") | F.col("reports")).over(message))
    last = F.max("msg_idx").over(thread)
    rows = rows.withColumn("recency", F.col("msg_idx") / F.when(last == 0, 1).otherwise(last))
    named = F.size("identifiers") > 0
    context = F.col("has_error") | F.col("reports") | ((F.col("kind") == "text") & F.col("failing"))
    found = {
        "recent": F.col("recency") > RECENT,
        "user_correction": (F.col("role") == "user") & X.matches(text, P.CORRECTION),
        "active_constraint": F.col("role").isin("user", "system") & X.matches(text, P.CONSTRAINT),
        "error_severity": F.col("has_error"),
        "decision": X.matches(text, P.DECISION),
        "contains_identifier": named,
        "user_identifier": named & (F.col("role") == "user"),
        "identifier_in_failure_context": named & context,
    }
    return rows.withColumns(found).withColumn("repetitive_low_value", F.col("repeated") & ~F.col("user_correction")).drop("reports", "failing", "repeated")


def importance(units: DataFrame) -> DataFrame:
    """The units with their reasons as columns, as an array, and a score in [0, 1]."""
    rows = signals(units)
    value: Column = F.col("recency") * RECENCY
    for reason, weight in (
        ("user_correction", CORRECTED),
        ("active_constraint", CONSTRAINED),
        ("error_severity", ERROR),
        ("decision", DECIDED),
        ("contains_identifier", IDENTIFIED),
        ("identifier_in_failure_context", IDENTIFIED_IN_FAILURE),
    ):
        value = value + F.when(F.col(reason), F.lit(weight)).otherwise(0.0)
    value = F.when(F.col("repetitive_low_value"), F.greatest(F.lit(REPEAT_FLOOR), value * REPEAT_FACTOR)).otherwise(value)
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in REASONS])))
    return rows.withColumns({"score": F.least(value, F.lit(1.0)), "reasons": names})


def classify(scored: DataFrame, contradictions: DataFrame, policy: Policy = BALANCED) -> DataFrame:
    """The scored units with `level`: must_preserve, should_preserve or compressible."""
    sides = contradictions.select("thread_id", F.explode(F.array("unit_a", "unit_b")).alias("u")).select("thread_id", "u.msg_idx", "u.unit_pos").distinct().withColumn("disputed", F.lit(True))
    rows = scored.join(sides, ["thread_id", "msg_idx", "unit_pos"], "left")
    fixed = F.coalesce("disputed", F.lit(False)) | F.col("user_correction") | F.col("user_identifier") | F.col("identifier_in_failure_context")
    must = (F.col("score") >= policy.must) | (F.col("error_severity") & (F.col("score") >= policy.error_must))
    level = F.when(fixed, "must_preserve").when(F.col("repetitive_low_value"), "compressible").when(must, "must_preserve").when(F.col("score") >= policy.should, "should_preserve").otherwise("compressible")
    return rows.withColumn("level", level).drop("disputed")
