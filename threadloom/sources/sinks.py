"""Where events go: files, aggregated metrics, several sinks at once."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


logger = logging.getLogger("threadloom")
TAGS = ["validation_status", "recovery_status", "policy"]
#: Writes one frame of events somewhere.
Sink = Callable[[DataFrame], None]


def json_sink(path: str) -> Sink:
    """Append one JSON record for each event."""
    return lambda events: events.write.mode("append").json(path)


def table_sink(path: str) -> Sink:
    return lambda events: events.write.mode("append").parquet(path)


def log_sink(events: DataFrame) -> None:
    """Log one record for each event, as JSON without content, on the executor that has it."""
    lines = events.select(F.to_json(F.struct("*")).alias("event"))

    def write(rows) -> None:
        log = logging.getLogger("threadloom")
        for row in rows:
            log.info("rewrote a thread: %s", row.event)

    lines.foreachPartition(write)


def metrics(events: DataFrame) -> DataFrame:
    """Counters and distributions by the three tags."""
    middle = lambda c: F.percentile(c, F.lit(0.5))
    return events.groupBy(*TAGS).agg(
        F.count("*").alias("summarizations"), F.sum("compacted_units").alias("compacted_units"), F.sum("input_tokens").alias("input_tokens_sum"), middle("input_tokens").alias("input_tokens_median"),
        F.sum("output_tokens").alias("output_tokens_sum"), middle("output_tokens").alias("output_tokens_median"), F.avg("compression_ratio").alias("compression_ratio_mean"),
    )


def histogram(events: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """Rows (tags, bucket, n): how many events lie at or below each bound but above the one before; the last bucket has no bound."""
    place = F.array_position(F.transform(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: F.col(column) <= b), True)
    bucket = F.when(place > 0, place - 1).otherwise(len(bounds)).cast("int")
    return events.groupBy(*TAGS, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def observed(events: DataFrame, name: str = "threadloom") -> tuple[DataFrame, Observation]:
    """The events, and an observation that has their totals once some sink has read all of them.

    The totals are gathered while the events pass, without a scan of their own;
    those of no events are null or 0.
    """
    seen = Observation(name)
    count = lambda where, label: F.count(F.when(where, 1)).alias(label)
    recovery = F.col("recovery_status")
    totals = (
        F.count("*").alias("summarizations"), F.sum("compacted_units").alias("compacted_units"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        count(recovery == "restated_facts", "restated"), count(recovery == "trimmed_fallback", "fallbacks"), count(F.col("validation_status") == "failed_unrecovered", "unrecovered"),
    )
    return events.observe(seen, *totals), seen


def composite(*sinks: Sink) -> Sink:
    """All sinks over one cached frame; each gets the events even if another fails, failures are raised together at the end."""

    def write(events: DataFrame) -> None:
        events = events.cache()
        failures = []
        try:
            for sink in sinks:
                try:
                    sink(events)
                except Exception as error:  # noqa: BLE001
                    failures.append(error)
        finally:
            events.unpersist()
        if failures:
            raise ExceptionGroup("sinks failed", failures)

    return write


def safely(sink: Sink) -> Sink:
    """A sink whose failures are logged: delivery never fails a run."""

    def write(events: DataFrame) -> None:
        try:
            sink(events)
        except Exception:  # noqa: BLE001
            logger.warning("events could not be delivered", exc_info=True)

    return write
