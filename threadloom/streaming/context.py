"""Streams of messages: running totals of threads, and summaries when a thread fires.

The operators have no notion of event time; these are additions for append-only
message streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators import rewrite
from threadloom.operators.tokens import Budget, message_tokens, trigger_columns
from threadloom.plans.engine import DEFAULT, Config, Result, summarize
from threadloom.sources.sinks import Sink, safely
from threadloom.sources.storage import scratch


def running_decisions(messages: DataFrame, trigger=None, budget: Budget = Budget()) -> DataFrame:  # noqa: B008
    """Streaming rows (thread_id, messages, tokens, reason, overflow) of threads that fire, as totals grow.

    The state is two numbers for each thread; write it in update mode.
    """
    totals = message_tokens(messages).groupBy("thread_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))
    reason, overflow = trigger_columns(trigger, budget, F.col("tokens"), F.col("messages"))
    return totals.withColumns({"reason": reason, "overflow": overflow}).filter("reason is not null")


def summarize_stream(
    messages: DataFrame,
    history: Callable[[DataFrame], DataFrame],
    commit: Callable[[DataFrame, Result], None],
    model: rewrite.Model,
    checkpoint: str,
    config: Config = DEFAULT,
    events: Sink | None = None,
) -> StreamingQuery:
    """Rewrite threads batch by batch.

    history(threads) gives the stored messages of the threads in a batch, without
    those of the batch; commit(messages, result) stores what is new and replaces
    rewritten threads. A batch may be repeated after a failure, so commit must
    replace by (thread_id, msg_idx); summary ids are deterministic, so links and
    summaries of a repeated batch are the same. Scratch tables of a batch are
    deleted when it has been committed.
    """

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            known = history(batch.select("thread_id").distinct())
            both = known.join(batch.select("thread_id", "msg_idx"), ["thread_id", "msg_idx"], "left_anti").unionByName(batch)
            with scratch(batch.sparkSession):
                result = summarize(both, model, config)
                commit(batch, result)
                if events is not None:
                    safely(events)(result.events)
        finally:
            batch.unpersist()

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
