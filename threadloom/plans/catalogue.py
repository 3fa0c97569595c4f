"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import text as X
from threadloom.operators import compaction, lineage, rewrite, scoring
from threadloom.operators import facts as K
from threadloom.operators import units as U
from threadloom.operators import windows as W
from threadloom.operators.tokens import Budget, message_tokens, thread_tokens, trigger_decisions
from threadloom.plans import engine
from threadloom.plans.oracles import ORACLES as ORACLES
from threadloom.sources import sinks
from threadloom.sources.messages import agent_context, as_messages, conversations, to_chat_json
from threadloom.sources.storage import settle

UNIT = ["thread_id", "msg_idx", "unit_pos"]
#: A context window in which the threads of the test tables are large.
SMALL = Budget(window=1_000, reserved_output=50, safety_margin=0.1, overhead=20)
REWRITE = engine.Config(trigger=("messages", 7), keep=("messages", 3), budget=SMALL)
REPLY = "The user asked about an order; the carrier answered."


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.units(agent_context(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str, policy: scoring.Policy = scoring.BALANCED) -> engine.Prepared:
    return engine.analyze(agent_context(spark, sf_dir), engine.Config(policy=policy))


def tokens_of_threads(spark, sf_dir):
    return thread_tokens(conversations(spark, sf_dir))


def trigger_decision(spark, sf_dir):
    return trigger_decisions(conversations(spark, sf_dir), ("tokens", 700))


def trigger_budget(spark, sf_dir):
    return trigger_decisions(conversations(spark, sf_dir), None, SMALL)


def trigger_or_and(spark, sf_dir):
    return trigger_decisions(conversations(spark, sf_dir), [{"tokens": 500, "messages": 5}, ("messages", 7)])


def keep_messages(spark, sf_dir):
    return W.with_cutoff(W.gather(message_tokens(agent_context(spark, sf_dir))), ("messages", 5)).select("thread_id", "cut")


def keep_tokens(spark, sf_dir):
    return W.with_cutoff(W.gather(message_tokens(conversations(spark, sf_dir))), ("tokens", 400)).select("thread_id", "cut")


def trailing_window(spark, sf_dir):
    rows = W.with_trailing_window(W.gather(message_tokens(conversations(spark, sf_dir))), ("messages", 3))
    first = F.get(F.filter("kept", lambda m: m["role"] != "system"), F.lit(0))["msg_idx"]
    return rows.select("thread_id", F.size("kept").alias("kept"), first.alias("first_turn"))


def context_messages(spark, sf_dir):
    return agent_context(spark, sf_dir).select("thread_id", "msg_idx", "role", "content", F.get("tool_calls.id", F.lit(0)).alias("call_id"), "tool_call_id")


def identifiers(spark, sf_dir):
    return agent_context(spark, sf_dir).select("thread_id", "msg_idx", F.explode(X.identifiers(F.col("content"))).alias("identifier"))


def masked_text(spark, sf_dir):
    return agent_context(spark, sf_dir).select("thread_id", "msg_idx", F.sha2(X.normalize_volatile(F.col("content")), 256).alias("masked_sha256"))


def signal_flags(spark, sf_dir):
    text = X.normalize_apostrophes(F.col("content"))
    found = {"failure": X.mentions_failure(F.col("content")), "correction": X.matches(text, P.CORRECTION), "constraint": X.matches(text, P.CONSTRAINT), "decision": X.matches(text, P.DECISION)}
    return agent_context(spark, sf_dir).select("thread_id", "msg_idx", *[v.alias(k) for k, v in found.items()])


def units(spark, sf_dir):
    return _units(spark, sf_dir).select(*UNIT, "role", "kind", F.sha2("text", 256).alias("text_sha256"), "first_line", F.size("line_severities").cast("long").alias("n_lines"), "severity", "has_error")


def mixed_units(spark, sf_dir):
    """Units of one message for each customer with every kind of content, in two orders."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, poor = F.col("c_custkey").cast("string"), F.col("c_acctbal") < 0
    parts = F.array(
        F.concat(F.lit("Report for "), "c_name", F.lit(".\n\n")),
        F.concat(F.lit('{"segment": "'), "c_mktsegment", F.lit('", "level": "'), F.when(poor, "err").otherwise("info"), F.lit('"}\n')),
        F.concat(F.lit('{\n  "key": '), key, F.lit("\n}\n")),
        F.concat(F.lit("2024-01-01T00:00:00Z INFO a "), key, F.lit("\n[10:00:00] started\n")),
        F.lit('WARN slow\nlevel=warning msg="x"\n'),
        F.concat(F.lit('Traceback (most recent call last):\n  File "a.py", line '), key, F.lit(", in main\n    total = compute(order)\nValueError: bad\n")),
        F.lit("| a | b |\n|---|---|\n"),
        F.concat(F.lit("```python\nx = "), key, F.lit("\n\nprint(x)\n```\n")),
        F.lit("~~~\nplain\nFATAL b\n~~~\n"),
        F.lit("Closing prose.\n"),
    )
    ordered = F.when(F.col("c_custkey") % 2 == 0, parts).otherwise(F.reverse(parts))
    rows = c.select(F.col("c_custkey").alias("thread_id"), F.lit(0).alias("msg_idx"), F.lit("tool").alias("role"), F.array_join(ordered, "").alias("content"))
    return U.units(as_messages(rows)).select("thread_id", F.col("unit_pos").cast("long").alias("unit_pos"), "kind", F.sha2("text", 256).alias("text_sha256"), "severity", "has_error")


def kind_counts(spark, sf_dir):
    return U.kind_counts(_units(spark, sf_dir)).select("thread_id", F.explode("content_kinds").alias("kind", "units")).withColumn("units", F.col("units").cast("long"))


def severity_counts(spark, sf_dir):
    return _units(spark, sf_dir).groupBy(F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count("*").alias("units"), F.sum(F.size("line_severities")).alias("lines"))


def repetition(spark, sf_dir):
    return scoring.repetition(_units(spark, sf_dir)).filter("repeated").select(*UNIT)


def importance(spark, sf_dir):
    return scoring.importance(_units(spark, sf_dir)).select(*UNIT, "score")


def claims(spark, sf_dir):
    return K.claims(_units(spark, sf_dir)).select(*UNIT, "key", "value")


def contradictions(spark, sf_dir):
    return K.contradictions(_units(spark, sf_dir)).select("thread_id", "key", F.col("unit_a.msg_idx").alias("msg_a"), "value_a", F.col("unit_b.msg_idx").alias("msg_b"), "value_b")


def _preservation(policy: scoring.Policy):
    def query(spark, sf_dir):
        return _prepared(spark, sf_dir, policy).units.select(*UNIT, "level")

    return query


def facts(spark, sf_dir):
    return _prepared(spark, sf_dir).facts.select("thread_id", "statement")


def validation(spark, sf_dir):
    """Facts of each thread that its last three messages do not state."""
    messages = agent_context(spark, sf_dir)
    rows = W.gather(messages).join(K.gather_facts(_prepared(spark, sf_dir).facts), "thread_id")
    rows = settle(rows, seen=K.history_text(F.slice("msgs", -3, 3)))
    return rows.select("thread_id", F.size("facts").alias("facts"), F.size(K.missing_facts(F.col("facts"), F.col("seen"))).alias("missing"))


def orphan_tool_results(spark, sf_dir):
    return W.orphans_by_join(agent_context(spark, sf_dir))


def tool_exchange(spark, sf_dir):
    messages = agent_context(spark, sf_dir)
    asked = messages.select("thread_id", F.col("msg_idx").alias("call_idx"), F.explode("tool_calls.id").alias("tool_call_id"))
    results = messages.filter("role = 'tool'").select("thread_id", F.col("msg_idx").alias("result_idx"), "tool_call_id")
    return asked.join(results, ["thread_id", "tool_call_id"]).filter("call_idx < result_idx").select("thread_id", "call_idx", "result_idx")


def log_collapse(spark, sf_dir):
    return _prepared(spark, sf_dir).changed.select(*UNIT, F.sha2("new_text", 256).alias("new_sha256"), F.length("text").cast("long").alias("chars"), F.length("new_text").cast("long").alias("new_chars"))


def rebuild(spark, sf_dir):
    return _prepared(spark, sf_dir).messages.select("thread_id", "msg_idx", F.sha2("content", 256).alias("content_sha256"))


def _json(policy: scoring.Policy):
    def query(spark, sf_dir):
        """A JSON tool result for each user: the props of the user's events."""
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        props = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda e: e["props"])
        rows = events.groupBy(F.col("user_id").alias("thread_id")).agg(F.concat(F.lit("["), F.array_join(props, ", "), F.lit("]")).alias("text"))
        planned = rows.select("thread_id", F.lit(0).alias("msg_idx"), F.lit(0).alias("unit_pos"), F.lit("json").alias("kind"), "text", F.col("text").alias("document"), F.lit(True).alias("lossy"))
        done = compaction.compact_json(planned, policy).withColumnRenamed("new_text", "compacted")
        return done.select("thread_id", "compacted", F.length("compacted").alias("chars"))

    return query


def summarized_history(spark, sf_dir):
    return to_chat_json(engine.summarize(agent_context(spark, sf_dir), rewrite.scripted(REPLY), REWRITE).messages)


def fallback_history(spark, sf_dir):
    return to_chat_json(engine.summarize(agent_context(spark, sf_dir), rewrite.failing(), REWRITE).messages)


def events(spark, sf_dir):
    return engine.summarize(agent_context(spark, sf_dir), rewrite.scripted(REPLY), REWRITE).events.withColumn("content_kinds", F.to_json("content_kinds"))


def event_metrics(spark, sf_dir):
    found = sinks.metrics(engine.summarize(agent_context(spark, sf_dir), rewrite.scripted(REPLY), REWRITE).events)
    return found.withColumn("compression_ratio_mean", F.round("compression_ratio_mean", 9))


def summary_links(spark, sf_dir):
    return engine.summarize(agent_context(spark, sf_dir), rewrite.scripted(REPLY), REWRITE).links


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of a conversation become one summary, which the next summary replaces."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    number = F.floor(F.col("turn") / 2)
    summary = lambda n: F.concat_ws("-", F.lit("s"), "conv_id", n)
    own = turns.select(F.col("conv_id").alias("thread_id"), F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("source_id"), summary(number).alias("target_id"))
    chain = turns.filter("turn >= 2").select(F.col("conv_id").alias("thread_id"), summary(number - 1).alias("source_id"), summary(number).alias("target_id"))
    return own.union(chain).distinct().withColumn("relation", F.lit(lineage.RELATION))


def lineage_walk(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    wanted = edges.select("thread_id", F.col("target_id").alias("entity_id")).distinct()
    return lineage.walk(edges, wanted).select("thread_id", "root_id", "depth", "source_id", "target_id")


def lineage_delete(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return lineage.delete(edges, edges.select("thread_id"))[1]


QUERIES = {
    "thread_tokens": tokens_of_threads,
    "trigger_decision": trigger_decision,
    "trigger_budget": trigger_budget,
    "trigger_or_and": trigger_or_and,
    "keep_messages": keep_messages,
    "keep_tokens": keep_tokens,
    "trailing_window": trailing_window,
    "context_messages": context_messages,
    "identifiers": identifiers,
    "masked_text": masked_text,
    "signal_flags": signal_flags,
    "units": units,
    "mixed_units": mixed_units,
    "kind_counts": kind_counts,
    "severity_counts": severity_counts,
    "repetition": repetition,
    "importance": importance,
    "claims": claims,
    "contradictions": contradictions,
    "preservation_balanced": _preservation(scoring.BALANCED),
    "preservation_maximum_preservation": _preservation(scoring.MAXIMUM_PRESERVATION),
    "preservation_maximum_compression": _preservation(scoring.MAXIMUM_COMPRESSION),
    "facts": facts,
    "validation": validation,
    "orphan_tool_results": orphan_tool_results,
    "tool_exchange": tool_exchange,
    "log_collapse": log_collapse,
    "rebuild": rebuild,
    "json_minify": _json(scoring.MAXIMUM_PRESERVATION),
    "json_collapse": _json(scoring.BALANCED),
    "json_sample": _json(scoring.MAXIMUM_COMPRESSION),
    "summarized_history": summarized_history,
    "fallback_history": fallback_history,
    "events": events,
    "event_metrics": event_metrics,
    "summary_links": summary_links,
    "lineage_walk": lineage_walk,
    "lineage_delete": lineage_delete,
}
