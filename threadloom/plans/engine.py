"""The whole plan: trigger, analysis, compaction, summary or fallback, events and lineage links."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError
from threadloom.functions import patterns as P
from threadloom.functions import text as X
from threadloom.operators import compaction, rewrite, scoring
from threadloom.operators import facts as K
from threadloom.operators import units as U
from threadloom.operators import windows as W
from threadloom.operators.lineage import RELATION
from threadloom.operators.tokens import TOKENS_PER_MESSAGE, Budget, Counter, bytes_quarter, message_tokens, parse_keep, parse_trigger, trigger_decisions
from threadloom.sources.messages import FACTS, MESSAGE
from threadloom.sources.storage import materialize, settle


@dataclass(frozen=True)
class Config:
    """Options of a summarization; wrong ones raise ConfigurationError at once."""

    trigger: object = None
    keep: tuple = ("messages", 20)
    budget: Budget = field(default_factory=Budget)
    policy: scoring.Policy = scoring.BALANCED
    parsing: U.ParsingOptions = U.DEFAULT_OPTIONS
    counter: Counter = bytes_quarter
    tokens_per_message: int = TOKENS_PER_MESSAGE
    trim_tokens: int | None = 4_000
    validation: bool = True

    def __post_init__(self):
        parse_trigger(self.trigger)
        parse_keep(self.keep, self.budget.window)
        for name, kind in (("budget", Budget), ("policy", scoring.Policy), ("parsing", U.ParsingOptions)):
            if not isinstance(getattr(self, name), kind):
                raise ConfigurationError(f"{name} must be a {kind.__name__}")
        if self.trim_tokens is not None and (isinstance(self.trim_tokens, bool) or not isinstance(self.trim_tokens, int) or self.trim_tokens <= 0):
            raise ConfigurationError("trim_tokens must be a positive integer or None")
        if not callable(self.counter) or not isinstance(self.validation, bool):
            raise ConfigurationError("counter must be callable and validation a bool")
        if getattr(self.counter, "rows_only", False):
            raise ConfigurationError("counter must be made of column functions, not of Python")

    @property
    def window(self) -> tuple[str, int]:
        return parse_keep(self.keep, self.budget.window)


DEFAULT = Config()


@dataclass(frozen=True)
class Prepared:
    """What is known of the threads that fire: all frames are keyed by thread_id."""

    messages: DataFrame
    units: DataFrame
    contradictions: DataFrame
    facts: DataFrame
    changed: DataFrame


@dataclass(frozen=True)
class Result:
    """Rewritten messages, one event per rewritten thread, and links from summaries to what they replace."""

    outcomes: DataFrame
    messages: DataFrame
    events: DataFrame
    links: DataFrame


def analyze(messages: DataFrame, config: Config = DEFAULT) -> Prepared:
    """Units with scores and levels, contradictions, facts, compacted units and the messages after compaction."""
    # each of these has several readers, and the text work before it is the costly part
    scored = materialize(scoring.importance(U.units(messages, config.parsing)), "scored")
    conflicts = materialize(K.contradictions(scored), "conflicts")
    classified = materialize(scoring.classify(scored, conflicts, config.policy), "classified")
    changed = materialize(compaction.compact(classified, config.policy, config.parsing), "changed")
    return Prepared(compaction.rebuild(messages, classified, changed), classified, conflicts, K.facts(classified, conflicts, messages), changed)


def _threads(messages: DataFrame, decisions: DataFrame, config: Config) -> DataFrame:
    """One row for each thread that fires, with its prepared messages, facts and counts."""
    fired = messages.join(decisions.select("thread_id"), "thread_id", "left_semi")
    ready = analyze(fired, config)
    msgs = W.gather(message_tokens(ready.messages, config.counter, config.tokens_per_message))
    per_unit = ready.units.groupBy("thread_id").agg(F.sum((F.col("level") == "must_preserve").cast("int")).alias("must_units"))
    squeezed = ready.changed.groupBy("thread_id").agg(F.count("*").alias("compacted"))
    rows = msgs.join(decisions, "thread_id")
    for part in (K.gather_facts(ready.facts), per_unit, squeezed, U.kind_counts(ready.units)):
        rows = rows.join(part, "thread_id", "left")
    return rows.withColumns(
        {
            "facts": F.coalesce("facts", F.expr("array()").cast(FACTS)),
            "must_units": F.coalesce("must_units", F.lit(0)),
            "compacted": F.coalesce("compacted", F.lit(0)),
            "content_kinds": F.coalesce("content_kinds", F.expr("map()").cast("map<string,int>")),
        }
    )


def outcomes(messages: DataFrame, model: rewrite.Model, config: Config = DEFAULT) -> DataFrame:
    """One row for each thread that is rewritten; threads that do not fire, or fire with nothing to do, give none.

    The analysis and the model's replies are stored once in the shared folder:
    a lost executor then costs neither, and no later reader asks the model again.
    """
    decisions = trigger_decisions(messages, config.trigger, config.budget, counter=config.counter, overhead=config.tokens_per_message)
    rows = materialize(_threads(messages, decisions, config), "threads")
    rows = settle(rows, lead=rewrite.system_count(F.col("msgs")))
    rows = settle(rows, talk=W.rest(F.col("msgs"), F.col("lead")))
    rows = W.with_cutoff(rows, config.window, "talk")
    rows = settle(rows, old=rewrite.transcript(W.head(F.col("talk"), F.col("cut"))))
    asked = rewrite.fit(F.col("old"), config.trim_tokens, config.counter, config.tokens_per_message)
    rows = materialize(settle(rows, asked=asked).withColumn("reply", F.when(F.col("cut") > 0, model(F.col("asked")))).drop("old", "asked"), "replies")
    said = F.coalesce(F.col("reply").rlike(P.NOT_SPACE), F.lit(False))
    path = F.when(F.col("cut") == 0, F.when(F.col("compacted") > 0, "compacted")).when(said, "summarized").otherwise("fallback")
    rows = rows.withColumn("path", path).filter("path is not null")
    none = F.expr("array()").cast("array<string>")
    summarized = rows.filter("path <> 'fallback'")
    stays = F.when(F.col("path") == "compacted", F.col("msgs")).otherwise(F.concat(W.head(F.col("msgs"), F.col("lead")), W.rest(F.col("talk"), F.col("cut"))))
    text = F.when(F.col("path") == "summarized", F.concat(F.lit(rewrite.SUMMARY_PREFIX), X.strip(F.col("reply"))))
    summarized = settle(summarized, kept=stays, text=text)
    summarized = settle(summarized, gone=rewrite.lost(F.col("msgs"), F.col("kept")))
    summarized = summarized.withColumn("source_ids", F.when(F.col("text").isNotNull(), rewrite.message_ids(F.col("gone"))).otherwise(none))
    # a summary replaces by id; a fallback's links name every message that is gone from its place
    trimmed = rewrite.with_fallback(rows.filter("path = 'fallback'"), config.window)
    absent = F.filter("msgs", lambda m: ~F.exists("kept", lambda k: k["msg_idx"] == m["msg_idx"]))
    trimmed = settle(trimmed, gone=rewrite.lost(F.col("msgs"), F.col("kept")), source_ids=rewrite.message_ids(absent))
    rows = summarized.unionByName(trimmed)
    made = F.col("text").isNotNull()
    rows = settle(rows, kept=rewrite.plain(F.col("kept")), generation=F.when(made, rewrite.generation(F.col("gone"))).otherwise(0), replaced=rewrite.replaced_ids(F.col("gone")))
    rows = settle(rows, summary_id=F.when(made, rewrite.summary_id(F.col("thread_id"), F.col("generation"), F.col("source_ids"))))
    new = rewrite.summary_message(F.col("text"), F.col("summary_id"), F.col("generation"), F.col("replaced"), F.col("facts"))
    rows = settle(rows, draft=F.when(made, rewrite.insert_after_system(F.col("kept"), new)).otherwise(F.col("kept")))
    checked = F.lit(config.validation) & (F.col("path") == "summarized")
    rows = settle(rows, seen=F.when(checked, K.history_text(F.col("draft"))))
    rows = settle(
        rows,
        missing=F.when(checked, K.missing_facts(F.col("facts"), F.col("seen"))).otherwise(F.expr("array()").cast(FACTS)),
        orphans=F.when(checked, W.orphaned_tool_results(F.col("draft"))).otherwise(none),
    )
    rows = rewrite.with_restated(rows, "draft", "missing", "out")
    lacking, orphaned = F.size("missing") > 0, F.size("orphans") > 0
    status = F.when(F.col("path") == "fallback", "skipped").when(orphaned, "failed_unrecovered").when(lacking, "failed_recovered").otherwise("passed" if config.validation else "disabled")
    recovery = F.when(F.col("path") == "fallback", "trimmed_fallback").when(lacking, "restated_facts").when(orphaned, "none_applicable").otherwise("none_needed")
    rows = rows.withColumns({"validation_status": status, "recovery_status": recovery})
    return rows.drop("talk", "gone", "draft", "seen", "kept").withColumn("out", F.transform("out", lambda m, i: rewrite.as_message(m, msg_idx=i)))


def events(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One content-free row for each outcome."""
    output = rewrite.tokens_of(F.col("out"), config.counter, config.tokens_per_message)
    prepared = F.when(F.col("compacted") > 0, W.total_tokens(F.col("msgs"))).otherwise(F.col("tokens"))
    rows = rows.withColumn("output_tokens", output)
    return rows.select(
        "thread_id", "summary_id", "generation", F.col("reason").alias("trigger_reason"), F.col("messages").alias("input_messages"), F.col("tokens").alias("input_tokens"), F.lit(config.budget.available).cast("long").alias("available_tokens"),
        F.col("overflow").alias("overflow_tokens"), prepared.alias("prepared_tokens"), F.size("out").cast("long").alias("output_messages"), "output_tokens",
        F.when(F.col("tokens") == 0, 0.0).otherwise(F.col("output_tokens") / F.col("tokens")).alias("compression_ratio"), F.col("compacted").cast("long").alias("compacted_units"),
        F.col("must_units").cast("long").alias("must_preserve_units"), F.size("facts").cast("long").alias("must_preserve_facts"), "content_kinds", "validation_status", "recovery_status", F.lit(config.policy.name).alias("policy"),
    )


def links(rows: DataFrame) -> DataFrame:
    """Rows (thread_id, source_id, target_id, relation) from every replaced message to the summary."""
    made = rows.filter("summary_id is not null").select("thread_id", F.explode("source_ids").alias("source_id"), F.col("summary_id").alias("target_id"))
    return made.withColumn("relation", F.lit(RELATION))


def summarize(messages: DataFrame, model: rewrite.Model, config: Config = DEFAULT) -> Result:
    """Rewrite every thread that fires; other threads are not in the result."""
    rows = materialize(outcomes(messages, model, config), "outcomes")
    rewritten = rows.select("thread_id", F.explode("out").alias("m")).select("thread_id", F.col("m").cast(MESSAGE).alias("m")).select("thread_id", "m.*")
    return Result(rows, rewritten, events(rows, config), links(rows))


def replace_threads(messages: DataFrame, result: Result) -> DataFrame:
    """The message table with rewritten threads in place of the old ones."""
    return messages.join(result.outcomes.select("thread_id"), "thread_id", "left_anti").unionByName(result.messages)
