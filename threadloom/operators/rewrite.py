"""Rewriting threads: summary, validation, restated facts, and the fallback without a model.

Works on rows (thread_id, msgs, facts) with msgs from windows.gather(); all of it
is projection, so a rewrite adds no shuffle.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import text as X
from threadloom.operators import windows as W
from threadloom.operators.facts import SEPARATOR, history_text, missing_facts
from threadloom.operators.tokens import Counter, bytes_quarter, message_cost
from threadloom.sources.messages import FACTS, LINEAGE, MESSAGE, TOOL_CALLS
from threadloom.sources.storage import settle

# The texts that rewritten histories carry.
SUMMARY_PREFIX = "Summary of the conversation so far:\n\n"
TRIM_MARKER = "\n[... earlier messages trimmed to fit the summary budget ...]\n"
FACTS_HEADING = "Facts preserved verbatim from the earlier conversation:"
REQUEST_HEADING = "The latest user request was:"
FALLBACK_NOTICE = "Earlier messages were removed because the summary model was unavailable."

#: Maps the transcript of the old messages to a summary; null or blank means that the model failed.
Model = Callable[[Column], Column]
_FIELDS = ("msg_idx", "role", "content", "id", "name", "tool_calls", "tool_call_id", "rewritable", "lineage")


def scripted(reply: str) -> Model:
    """A model that always answers the same."""
    return lambda _: F.lit(reply)


def failing() -> Model:
    return lambda _: F.lit(None).cast("string")


def python_model(reply: Callable[[str], str | None], propagate: tuple[type[BaseException], ...] = ()) -> Model:
    """A model from a Python function of one transcript.

    What it raises is logged and makes that thread's model fail, but errors of
    the types `propagate` end the job.
    """

    def ask(text: str | None) -> str | None:
        try:
            return None if text is None else reply(text)
        except propagate:
            raise
        except Exception:  # noqa: BLE001
            logging.getLogger("threadloom").warning("the summary model failed; trimming to the window", exc_info=True)
            return None

    @F.pandas_udf(T.StringType())
    def asked(texts: pd.Series) -> pd.Series:
        return texts.map(ask, na_action=None)

    return lambda text: asked(text)


def as_message(m: Column, **changes: Column) -> Column:
    """The message struct with some fields replaced, without columns that were added to it."""
    return F.struct(*[(changes[f] if f in changes else m[f]).alias(f) for f in _FIELDS]).cast(MESSAGE)


def summary_message(content: Column, summary_id: Column, generation: Column, sources: Column, fact_list: Column) -> Column:
    lineage = F.struct(summary_id.alias("summary_id"), generation.alias("generation"), sources.alias("source_summary_ids"), fact_list.cast(FACTS).alias("facts")).cast(LINEAGE)
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(0).alias("msg_idx"), F.lit("user").alias("role"), content.alias("content"), summary_id.alias("id"), none.alias("name"), F.expr("array()").cast(TOOL_CALLS).alias("tool_calls"),
        none.alias("tool_call_id"), F.lit(True).alias("rewritable"), lineage.alias("lineage"),
    ).cast(MESSAGE)


def transcript(msgs: Column) -> Column:
    """The messages as XML, a line each."""

    def attribute(name, value):
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f" {name}="), X.quote_attribute(value))).otherwise("")

    def call(c):
        return F.concat(F.lit("\n<tool_call id="), X.quote_attribute(c["id"]), F.lit(" name="), X.quote_attribute(c["name"]), F.lit(">"), X.escape_xml(c["arguments"]), F.lit("</tool_call>"))

    def message(m):
        summary = F.when(m["lineage"].isNotNull(), ' summary="true"').otherwise("")
        opening = F.concat(F.lit("<message role="), X.quote_attribute(m["role"]), attribute("name", m["name"]), attribute("tool_call_id", m["tool_call_id"]), summary, F.lit(">"))
        return F.concat(opening, X.escape_xml(m["content"]), F.array_join(F.transform(m["tool_calls"], call), ""), F.lit("</message>"))

    return F.array_join(F.transform(msgs, message), "\n")


def fit(text: Column, limit: int | None, counter: Counter = bytes_quarter, overhead: int = 3) -> Column:
    """The text without its middle, if it is over the limit: a quarter of what stays from the start, the rest from the end."""
    if limit is None:
        return text
    tokens = counter(text) + overhead
    keep = F.floor(F.length(text) * limit / tokens).cast("int")
    start = F.floor(keep / 4).cast("int")
    end = keep - start
    short = F.concat(F.substr(text, F.lit(1), start), F.lit(TRIM_MARKER), F.substr(text, F.length(text) - end + 1, end))
    return F.when(tokens <= limit, text).otherwise(short)


def concise(fact_list: Column) -> Column:
    """Facts without those that a longer statement of another one already states, in their order."""
    numbered = F.transform(fact_list, lambda f, i: F.struct(F.length(f["statement"]).alias("chars"), i.alias("at"), f.alias("fact")))
    longest = F.array_sort(numbered, lambda a, b: F.when(a["chars"] != b["chars"], b["chars"] - a["chars"]).otherwise(a["at"] - b["at"]))
    start = F.struct(F.lit("").alias("stated"), F.expr("array()").cast("array<int>").alias("kept"))

    def step(s, n):
        known = X.is_stated(n["fact"]["required"], s["stated"])
        return F.struct(
            F.when(known, s["stated"]).otherwise(F.concat(s["stated"], F.lit(SEPARATOR), X.canonical(n["fact"]["statement"]))).alias("stated"),
            F.when(known, s["kept"]).otherwise(F.concat(s["kept"], F.array(n["at"]))).alias("kept"),
        )

    kept = F.aggregate(longest, start, step, lambda s: s["kept"])
    return F.transform(F.array_sort(kept), lambda i: F.get(fact_list, i))


def bulleted(fact_list: Column) -> Column:
    """The facts as a section with a bullet for each statement."""
    bullets = F.array_join(F.transform(fact_list, lambda f: F.concat(F.lit("- "), f["statement"])), "\n")
    return F.concat(F.lit(FACTS_HEADING + "\n"), bullets)


def system_count(msgs: Column) -> Column:
    return W.prefix_length(msgs, lambda m: m["role"] == "system")


def with_restated(df: DataFrame, msgs: str, missing: str, name: str) -> DataFrame:
    """df with the missing facts added to the first summary that may be rewritten, or to a new one after the system messages."""
    m = F.col(msgs)
    df = settle(df, __kept=concise(F.col(missing)), __at=F.array_position(F.transform(m, lambda x: x["lineage"].isNotNull() & x["rewritable"]), True) - 1, __lead=system_count(m))
    df = settle(df, __block=bulleted(F.col("__kept")))
    block, at, lead = F.col("__block"), F.col("__at"), F.col("__lead")
    changed = F.transform(m, lambda x, i: F.when(i == at, as_message(x, content=F.concat(x["content"], F.lit("\n\n"), block))).otherwise(as_message(x)))
    df = settle(df, __changed=changed)
    new = summary_message(block, F.lit(""), F.lit(1), F.expr("array()").cast("array<string>"), F.expr("array()").cast(FACTS))
    inserted = F.concat(W.head(F.col("__changed"), lead), F.array(new), W.rest(F.col("__changed"), lead))
    out = F.when(F.size(missing) == 0, m).when(at >= 0, F.col("__changed")).otherwise(inserted)
    return settle(df, **{name: out}).drop("__kept", "__at", "__lead", "__block", "__changed")


def lost(msgs: Column, kept: Column) -> Column:
    """Messages whose id is none of the kept messages' ids; messages without an id are lost too."""
    ids = F.filter(F.transform(kept, lambda m: m["id"]), lambda i: i.isNotNull() & (i != ""))
    return F.filter(msgs, lambda m: ~F.coalesce(F.array_contains(ids, m["id"]), F.lit(False)))


def generation(gone: Column) -> Column:
    """One more than the highest generation among replaced summaries."""
    return (F.coalesce(F.array_max(F.transform(gone, lambda m: m["lineage"]["generation"])), F.lit(0)) + 1).cast("int")


def replaced_ids(gone: Column) -> Column:
    ids = F.transform(F.filter(gone, lambda m: m["lineage"].isNotNull()), lambda m: m["lineage"]["summary_id"])
    return F.filter(ids, lambda i: F.coalesce(i, F.lit("")) != "")


def message_ids(msgs: Column) -> Column:
    return F.filter(F.transform(msgs, lambda m: m["id"]), lambda i: F.coalesce(i, F.lit("")) != "")


def summary_id(thread: Column, number: Column, seed: Column) -> Column:
    """Deterministic id from the thread, the generation and the messages that are replaced."""
    basis = F.concat_ws(SEPARATOR, F.coalesce(thread.cast("string"), F.lit("")), number.cast("string"), F.array_join(seed, ","))
    return F.concat(F.lit("threadloom-summary-"), F.substring(F.sha2(basis, 256), 1, 32))


def with_fallback(df: DataFrame, keep: tuple[str, int], msgs: str = "msgs", fact_list: str = "facts") -> DataFrame:
    """df with `kept`, the messages that stay without a model, and `text`, that of the summary they need (or null).

    The window is the trailing one, or the last tool exchange if the window lost
    it, after a leading system message. A summary is needed if the window lacks
    facts or does not open with the user; it repeats the latest request if lost.
    """
    m = F.col(msgs)
    df = W.with_trailing_exchange(W.with_trailing_window(df, keep, msgs), msgs)
    first = F.get(m, F.col("exchange"))["msg_idx"]
    whole = F.exists("kept", lambda x: x["msg_idx"] == first)
    system = F.filter(W.head(F.col("kept"), F.lit(1)), lambda x: x["role"] == "system")
    df = settle(df, kept=F.when(F.col("exchange").isNotNull() & ~whole, F.concat(system, W.rest(m, F.coalesce("exchange", F.lit(0))))).otherwise(F.col("kept")))
    asked = F.filter(m, lambda x: (x["role"] == "user") & x["lineage"].isNull())
    df = settle(df, __seen=history_text(F.col("kept")), __latest=F.get(F.reverse(asked), F.lit(0)))
    df = settle(df, missing=missing_facts(F.col(fact_list), F.col("__seen")))
    there = F.exists("kept", lambda x: x["msg_idx"] == F.col("__latest.msg_idx"))
    request = F.when(~F.coalesce(there, F.lit(True)) & (F.col("__latest.content") != ""), F.concat(F.lit(REQUEST_HEADING + "\n"), F.col("__latest.content")))
    opens = F.coalesce(F.get(F.filter("kept", lambda x: x["role"] != "system"), F.lit(0))["role"] == "user", F.lit(False))
    df = settle(df, __request=request, __opens=opens, __short=concise(F.col("missing")))
    block = F.when(F.size("missing") > 0, bulleted(F.col("__short")))
    needed = (F.size("missing") > 0) | ~F.col("__opens")
    df = settle(df, text=F.when(needed, F.concat_ws("\n\n", F.lit(FALLBACK_NOTICE), "__request", block)))
    return df.drop("exchange", "missing", "__seen", "__latest", "__request", "__opens", "__short")


def insert_after_system(msgs: Column, message: Column) -> Column:
    lead = system_count(msgs)
    return F.concat(W.head(msgs, lead), F.array(message), W.rest(msgs, lead))


def plain(msgs: Column) -> Column:
    """The messages without added columns."""
    return F.transform(msgs, lambda m: as_message(m))


def tokens_of(msgs: Column, counter: Counter = bytes_quarter, overhead: int = 3) -> Column:
    return F.aggregate(msgs, F.lit(0).cast("long"), lambda s, m: s + message_cost(m, counter, overhead))


