"""Where a history is cut, on threads held as arrays of messages.

A thread fits into a row (it is one model context), so one aggregation gathers
it and everything after that is a projection without further shuffles. Columns
passed here should be plain ones, see storage.settle().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.sources.messages import DEFAULTS
from threadloom.sources.storage import settle

MESSAGE_FIELDS = tuple(DEFAULTS)


def gather(messages: DataFrame) -> DataFrame:
    """Rows (thread_id, msgs): all messages of a thread in order, with column `tokens` if there is one."""
    fields = [*MESSAGE_FIELDS, *(c for c in ("tokens",) if c in messages.columns)]
    in_order = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["msg_idx"] - b["msg_idx"])
    return messages.groupBy("thread_id").agg(in_order.alias("msgs"))


def prefix_length(msgs: Column, test) -> Column:
    """Number of leading messages for which test holds."""
    first = F.array_position(F.transform(msgs, lambda m: ~test(m)), True)
    return F.when(first > 0, first - 1).otherwise(F.size(msgs)).cast("int")


def rest(msgs: Column, start: Column) -> Column:
    """Messages from a place on."""
    return F.slice(msgs, start + 1, F.greatest(F.size(msgs) - start, F.lit(0)))


def head(msgs: Column, stop: Column) -> Column:
    return F.slice(msgs, 1, stop)


def total_tokens(msgs: Column) -> Column:
    return F.aggregate(msgs, F.lit(0).cast("long"), lambda s, m: s + m["tokens"])


def fitting_suffix(msgs: Column, budget: Column) -> Column:
    """First place whose suffix fits the budget: messages are taken from the end while their sum does."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

    def step(s, m):
        fits = s["open"] & (s["sum"] + m["tokens"] <= budget)
        return F.struct((s["sum"] + m["tokens"]).alias("sum"), (s["taken"] + fits.cast("int")).alias("taken"), fits.alias("open"))

    return F.size(msgs) - F.aggregate(F.reverse(msgs), start, step, lambda s: s["taken"])


def safe_cutoff(df: DataFrame, msgs: str, at: str) -> DataFrame:
    """df with the place `at` moved so that no tool result loses its call.

    On tool results it goes back to the last assistant message before it that
    asked for one of them, or forward past them if there is none.
    """
    m, place = F.col(msgs), F.col(at)
    df = settle(df, __after=rest(m, place))
    df = settle(df, __run=prefix_length(F.col("__after"), lambda x: x["role"] == "tool"))
    df = settle(df, __answered=F.transform(F.slice("__after", F.lit(1), F.col("__run")), lambda x: F.coalesce(x["tool_call_id"], F.lit(""))))
    asks = F.transform(head(m, place), lambda x, i: F.when((x["role"] == "assistant") & F.arrays_overlap(F.transform(x["tool_calls"], lambda c: c["id"]), F.col("__answered")), i))
    moved = F.when(F.col("__run") == 0, place).otherwise(F.coalesce(F.array_max(asks), place + F.col("__run"))).cast("int")
    return settle(df, **{at: moved}).drop("__after", "__run", "__answered")


def with_cutoff(df: DataFrame, keep: tuple[str, int], msgs: str = "msgs", name: str = "cut") -> DataFrame:
    """df with how many leading messages may be summarized so that the kept window stays; 0 for none."""
    kind, amount = keep
    m, n = F.col(msgs), F.size(msgs)
    if kind == "messages":
        df = settle(df, __all=n <= amount, **{name: F.greatest(n - amount, F.lit(0)).cast("int")})
    else:
        df = settle(df, __all=total_tokens(m) <= amount, **{name: F.greatest(F.least(fitting_suffix(m, F.lit(amount)), n - 1), F.lit(0)).cast("int")})
    df = safe_cutoff(df, msgs, name)
    return settle(df, **{name: F.when(F.col("__all"), 0).otherwise(F.col(name)).cast("int")}).drop("__all")


def with_trailing_window(df: DataFrame, keep: tuple[str, int], msgs: str = "msgs", name: str = "kept", start_on=("user", "assistant")) -> DataFrame:
    """df with a leading system message and the kept window from its first message with a role in start_on."""
    kind, amount = keep
    m = F.col(msgs)
    lead = F.coalesce(F.get(m, F.lit(0))["role"] == "system", F.lit(False)).cast("int")
    df = settle(df, __lead=lead)
    df = settle(df, __system=head(m, F.col("__lead")), __others=rest(m, F.col("__lead")))
    others = F.col("__others")
    if kind == "messages":
        start = F.greatest(F.size(others) - amount, F.lit(0))
    else:
        start = fitting_suffix(others, F.lit(amount) - total_tokens(F.col("__system")))
    df = settle(df, __start=start.cast("int"))
    df = settle(df, __window=rest(others, F.col("__start")))
    df = settle(df, __skip=prefix_length(F.col("__window"), lambda x: ~x["role"].isin(*start_on)))
    kept = F.concat("__system", rest(F.col("__window"), F.col("__skip")))
    return settle(df, **{name: kept}).drop("__lead", "__system", "__others", "__start", "__window", "__skip")


def orphaned_tool_results(msgs: Column) -> Column:
    """Call ids of tool results without a request in an earlier assistant message, in order."""
    start = F.struct(F.expr("array()").cast("array<string>").alias("asked"), F.expr("array()").cast("array<string>").alias("orphans"))

    def step(s, m):
        asked = F.when(m["role"] == "assistant", F.concat(s["asked"], F.transform(m["tool_calls"], lambda c: c["id"]))).otherwise(s["asked"])
        lost = (m["role"] == "tool") & ~F.coalesce(F.array_contains(s["asked"], m["tool_call_id"]), F.lit(False))
        orphans = F.when(lost, F.concat(s["orphans"], F.array(F.coalesce(m["tool_call_id"], F.lit(""))))).otherwise(s["orphans"])
        return F.struct(asked.alias("asked"), orphans.alias("orphans"))

    return F.aggregate(msgs, start, step, lambda s: s["orphans"])


def orphans_by_join(messages: DataFrame) -> DataFrame:
    """Rows (thread_id, msg_idx, tool_call_id) of tool results without an earlier request, as an anti join.

    The form for single checks over many threads: nothing is gathered per thread.
    """
    asked = messages.filter("role = 'assistant'").select("thread_id", F.col("msg_idx").alias("asked_at"), F.explode("tool_calls.id").alias("tool_call_id"))
    first = asked.groupBy("thread_id", "tool_call_id").agg(F.min("asked_at").alias("asked_at"))
    results = messages.filter("role = 'tool'").select("thread_id", "msg_idx", "tool_call_id")
    same = (results["thread_id"] == first["thread_id"]) & (results["tool_call_id"] == first["tool_call_id"]) & (first["asked_at"] < results["msg_idx"])
    return results.join(first, same, "left_anti").withColumn("tool_call_id", F.coalesce("tool_call_id", F.lit("")))


def with_trailing_exchange(df: DataFrame, msgs: str = "msgs", name: str = "exchange") -> DataFrame:
    """df with the place of the assistant call that the tool results at the end answer, or null."""
    m = F.col(msgs)
    df = settle(df, __run=prefix_length(F.reverse(m), lambda x: x["role"] == "tool"))
    df = settle(df, __at=F.size(m) - F.col("__run") - 1)
    df = settle(df, __call=F.get(m, F.col("__at")))
    good = (F.col("__run") > 0) & (F.col("__at") >= 0) & (F.col("__call.role") == "assistant") & (F.size("__call.tool_calls") > 0)
    return settle(df, **{name: F.when(good, F.col("__at"))}).drop("__run", "__at", "__call")
