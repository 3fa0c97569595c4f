"""Token accounting, budgets, triggers and kept windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError

#: Maps text to its number of tokens.
Counter = Callable[[Column], Column]
TOKENS_PER_MESSAGE = 3


def bytes_quarter(text: Column) -> Column:
    """One token for every four UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def python_counter(count: Callable[[str], int]) -> Counter:
    """A counter from a Python function of one text, such as a tokenizer's, called in Arrow batches; a null text costs nothing.

    For rows only (message_tokens, thread_tokens, trigger_decisions): Spark runs
    no Python inside the array functions that rewrite a history, so Config refuses it.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else int(count(t)) for t in texts], dtype="int64")

    def counter(text: Column) -> Column:
        return counted(text)

    counter.rows_only = True
    return counter


def counted_text(content, name, tool_calls) -> Column:
    """What a message costs tokens for: content, author and calls, a line each."""
    calls = F.transform(tool_calls, lambda c: F.concat(c["name"], F.lit(" "), c["arguments"]))
    author = F.when(F.coalesce(name, F.lit("")) != "", F.array(name)).otherwise(F.expr("array()").cast("array<string>"))
    return F.array_join(F.concat(F.array(content), author, F.coalesce(calls, F.expr("array()").cast("array<string>"))), "\n")


def message_cost(m: Column | None = None, counter: Counter = bytes_quarter, overhead: int = TOKENS_PER_MESSAGE) -> Column:
    """Tokens of the message in a row, or of a message struct."""
    field = (lambda n: F.col(n)) if m is None else (lambda n: m[n])
    return counter(counted_text(field("content"), field("name"), field("tool_calls"))) + F.lit(overhead)


def message_tokens(messages: DataFrame, counter: Counter = bytes_quarter, overhead: int = TOKENS_PER_MESSAGE) -> DataFrame:
    """The messages with a column `tokens`."""
    return messages.withColumn("tokens", message_cost(None, counter, overhead))


def thread_tokens(messages: DataFrame, **options) -> DataFrame:
    """Rows (thread_id, messages, tokens)."""
    return message_tokens(messages, **options).groupBy("thread_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def _whole(value: object, name: str, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ConfigurationError(f"{name} must be an integer of {least} or more, not {value!r}")


@dataclass(frozen=True)
class Budget:
    """How a context window is shared out; `available` tokens are left for messages."""

    window: int = 128_000
    reserved_output: int = 4_000
    safety_margin: float = 0.10
    overhead: int = 2_000

    def __post_init__(self):
        _whole(self.window, "window", 1)
        _whole(self.reserved_output, "reserved_output", 0)
        _whole(self.overhead, "overhead", 0)
        if isinstance(self.safety_margin, bool) or not isinstance(self.safety_margin, (int, float)) or not 0 <= self.safety_margin < 1:
            raise ConfigurationError("safety_margin must be a number in [0, 1)")
        if self.available <= 0:
            raise ConfigurationError(f"nothing of the window of {self.window} tokens is left for messages")

    @property
    def available(self) -> int:
        return self.window - self.reserved_output - round(self.window * self.safety_margin) - self.overhead


def parse_keep(keep, window: int) -> tuple[str, int]:
    """A kept window as ("messages", n) or ("tokens", n); a fraction is one of the context window."""
    kind, amount = keep if isinstance(keep, tuple) and len(keep) == 2 else (None, None)
    number = isinstance(amount, (int, float)) and not isinstance(amount, bool)
    if kind in ("messages", "tokens") and number and isinstance(amount, int) and amount > 0:
        return kind, amount
    if kind == "fraction" and number and 0 < amount <= 1:
        return "tokens", max(1, int(window * amount))
    raise ConfigurationError(f"keep must be ('messages' or 'tokens', n) or ('fraction', f), not {keep!r}")


_KINDS = ("tokens", "messages", "fraction")


def _condition(kind: str, value) -> tuple[str, float]:
    if kind not in _KINDS or isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ConfigurationError(f"unusable trigger condition ({kind!r}, {value!r})")
    if (kind == "fraction" and not 0 < value <= 1) or (kind != "fraction" and (not isinstance(value, int) or value <= 0)):
        raise ConfigurationError(f"unusable threshold {value!r} of a {kind} trigger")
    return kind, value


def parse_trigger(spec) -> list[list[tuple[str, float]]] | None:
    """A trigger as alternatives of conditions that must all hold; None means the budget decides.

    A pair is one condition, a mapping several at once (tokens, messages,
    fraction in this order), a list any of such.
    """
    if spec is None:
        return None
    if isinstance(spec, Sequence) and not isinstance(spec, (tuple, str)):
        if not spec:
            raise ConfigurationError("a list of triggers must not be empty")
        return [clause for item in spec for clause in parse_trigger(item if item is not None else ())]
    if isinstance(spec, tuple) and len(spec) == 2:
        return [[_condition(*spec)]]
    if isinstance(spec, Mapping) and spec and set(spec) <= set(_KINDS):
        return [[_condition(k, spec[k]) for k in _KINDS if k in spec]]
    raise ConfigurationError(f"unusable trigger {spec!r}")


def trigger_columns(trigger, budget: Budget, tokens: Column, messages: Column) -> tuple[Column, Column]:
    """Reason (null: not triggered) and overflow for totals of a thread.

    Budget mode fires strictly above the budget, conditions at their threshold.
    """
    clauses = parse_trigger(trigger)
    text = lambda v: v.cast("string")
    if clauses is None:
        over = tokens > budget.available
        return F.when(over, F.concat(text(tokens), F.lit(f" tokens exceed the {budget.available}-token input budget"))), F.when(over, tokens - budget.available)
    reason, overflow = F.lit(None).cast("string"), F.lit(None).cast("long")
    for clause in reversed(clauses):
        holds, said, limits = [], [], []
        for kind, value in clause:
            if kind == "messages":
                holds.append(messages >= value)
                said.append(F.concat(text(messages), F.lit(f" messages >= {value}")))
                continue
            limit = round(budget.window * value) if kind == "fraction" else value
            limits.append(limit)
            holds.append(tokens >= limit)
            said.append(F.concat(text(tokens), F.lit(f" tokens >= {limit}")))
        above = F.greatest(*[tokens - x for x in limits], F.lit(0)) if limits else F.lit(0)
        above = F.when(above == 0, F.greatest(tokens - budget.available, F.lit(0))).otherwise(above).cast("long")
        fired = reduce(lambda a, b: a & b, holds)
        reason = F.when(fired, F.concat_ws(" and ", *said)).otherwise(reason)
        overflow = F.when(fired, above).otherwise(overflow)
    return reason, overflow


def trigger_decisions(messages: DataFrame, trigger=None, budget: Budget = Budget(), **options) -> DataFrame:  # noqa: B008
    """Rows (thread_id, messages, tokens, reason, overflow) of the threads that fire."""
    totals = thread_tokens(messages, **options)
    reason, overflow = trigger_columns(trigger, budget, F.col("tokens"), F.col("messages"))
    return totals.withColumns({"reason": reason, "overflow": overflow}).filter("reason is not null")


def positions(messages: DataFrame) -> DataFrame:
    """The messages with `pos` (0, 1, ...) in their thread and `n`, its size."""
    own = Window.partitionBy("thread_id")
    return messages.withColumns({"pos": F.row_number().over(own.orderBy("msg_idx")) - 1, "n": F.count("*").over(own)})


def suffix_starts(rows: DataFrame, budget: Column) -> DataFrame:
    """Rows (thread_id, start): the first pos whose suffix fits `budget` tokens; n if none does.

    rows: thread_id, pos, n, tokens. One running sum from the end.
    """
    back = Window.partitionBy("thread_id").orderBy(F.desc("pos"))
    fits = F.when(F.sum("tokens").over(back) <= budget, F.col("pos"))
    return rows.withColumn("fit", fits).groupBy("thread_id").agg(F.coalesce(F.min("fit"), F.max("n")).cast("int").alias("start"))
