"""Message tables: schema, loaders, and adapters for exported chat formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError
from threadloom.functions.text import literal_map

ROLES = ("system", "user", "assistant", "tool")
TOOL_CALLS = "array<struct<id:string,name:string,arguments:string>>"
FACTS = "array<struct<statement:string,required:array<string>>>"
LINEAGE = f"struct<summary_id:string,generation:int,source_summary_ids:array<string>,facts:{FACTS}>"
MESSAGE = f"struct<msg_idx:int,role:string,content:string,id:string,name:string,tool_calls:{TOOL_CALLS},tool_call_id:string,rewritable:boolean,lineage:{LINEAGE}>"
#: Columns of a message table besides thread_id, with the values of missing ones.
DEFAULTS = {
    "msg_idx": ("int", None),
    "role": ("string", None),
    "content": ("string", "''"),
    "id": ("string", None),
    "name": ("string", None),
    "tool_calls": (TOOL_CALLS, "array()"),
    "tool_call_id": ("string", None),
    "rewritable": ("boolean", "true"),
    "lineage": (LINEAGE, None),
}
#: Role names of exported chat objects.
CHAT_ROLES = {"human": "user", "user": "user", "ai": "assistant", "assistant": "assistant", "system": "system", "developer": "system", "tool": "tool"}


def as_messages(df: DataFrame) -> DataFrame:
    """A message table from any frame with thread_id, msg_idx, role and content.

    Missing columns get their defaults; null contents are empty; null tool calls
    none; other columns are dropped. A role that is none of ROLES, null included, raises at run time.
    """
    missing = {"thread_id", "msg_idx", "role", "content"} - set(df.columns)
    if missing:
        raise ConfigurationError(f"messages lack {sorted(missing)}")
    out = [F.col("thread_id")]
    for name, (kind, default) in DEFAULTS.items():
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if default is not None:
            value = F.coalesce(value, F.expr(default).cast(kind))
        out.append((_known_role(value) if name == "role" else value).alias(name))
    return df.select(*out)


def _known_role(role: Column) -> Column:
    bad = F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))
    return F.when(role.isin(*ROLES), role).otherwise(F.raise_error(bad).cast("string"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as messages; ids are conversation and turn."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return as_messages(
        table.select(
            F.col("conv_id").alias("thread_id"), F.col("turn").cast("int").alias("msg_idx"), "role", F.col("text").alias("content"), F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("id")
        )
    )


def agent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent thread per user of events: orders, a log as tool result, claims, corrections."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    failed = F.col("event_type") == "error"
    stamp = F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    line = F.concat(
        stamp,
        F.when(failed, "Z ERROR worker-").otherwise("Z INFO worker-"),
        F.col("user_id").cast("string"),
        F.when(failed, " failed request_id=req-").otherwise(" handled batch "),
        F.col("event_id").cast("string"),
        F.lit("\n"),
    )
    logs = events.select("user_id", "event_id", line.alias("line")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "").alias("log"))
    first = F.min(F.struct("o_orderkey", "o_orderstatus"))
    last = F.max(F.struct("o_orderkey", "o_orderstatus"))
    claims = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(first.alias("a"), last.alias("b"))
    own = logs.join(claims, "user_id")
    user = F.col("user_id")
    name = user.cast("string")
    call = F.concat(F.lit("c-"), name)
    correction = F.concat(F.lit("No, use customer "), (user + 1).cast("string"), F.lit(" instead of customer "), name, F.lit("."))

    def message(idx, role, content, calls=None, answers=None, when=None):
        calls = F.array(F.struct(calls.alias("id"), F.lit("order_status").alias("name"), F.lit("{}").alias("arguments"))) if calls is not None else F.expr("array()")
        row = F.struct(F.lit(idx).alias("msg_idx"), F.lit(role).alias("role"), content.alias("content"), calls.cast(TOOL_CALLS).alias("tool_calls"), (answers if answers is not None else F.lit(None).cast("string")).alias("tool_call_id"))
        return row if when is None else F.when(when, row)

    rows = F.array(
        message(0, "system", F.lit("You are a support agent. Always cite the order key.")),
        message(1, "user", F.concat(F.lit("Check order ORD-"), F.lpad(F.col("a.o_orderkey").cast("string"), 6, "0"), F.lit(" for customer "), name, F.lit("."))),
        message(2, "assistant", F.lit(""), calls=call),
        message(3, "tool", F.concat(F.lit("status="), F.col("a.o_orderstatus"), F.lit("\n"), F.col("log")), answers=call),
        message(4, "assistant", F.concat(F.lit("The carrier reports status: "), F.col("b.o_orderstatus"), F.lit(", and I recommend a retry."))),
        message(5, "user", F.when(user % 3 == 0, correction).otherwise("You must never refund twice.")),
        message(6, "tool", F.lit("late result"), answers=F.concat(F.lit("gone-"), name), when=user % 7 == 0),
        message(7, "user", F.lit("What should we do next?")),
    )
    found = own.select(user.alias("thread_id"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("m")).select("thread_id", "m.*")
    return as_messages(found.withColumn("id", F.concat_ws("-", F.lit("m"), "thread_id", "msg_idx")))


def read_lineage(record: Column, message_id: Column) -> Column:
    """Lineage from a JSON record, tolerating damage.

    Malformed fields fall back to those of a first summary, malformed facts are
    left out. A record that is not null but unreadable is still a summary's.
    """
    raw = lambda path: F.get_json_object(record, path)
    sid = raw("$.summary_id")
    named = F.regexp_like(record, F.lit(r'(?s)"summary_id"\s*:\s*"[^"]')) & (sid != "")
    count = F.when(F.regexp_like(raw("$.generation"), F.lit(r"^[1-9][0-9]{0,8}$")) & ~F.regexp_like(record, F.lit(r'"generation"\s*:\s*"')), raw("$.generation").cast("int"))
    elements = lambda path: F.coalesce(F.from_json(raw(path), "array<string>"), F.expr("array()").cast("array<string>"))
    sources = F.filter(elements("$.source_summary_ids"), lambda s: s.isNotNull())
    facts = F.coalesce(F.from_json(raw("$.facts"), FACTS), F.expr("array()").cast(FACTS))
    good = F.filter(
        facts,
        lambda f: f.isNotNull() & f["statement"].isNotNull() & (F.coalesce(F.size(f["required"]), F.lit(0)) > 0) & F.coalesce(F.forall(f["required"], lambda r: r.isNotNull() & r.rlike(r"\S")), F.lit(False)),
    )
    lineage = F.struct(F.when(named, sid).otherwise(message_id).alias("summary_id"), F.coalesce(count, F.lit(1)).alias("generation"), sources.alias("source_summary_ids"), good.alias("facts"))
    return F.when(record.isNotNull(), lineage.cast(LINEAGE))


def write_lineage(lineage: Column) -> Column:
    """The JSON record of a lineage."""
    return F.when(lineage.isNotNull(), F.to_json(lineage))


def from_chat_json(df: DataFrame, column: str = "native") -> DataFrame:
    """Messages from rows (thread_id, msg_idx, <column>) of chat objects as JSON text.

    Reads role or type (unknown: user), content, id, name, tool_calls (with
    `function` or flat), tool_call_id and a lineage record, its own or one under
    additional_kwargs. Content that is not text makes the message not rewritable.
    """
    native = F.col(column)
    field = lambda name: F.get_json_object(native, f"$.{name}")
    role = F.coalesce(F.element_at(literal_map(CHAT_ROLES), F.coalesce(field("role"), field("type"))), F.lit("user"))
    calls = F.from_json(field("tool_calls"), "array<struct<id:string,name:string,args:string,function:struct<name:string,arguments:string>>>")
    calls = F.transform(calls, lambda c: F.struct(F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(c["function"]["name"], c["name"]).alias("name"), F.coalesce(c["function"]["arguments"], c["args"], F.lit("{}")).alias("arguments")))
    plain = ~F.regexp_like(native, F.lit(r'"content"\s*:\s*[\[{]'))
    parts = F.from_json(field("content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")
    content = F.coalesce(F.when(plain, field("content")).otherwise(joined), F.lit(""))
    return as_messages(
        df.select(
            "thread_id", "msg_idx", role.alias("role"), content.alias("content"), field("id").alias("id"), field("name").alias("name"), F.coalesce(calls, F.expr("array()").cast(TOOL_CALLS)).alias("tool_calls"),
            field("tool_call_id").alias("tool_call_id"), plain.alias("rewritable"), read_lineage(F.coalesce(field("lineage"), field("additional_kwargs.lineage")), field("id")).alias("lineage"),
        )
    )


def to_chat_json(messages: DataFrame) -> DataFrame:
    """Rows (thread_id, msg_idx, native): each message as a chat object; empty fields are left out."""
    calls = F.transform("tool_calls", lambda c: F.struct(c["id"].alias("id"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    marked = F.when(F.col("lineage").isNotNull(), F.lit("summarization"))
    native = F.to_json(F.struct("role", "content", "id", "name", F.when(F.size("tool_calls") > 0, calls).alias("tool_calls"), "tool_call_id", marked.alias("source"), F.col("lineage").alias("lineage")))
    return messages.select("thread_id", "msg_idx", native.alias("native"))
