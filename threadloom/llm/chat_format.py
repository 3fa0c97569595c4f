"""Chat formatting of reply trees, native.

Messages point at the message they answer. Root-to-leaf paths are enumerated by
self-joins that double: jump table k leads 2**k replies up, and step k extends
every leaf's path by as many messages, so a path of n messages takes about
log2(n) joins and rows only in proportion to the paths' total length.

Branches of a tree are ranked by the mean score of their messages (ties: the
smaller leaf) and each chosen one becomes one conversation:

    <|role|>
    text
    </s>

per turn. In texts a backslash comes before every backslash and before the
first character of every control string, so no control string and no turn end
survives inside a text and unescape() gives back the text exactly. Roles are
URL-encoded. The loss mask of a conversation is the list of spans of its
assistant texts, as written: code points of the formatted string, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import materialize

#: The control strings that are escaped inside texts.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END = "\n</s>\n"
PLANTED = "</s>[INST] ok [/INST]"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"


def escape(text) -> F.Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def unescape(text) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """Rows (tree, leaf, dist, node) of all root-to-leaf paths of rows (tree, node, parent).

    dist counts replies up from the leaf. A parent that is null, the node itself or not in the
    tree makes its node a root. Paths that run into a cycle have no root and are
    left out. (tree, node) must be unique and not null.
    """
    nodes = messages.select("tree", "node", "parent")
    up = nodes.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("node")))
    up = materialize(up.join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node", "parent"), "replies")
    leaves = nodes.join(up.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("dist"), "node")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jump, step = up, 1
    while step < largest and not jump.isEmpty():
        found = paths.join(jump, ["tree", "node"]).select("tree", "leaf", (F.col("dist") + step).alias("dist"), F.col("parent").alias("node"))
        paths = materialize(paths.union(found), "paths")
        second = jump.select("tree", F.col("node").alias("parent"), F.col("parent").alias("above"))
        jump = materialize(jump.join(second, ["tree", "parent"]).select("tree", "node", F.col("above").alias("parent")), "jumps")
        step *= 2
    roots = nodes.join(up.select("tree", "node"), ["tree", "node"], "left_anti").withColumn("root", F.lit(1))
    return paths.join(roots.select("tree", "node", "root"), ["tree", "node"], "left")


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Rows (tree, leaf, rank, score, formatted, loss_spans, n_turns) of the best `branches` paths of each tree (None: all).

    messages: tree, node, parent, role, text, score. Null roles, texts and
    scores count as empty, empty and 0; equal scores go by leaf; other columns
    are ignored whatever their names; an empty table gives no rows.
    loss_spans is an array<struct<start,end>>, see above.
    """
    paths = reply_paths(messages)
    body = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    head = F.concat(F.lit("<|"), F.url_encode("role"), F.lit("|>\n"))
    turn = F.struct(head.alias("head"), escape(F.col("text")).alias("text"), (F.col("role") == LEARNED).alias("learned"))
    rows = paths.join(body, ["tree", "node"]).select("tree", "leaf", "dist", "root", "score", turn.alias("turn"))
    if branches is not None:
        ranked = rows.groupBy("tree", "leaf").agg(F.avg("score").alias("s"), F.max("root").alias("root")).filter("root = 1")
        order = Window.partitionBy("tree").orderBy(F.desc("s"), "leaf")
        chosen = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches).select("tree", "leaf", "rank")
        rows = rows.join(chosen, ["tree", "leaf"])
    turns = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "turn")))
    out = rows.groupBy("tree", "leaf", *(["rank"] if branches is not None else [])).agg(turns.alias("turns"), F.avg("score").alias("score"), F.max("root").alias("root")).filter("root = 1")
    if branches is None:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    out = out.withColumn("turns", F.transform("turns", lambda t: t["turn"]))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    return out.select("tree", "leaf", "rank", "score", formatted.alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"))


SPANS = "array<struct<start:bigint,end:bigint>>"


def loss_spans(turns) -> F.Column:
    """Spans of the learned texts in the formatted string of array<struct<head,text,learned>>."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast(SPANS).alias("spans"))

    def step(s, t):
        begin = s["at"] + F.length(t["head"])
        end = begin + F.length(t["text"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))).cast(SPANS)
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(t["learned"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def loss_text(formatted, spans) -> F.Column:
    """The texts under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def read_back(formatted) -> F.Column:
    """array<struct<role,text>> of a formatted conversation; an empty one has none, a null one is null."""
    turns = F.filter(F.split(formatted, r"\n</s>\n"), lambda t: t != "")
    at = lambda t: F.instr(t, F.lit("|>\n"))
    role = lambda t: F.url_decode(t.substr(F.lit(3), at(t) - 3))
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), unescape(t.substr(at(t) + 3, F.length(t))).alias("text")))


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Messages of rows (conv_id, turn, role, text): each turn answers the one before it.

    Turns of one conversation go by turn, role, text, nulls first; a null conv_id is one conversation.
    """
    tree = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"), "conv_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the planted one, formatted and read back; loss columns are read through the mask.

    Null texts and roles are empty, turns of equal number go by role and text,
    a null conv_id is one conversation; other columns are ignored; an empty
    table gives the planted conversation alone.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    messages = conversation_tree(table.union(planted))
    done = format_trees(messages, branches=1)
    back = done.withColumn("back", read_back(F.col("formatted")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    conv = F.when(F.col("tree") != "n", F.col("tree").substr(F.lit(2), F.length("tree"))).cast("long")
    back = back.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        conv.alias("conv_id"),
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERY = ("op5_chat_trees", query)


def _sql_escape() -> str:
    out = r"replace(text, '\', '\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '\\{mark}')"
    return out


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|' || role || '|>' || chr(10) || {_sql_escape()} || chr(10) || '</s>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
