"""Claims that conflict, the facts a rewritten history must keep, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import text as X
from threadloom.functions.python_udfs import json_claims_udf, sentence_udf

#: Fixed value: keys with more distinct values are measurements, not claims.
MAX_VALUES = 3
#: Joins texts that must not be matched across.
SEPARATOR = "\x00"
CLAIM_KINDS = ("text", "json")


def claims(units: DataFrame) -> DataFrame:
    """Rows (thread_id, msg_idx, unit_pos, nth, key, value, folded_key, folded_value) of claims in prose and JSON objects.

    Summaries repeat claims and make none. Keys that vary by nature are left out.
    """
    said = units.filter(F.col("kind").isin(*CLAIM_KINDS) & (F.col("role") != "summary"))
    prose = said.filter("document is null").withColumn("found", X.assertions(F.col("text")))
    scalars = said.filter("document is not null").withColumn("found", json_claims_udf("document"))
    # a value that is escaped or written differently in the text could not be found again
    scalars = scalars.withColumn("found", F.filter("found", lambda c: X.contains(F.col("text"), c["value"])))
    columns = ["thread_id", "msg_idx", "unit_pos", "found"]
    rows = prose.select(*columns).union(scalars.select(*columns))
    rows = rows.select("thread_id", "msg_idx", "unit_pos", F.posexplode("found").alias("nth", "c"))
    rows = rows.select("thread_id", "msg_idx", "unit_pos", "nth", F.col("c.key").alias("key"), F.col("c.value").alias("value"))
    rows = rows.withColumns({"folded_key": X.casefold(F.col("key")), "folded_value": X.casefold(F.col("value"))})
    return rows.filter(~X.matches("folded_key", P.VOLATILE_KEY))


def contradictions(units: DataFrame) -> DataFrame:
    """Rows (thread_id, key, unit_a, value_a, unit_b, value_b, ord) of different values of a key from different messages.

    A value belongs to the unit that says it first. A key with more than three
    values is dropped before its values are paired, so a key gives three pairs at most.
    """
    place = F.struct("msg_idx", "unit_pos", "nth")
    firsts = claims(units).groupBy("thread_id", "folded_key", "folded_value").agg(F.min(F.struct(place.alias("at"), F.col("value"))).alias("f"))
    of_key = Window.partitionBy("thread_id", "folded_key")
    few = firsts.withColumn("n", F.count("*").over(of_key)).filter(F.col("n").between(2, MAX_VALUES))
    keys = few.groupBy("thread_id", "folded_key").agg(F.array_sort(F.collect_list("f")).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(F.filter("v", lambda b, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = keys.select("thread_id", F.col("folded_key").alias("key"), F.get("v", F.lit(0))["at"].alias("opened"), F.posexplode(pairs).alias("nth", "p"))
    rows = rows.filter(F.col("p.a.at.msg_idx") != F.col("p.b.at.msg_idx"))
    unit = lambda side: F.struct(F.col(f"p.{side}.at.msg_idx").alias("msg_idx"), F.col(f"p.{side}.at.unit_pos").alias("unit_pos"))
    return rows.select("thread_id", "key", unit("a").alias("unit_a"), F.col("p.a.value").alias("value_a"), unit("b").alias("unit_b"), F.col("p.b.value").alias("value_b"), F.struct("opened", "nth").alias("ord"))


def carried_facts(messages: DataFrame) -> DataFrame:
    """Rows (thread_id, msg_idx, nth, statement, required) recorded by summaries, if their statement satisfies them."""
    rows = messages.filter("lineage is not null").select("thread_id", "msg_idx", F.posexplode("lineage.facts").alias("nth", "f"))
    rows = rows.select("thread_id", "msg_idx", "nth", "f.statement", "f.required")
    return rows.filter(X.is_stated(F.col("required"), X.canonical(F.col("statement"))))


def _clause(pattern: str, sentence: Column) -> Column:
    return F.trim(F.regexp_extract(sentence, pattern, 1))


def facts(classified: DataFrame, conflicts: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows (thread_id, ord, statement, required): unique facts, in the order ord.

    Carried facts come first, then those of each must-preserve unit (its
    identifiers, its first correction, its first standing instruction), then
    conflicts. An identifier that a correction replaced is not a fact of its own.
    """
    order = "struct<part:int,a:int,b:int,c:int,d:int>"
    place = lambda *parts: F.struct(*[(F.lit(p) if isinstance(p, int) else F.col(p)).cast("int") for p in parts]).cast(order)
    text = X.normalize_apostrophes(F.col("text"))
    must = classified.filter("level = 'must_preserve'").withColumn("plain", text)
    carried = carried_facts(messages).select("thread_id", place(0, "msg_idx", "nth", 0, 0).alias("ord"), "statement", "required")
    named = must.select("thread_id", "msg_idx", "unit_pos", F.posexplode("identifiers").alias("nth", "statement"))
    named = named.select("thread_id", place(1, "msg_idx", "unit_pos", 0, "nth").alias("ord"), "statement", F.array("statement").alias("required"))
    fixes = must.filter("user_correction").withColumn("sentence", sentence_udf(P.CORRECTION)("plain")).filter("sentence is not null")
    value = _clause(P.CORRECTED_VALUE, F.col("sentence"))
    fixes = fixes.select("thread_id", place(1, "msg_idx", "unit_pos", 1, 0).alias("ord"), F.concat(F.lit('User correction: "'), "sentence", F.lit('"')).alias("statement"), F.array(F.when(value == "", F.col("sentence")).otherwise(value)).alias("required"))
    rules = must.filter("active_constraint").withColumn("sentence", sentence_udf(P.CONSTRAINT)("plain")).filter("sentence is not null")
    rules = rules.select("thread_id", place(1, "msg_idx", "unit_pos", 2, 0).alias("ord"), F.concat(F.lit('User instruction: "'), "sentence", F.lit('"')).alias("statement"), F.array("sentence").alias("required"))
    both = F.concat(F.lit("Conflicting values reported for "), "key", F.lit(": "), "value_a", F.lit(" (earlier) vs "), "value_b", F.lit(" (later)"))
    disputes = conflicts.withColumns({"m": F.col("ord.opened.msg_idx"), "u": F.col("ord.opened.unit_pos"), "k": F.col("ord.opened.nth"), "p": F.col("ord.nth")})
    disputes = disputes.select("thread_id", place(2, "m", "u", "k", "p").alias("ord"), both.alias("statement"), F.array("value_a", "value_b").alias("required"))
    rows = carried.union(named).union(fixes).union(rules).union(disputes)
    replaced = classified.filter("user_correction").select("thread_id", F.explode(X.all_matches(text, P.REPLACED_VALUE, 1)).alias("old"))
    replaced = replaced.select("thread_id", X.casefold(X.strip(F.col("old"))).alias("old")).distinct()
    rows = rows.withColumn("old", X.casefold(F.col("statement"))).join(replaced, ["thread_id", "old"], "left_anti").drop("old")
    once = rows.groupBy("thread_id", "statement").agg(F.min(F.struct("ord", "required")).alias("f"))
    return once.select("thread_id", F.col("f.ord").alias("ord"), "statement", F.col("f.required").alias("required"))


def gather_facts(fact_rows: DataFrame) -> DataFrame:
    """Rows (thread_id, facts): array<struct<statement,required>> in order."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "statement", "required")))
    return fact_rows.groupBy("thread_id").agg(F.transform(listed, lambda f: F.struct(f["statement"].alias("statement"), f["required"].alias("required"))).alias("facts"))


def history_text(msgs: Column) -> Column:
    """Canonical contents of a thread, so joined that no match spans two messages."""
    return F.array_join(F.transform(msgs, lambda m: X.canonical(m["content"])), SEPARATOR)


def missing_facts(fact_list: Column, text: Column) -> Column:
    """Facts that a history_text() does not state."""
    return F.filter(fact_list, lambda f: ~X.is_stated(f["required"], text))
