import random

from pyspark.sql import functions as F

from tests.helpers import msg, table
from threadloom.operators import lineage
from threadloom.operators import windows as W
from threadloom.operators.tokens import Budget, bytes_quarter, message_tokens, parse_keep, suffix_starts, thread_tokens, positions, trigger_columns
from threadloom.sources import sinks
from threadloom.sources.messages import from_chat_json, read_lineage, to_chat_json


def thread(rng):
    out = [msg("system", "rules")] if rng.random() < 0.5 else []
    for i in range(rng.randrange(1, 6)):
        out.append(msg("user", "q" * rng.randrange(60)))
        for j in range(rng.randrange(3)):
            out += [msg("assistant", "", calls=[(f"c{i}{j}", "f", "{}")]), msg("tool", "r" * rng.randrange(60), answers=f"c{i}{j}")]
        if rng.random() < 0.8:
            out.append(msg("assistant", "a" * rng.randrange(60)))
        if rng.random() < 0.2:
            out.append(msg("tool", "stray", answers="gone"))
    return out


def cost(m):
    return -(-len("\n".join([m["content"], *[f"{c['name']} {c['arguments']}" for c in m["tool_calls"]]]).encode()) // 4) + 3


def expected_cut(ms, keep):
    kind, n = keep
    if kind == "messages":
        if len(ms) <= n:
            return 0
        at = len(ms) - n
    else:
        if sum(map(cost, ms)) <= n:
            return 0
        at = next((i for i in range(len(ms) + 1) if sum(map(cost, ms[i:])) <= n), len(ms))
        at = min(at, len(ms) - 1)
    if ms[at]["role"] != "tool":
        return at
    end = at
    while end < len(ms) and ms[end]["role"] == "tool":
        end += 1
    ids = {m["tool_call_id"] for m in ms[at:end]}
    back = [i for i in range(at) if ms[i]["role"] == "assistant" and ids & {c["id"] for c in ms[i]["tool_calls"]}]
    return back[-1] if back else end


def test_cutoffs_and_windows(spark):
    rng = random.Random(2)
    threads = [thread(rng) for _ in range(60)]
    rows = W.gather(message_tokens(table(spark, *threads))).cache()
    for keep in (("messages", 2), ("messages", 5), ("tokens", 30), ("tokens", 90)):
        got = {r.thread_id: r.cut for r in W.with_cutoff(rows, keep).select("thread_id", "cut").collect()}
        assert got == {i: expected_cut(t, keep) for i, t in enumerate(threads)}
        for r in W.with_trailing_window(rows, keep).select("thread_id", "kept").collect():
            talk = [m for m in r.kept if m.role != "system"]
            assert not talk or talk[0].role in ("user", "assistant")
            assert [m.msg_idx for m in talk] == list(range(len(threads[r.thread_id]) - len(talk), len(threads[r.thread_id])))
    lost = {i: [m["tool_call_id"] for m in t if m["tool_call_id"] == "gone"] for i, t in enumerate(threads)}
    assert {r.thread_id: r.o for r in rows.select("thread_id", W.orphaned_tool_results(F.col("msgs")).alias("o")).collect()} == lost
    joined = W.orphans_by_join(table(spark, *threads)).groupBy("thread_id").count().collect()
    assert {r.thread_id: r["count"] for r in joined} == {i: len(o) for i, o in lost.items() if o}


def test_running_sum_agrees_with_arrays(spark):
    rng = random.Random(3)
    messages = message_tokens(table(spark, *[thread(rng) for _ in range(20)]))
    arrays = W.gather(messages).select("thread_id", W.fitting_suffix(F.col("msgs"), F.lit(50)).alias("start"))
    assert sorted(suffix_starts(positions(messages), F.lit(50)).collect()) == sorted(arrays.collect())


def test_tokens(spark):
    rows = table(spark, [msg("user", "abcd"), msg("user", "é" * 4, name="bo"), msg("assistant", "", calls=[("c", "f", '{"x": 1}')])])
    assert thread_tokens(rows).first().tokens == (1 + 3) + (3 + 3) + (-(-len('\nf {"x": 1}') // 4) + 3)
    double = lambda t: bytes_quarter(t) * 2
    assert thread_tokens(rows, counter=double, overhead=0).first().tokens == 2 * (1 + 3 + 3)


def test_triggers(spark):
    budget = Budget(window=1000, reserved_output=100, safety_margin=0.1, overhead=0)
    df = spark.createDataFrame([(500, 3), (800, 10), (801, 1), (900, 10)], "t long, m long")

    def fired(spec):
        reason, over = trigger_columns(spec, budget, F.col("t"), F.col("m"))
        return [tuple(r) for r in df.select(reason, over).collect()]

    assert fired(None) == [(None, None), (None, None), ("801 tokens exceed the 800-token input budget", 1), ("900 tokens exceed the 800-token input budget", 100)]
    assert fired(("fraction", 0.8))[1] == ("800 tokens >= 800", 0)
    assert fired([("messages", 10), ("tokens", 801)])[2:] == [("801 tokens >= 801", 1), ("900 tokens >= 801", 99)] or fired([("messages", 10), ("tokens", 801)])[3] == ("10 messages >= 10", 100)
    assert fired({"messages": 10, "tokens": 800})[3] == ("900 tokens >= 800 and 10 messages >= 10", 100)
    assert parse_keep(("fraction", 0.333), 100) == ("tokens", 33)


def test_chat_objects_round_trip(spark):
    lineage_ = {"summary_id": "s", "generation": 2, "source_summary_ids": ["r"], "facts": [{"statement": "x", "required": ["x"]}]}
    rows = table(spark, [msg("user", 'say "hi"\n', id="u"), msg("assistant", "", calls=[("c", "f", '{"a":1}')]), msg("tool", "ok", answers="c"), msg("user", "sum", id="s", lineage=lineage_)])
    again = from_chat_json(to_chat_json(rows))
    assert sorted(again.collect(), key=lambda r: r.msg_idx) == sorted(rows.collect(), key=lambda r: r.msg_idx)
    raw = spark.createDataFrame([(0, 0, '{"type": "human", "content": [{"type": "text", "text": "a"}, {"type": "image"}]}'), (0, 1, '{"role": "weird"}')], "thread_id long, msg_idx int, native string")
    got = sorted(from_chat_json(raw).collect(), key=lambda r: r.msg_idx)
    assert [(r.role, r.content, r.rewritable) for r in got] == [("user", "a", False), ("user", "", True)]


def test_damaged_lineage(spark):
    records = ['{"summary_id": "a", "generation": 3}', '{"generation": true}', '{"generation": "2", "source_summary_ids": "x"}', "broken", '{"facts": [{"statement": "s", "required": []}, {"statement": "t", "required": ["t"]}, 5]}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, r string")
    got = [r.l for r in df.orderBy("i").select(read_lineage(F.col("r"), F.lit("m")).alias("l")).collect()]
    assert [(g.summary_id, g.generation) if g else None for g in got] == [("a", 3), ("m", 1), ("m", 1), ("m", 1), ("m", 1), None]
    assert all(list(g.source_summary_ids) == [] for g in got[:5])


def test_lineage_with_cycles_and_scopes(spark):
    edges = spark.createDataFrame([("t", "a", "b", "derived_from"), ("t", "b", "a", "derived_from"), ("u", "x", "b", "derived_from"), (None, "n", "b", "derived_from"), ("", "m", "b", "derived_from")], "thread_id string, source_id string, target_id string, relation string")
    wanted = spark.createDataFrame([("t", "b"), (None, "b")], "thread_id string, entity_id string")
    got = {(r.root_id, r.depth, r.source_id) for r in lineage.walk(edges, wanted).collect()}
    assert got == {("b", 1, "a"), ("b", 2, "b"), ("b", 1, "n"), ("b", 1, "m")}
    assert lineage.walk(edges.limit(0), wanted).count() == 0
    again = lineage.upsert(edges, edges.filter("thread_id = 't'"))
    assert again.count() == edges.count()
    assert lineage.parents(edges, wanted).count() == 3
    left, removed = lineage.delete(edges, spark.createDataFrame([("",)], "thread_id string"))
    assert left.count() == 3 and removed.first().removed == 2


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("passed", "none_needed", "balanced", 100, 10, 0.1, 1), ("passed", "none_needed", "balanced", 300, 30, 0.3, 2)], "validation_status string, recovery_status string, policy string, input_tokens long, output_tokens long, compression_ratio double, compacted_units long")
    row = sinks.metrics(events).first()
    assert (row.summarizations, row.input_tokens_median, row.compacted_units) == (2, 200.0, 3)
    assert {(r.bucket, r.n) for r in sinks.histogram(events, "input_tokens", [100, 200]).collect()} == {(0, 1), (2, 1)}
    seen = []

    def broken(_):
        raise RuntimeError("no")

    try:
        sinks.composite(broken, lambda e: seen.append(e.count()), sinks.json_sink(str(tmp_path / "e")))(events)
    except ExceptionGroup as group:
        assert len(group.exceptions) == 1
    assert seen == [2] and spark.read.json(str(tmp_path / "e")).count() == 2
    sinks.safely(broken)(events)
    sinks.log_sink(events)
