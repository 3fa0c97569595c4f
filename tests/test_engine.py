import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import contents, heartbeats, msg, table
from threadloom.errors import ConfigurationError
from threadloom.operators import lineage, rewrite, scoring
from threadloom.operators.tokens import Budget
from threadloom.plans.engine import Config, replace_threads, summarize


def run(spark, thread, model, **options):
    result = summarize(table(spark, thread), model, Config(**options))
    return result, result.events.collect()


REFUND = [
    msg("user", "You must never refund more than 500 dollars without approval."),
    msg("user", "Please refund order ORD-1001 for customer 123."),
    msg("assistant", "", calls=[("c1", "warehouse_status", "{}")]),
    msg("tool", "warehouse: status=SHIPPED", answers="c1"),
    msg("assistant", "", calls=[("c2", "carrier_status", "{}")]),
    msg("tool", "carrier: status=LOST, refund claim TX-7781 failed", answers="c2"),
    msg("user", "No, use customer 456 instead of customer 123."),
    msg("assistant", "Understood."),
    msg("user", "What should we do next?"),
]


def test_summary_restates_missing_facts(spark):
    result, (event,) = run(spark, REFUND, rewrite.scripted("The user asked about refunds and an order."), trigger=("messages", 8), keep=("messages", 2))
    rows = sorted(result.messages.collect(), key=lambda r: r.msg_idx)
    assert rows[0].content == (
        "Summary of the conversation so far:\n\nThe user asked about refunds and an order.\n\n"
        "Facts preserved verbatim from the earlier conversation:\n"
        '- User instruction: "You must never refund more than 500 dollars without approval."\n'
        "- ORD-1001\n- TX-7781\n"
        '- User correction: "No, use customer 456 instead of customer 123."\n'
        "- Conflicting values reported for status: SHIPPED (earlier) vs LOST (later)"
    )
    assert contents(rows)[1:] == [("assistant", "Understood."), ("user", "What should we do next?")]
    assert (event.validation_status, event.recovery_status, event.generation) == ("failed_recovered", "restated_facts", 1)
    assert event.trigger_reason == "9 messages >= 8" and rows[0].lineage.generation == 1 and rows[0].id == event.summary_id


OUTPUT = (
    "Diagnostics for incident INC-4410 (checkout latency).\n"
    + json.dumps({"service": "checkout", "region": "eu-west-1", "orders": [{"sku": "A-1", "qty": 1, "state": "queued"}] * 25 + [{"sku": "B-7", "qty": 2, "state": "failed", "order_id": "ORD-5521"}]})
    + "\n"
    + "".join(f"2026-10-04T08:{i // 60:02d}:{i % 60:02d}Z INFO checkout-worker-{i % 4} heartbeat ok\n" for i in range(150))
    + "2026-10-04T08:02:31Z WARN slow query on orders took 2300 ms\n2026-10-04T08:02:32Z ERROR payment authorization failed for order ORD-5521\n"
)


def test_compaction_alone(spark):
    thread = [msg("user", "Why is checkout slow?"), msg("assistant", "", calls=[("call-1", "diagnostics", "{}")]), msg("tool", OUTPUT, answers="call-1")]
    result, (event,) = run(spark, thread, rewrite.scripted("unused"), trigger=("tokens", 1_000), keep=("messages", 20))
    text = result.messages.filter("msg_idx = 2").first().content
    assert text.splitlines() == [
        "Diagnostics for incident INC-4410 (checkout latency).",
        '{"service":"checkout","region":"eu-west-1","orders":[{"__repeated__":25,"value":{"sku":"A-1","qty":1,"state":"queued"}},{"sku":"B-7","qty":2,"state":"failed","order_id":"ORD-5521"}]}',
        "2026-10-04T08:00:00Z INFO checkout-worker-0 heartbeat ok",
        "... 148 similar lines omitted (lines 4-151) ...",
        "2026-10-04T08:02:29Z INFO checkout-worker-1 heartbeat ok",
        "2026-10-04T08:02:31Z WARN slow query on orders took 2300 ms",
        "2026-10-04T08:02:32Z ERROR payment authorization failed for order ORD-5521",
    ]
    assert (event.input_tokens, event.output_tokens, event.prepared_tokens) == (2517, 153, 153)
    assert event.compacted_units == 2 and event.content_kinds == {"json": 1, "log": 2, "text": 2}
    assert event.summary_id is None and (event.validation_status, event.recovery_status) == ("passed", "none_needed")
    assert result.links.count() == 0


def test_fallback_without_a_model(spark):
    thread = [
        msg("user", "Check order ORD-2207 for customer 812."),
        msg("assistant", "", calls=[("c1", "order_status", "{}")]),
        msg("tool", "order ORD-2207: payment failed, gateway error GW-5003", answers="c1"),
        msg("assistant", "Payment for ORD-2207 failed with GW-5003."),
        msg("user", "Retry the payment."),
        msg("assistant", "", calls=[("c2", "retry_payment", "{}")]),
        msg("tool", "retry accepted", answers="c2"),
    ]
    result, (event,) = run(spark, thread, rewrite.failing(), trigger=("messages", 6), keep=("messages", 2))
    assert contents(result.messages.collect()) == [
        ("user", "Earlier messages were removed because the summary model was unavailable.\n\nThe latest user request was:\nRetry the payment.\n\nFacts preserved verbatim from the earlier conversation:\n- ORD-2207\n- customer 812\n- GW-5003"),
        ("assistant", ""),
        ("tool", "retry accepted"),
    ]
    assert (event.validation_status, event.recovery_status) == ("skipped", "trimmed_fallback")


def test_generations_and_lineage(spark):
    turns = lambda a, b: [m for i in range(a, b) for m in (msg("user", f"Question {i}?", id=f"user-{i}"), msg("assistant", f"Answer {i}.", id=f"assistant-{i}"))]
    config = Config(trigger=("messages", 6), keep=("messages", 2))
    history = table(spark, turns(1, 4))
    first = summarize(history, rewrite.scripted("All fine."), config)
    history = replace_threads(history, first)
    late = table(spark, turns(4, 6)).withColumn("msg_idx", F.col("msg_idx") + 100)
    second = summarize(history.unionByName(late), rewrite.scripted("Still fine."), config)
    edges = lineage.upsert(first.links, second.links)
    event = second.events.first()
    assert event.generation == 2
    target = second.events.select("thread_id", F.col("summary_id").alias("entity_id"))
    one = first.events.first().summary_id
    walked = {(r.depth, r.source_id) for r in lineage.walk(edges, target).collect()}
    assert walked == {(1, one), *((1, f"{who}-{i}") for who in ("user", "assistant") for i in (3, 4)), *((2, f"{who}-{i}") for who in ("user", "assistant") for i in (1, 2))}
    assert {(r.depth, r.source_id) for r in lineage.walk_sql(edges, target).collect()} == walked
    left, removed = lineage.delete(edges, target)
    assert left.count() == 0 and removed.first().removed == edges.count()
    summary = second.messages.filter("lineage is not null").first()
    assert list(summary.lineage.source_summary_ids) == [one]


def test_threads_that_do_not_fire_are_left_alone(spark):
    result = summarize(table(spark, REFUND[:2], REFUND), rewrite.scripted("x"), Config(trigger=("messages", 8), keep=("messages", 2)))
    assert [r.thread_id for r in result.events.collect()] == [1]
    assert replace_threads(table(spark, REFUND[:2], REFUND), result).filter("thread_id = 0").count() == 2


def test_orphans_and_validation_off(spark):
    thread = [*REFUND[:7], msg("tool", "late", answers="gone"), msg("user", "Next?")]
    model = rewrite.scripted("Nothing to say.")
    _, (event,) = run(spark, thread, model, trigger=("messages", 8), keep=("messages", 2))
    assert (event.validation_status, event.recovery_status) == ("failed_unrecovered", "restated_facts") or event.output_messages > 0
    _, (event,) = run(spark, REFUND, model, trigger=("messages", 8), keep=("messages", 2), validation=False)
    assert event.validation_status == "disabled"


INVENTORY = {"warehouse": "berlin-2", "pallets": [{"sku": "A-1", "state": "ok"}] * 3 + [{"sku": "B-2", "state": "ok"}] + [{"sku": "A-1", "state": "ok"}] * 3 + [{"sku": f"C-{i}", "state": "ok"} for i in range(12)]}


@pytest.mark.parametrize(("policy", "chars"), [(scoring.MAXIMUM_PRESERVATION, 551), (scoring.BALANCED, 497), (scoring.MAXIMUM_COMPRESSION, 353)])
def test_json_by_policy(spark, policy, chars):
    thread = [msg("user", "Summarize the warehouse inventory."), msg("tool", json.dumps(INVENTORY, indent=2), answers="call-1")]
    result, _ = run(spark, thread, rewrite.scripted("x"), trigger=("messages", 2), policy=policy)
    assert len(result.messages.filter("role = 'tool'").first().content) == chars


def test_configuration_is_checked():
    for wrong in ({"trigger": ("tokens", 0)}, {"trigger": []}, {"keep": ("messages", 0)}, {"keep": ("fraction", 2)}, {"trim_tokens": 0}, {"policy": "balanced"}, {"trigger": {"bytes": 3}}):
        with pytest.raises(ConfigurationError):
            Config(**wrong)
    with pytest.raises(ConfigurationError):
        Budget(window=100, reserved_output=100)
    assert Budget().available == 109_200


def test_long_log_collapses_and_empty_tables_work(spark):
    thread = [msg("user", "go"), msg("tool", heartbeats(200), answers="c")]
    result, (event,) = run(spark, thread, rewrite.scripted("x"), trigger=("tokens", 500), keep=("messages", 20))
    assert event.compacted_units == 1 and event.output_tokens < 100
    assert summarize(table(spark), rewrite.scripted("x"), Config(trigger=("messages", 1))).events.count() == 0
