"""Record store, lineage bounds, scratch tables, roles, models in Python, adapters."""

import json
import logging
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import msg, table
from threadloom.errors import ConfigurationError
from threadloom.operators import lineage, rewrite
from threadloom.plans.engine import Config, summarize
from threadloom.sources import sinks, storage, store
from threadloom.sources.messages import as_messages, from_chat_json

SCHEMA = "application_id string, tenant_id string, run_id string, record_type string, record_id string, timestamp long, payload string"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


ROWS = [
    ("app", "t1", "r1", "Event", "a", 3, '{"id": "a", "sequence": 2}'),
    ("app", "t1", "r1", "Event", "b", 3, '{"id": "b", "sequence": 1}'),
    ("app", "t1", "r1", "Link", "c", 3, '{"id": "c"}'),
    ("app", "t1", "r2", "Event", "a", 1, '{"id": "a"}'),
    ("app", "t2", "r1", "Event", "a", 0, '{"id": "a"}'),
]


def test_scans_are_scoped_filtered_and_ordered(spark):
    table = records(spark, *ROWS)
    ids = lambda **k: [(r.run_id, r.record_id) for r in store.scan(table, store.Filter("app", "t1", **k)).collect()]
    assert ids() == [("r2", "a"), ("r1", "c"), ("r1", "b"), ("r1", "a")]
    assert ids(run_id="r1", record_types=["Event"]) == [("r1", "b"), ("r1", "a")]
    assert ids(limit=2, offset=1) == [("r1", "c"), ("r1", "b")] and ids(limit=0) == []
    with pytest.raises(ConfigurationError):
        store.Filter("app", "t1", offset=-1)


def test_lookup_upsert_and_deletion(spark):
    table = records(spark, *ROWS)
    wanted = table.select(*store.SCOPE, "record_id").filter("tenant_id = 't1'")
    assert store.get(table, wanted).count() == 4
    both = store.put(table, records(spark, ("app", "t1", "r1", "Link", "a", 9, "{}"), ("app", "t1", "r2", "Event", "a", 9, "{}")))
    assert both.count() == 6 and both.filter("run_id = 'r2'").first().timestamp == 9
    with pytest.raises(Exception, match="ambiguous"):
        store.get(both, wanted).collect()
    left, gone = store.delete_run(both, wanted.filter("run_id = 'r1'"))
    assert left.count() == 2 and [tuple(r) for r in gone.collect()] == [("app", "t1", "r1", 4)]


def test_walks_need_a_positive_depth(spark):
    edges = spark.createDataFrame([(1, "a", "b", "r"), (1, "b", "c", "r"), (1, "c", "a", "r")], "thread_id long, source_id string, target_id string, relation string")
    wanted = spark.createDataFrame([(1, "c"), (1, "zz")], "thread_id long, entity_id string")
    for depth in (0, -1, True, 1.5):
        with pytest.raises(ValueError, match="max_depth"):
            lineage.walk(edges, wanted, depth)
    assert {(r.depth, r.source_id) for r in lineage.walk(edges, wanted).collect()} == {(1, "b"), (2, "a"), (3, "c")}
    assert lineage.walk(edges, wanted, 1).count() == 1 and lineage.walk(edges, wanted.limit(0)).count() == 0


def test_scratch_tables_go(spark):
    folder = storage.shared_dir(spark).removeprefix("file://") + "/threadloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with storage.scratch(spark):
        result = summarize(table(spark, [msg("user", f"Q{i}", id=str(i)) for i in range(4)]), rewrite.scripted("Done."), Config(trigger=("messages", 3), keep=("messages", 1)))
        assert result.events.count() == 1
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    sc = spark.sparkContext
    monkeypatch.delattr(sc, "_threadloom_dir", raising=False)
    monkeypatch.setattr(sc, "getConf", dict)
    monkeypatch.setattr(sc, "master", "spark://host:7077")
    with pytest.raises(ConfigurationError):
        storage.shared_dir(spark)


def test_unknown_roles_raise(spark):
    for role in ("robot", None):
        df = spark.createDataFrame([(1, 0, role, "x")], "thread_id long, msg_idx int, role string, content string")
        with pytest.raises(Exception, match="unknown role"):
            as_messages(df).collect()


class Interrupt(Exception):
    pass


def test_a_model_that_raises_fails_its_thread_only(spark):
    def reply(text):
        if "bad" in text:
            raise ValueError(text)
        if "stop" in text:
            raise Interrupt
        return "Done."

    threads = [[msg("user", f"{word} {i}", id=str(i)) for i in range(4)] for word in ("good", "bad", "stop")]
    config = Config(trigger=("messages", 3), keep=("messages", 1))
    events = summarize(table(spark, *threads[:2]), rewrite.python_model(reply, (Interrupt,)), config).events.collect()
    assert {e.thread_id: e.recovery_status for e in events} == {0: "none_needed", 1: "trimmed_fallback"}
    with pytest.raises(Exception, match="Interrupt"):
        summarize(table(spark, threads[2]), rewrite.python_model(reply, (Interrupt,)), config).events.collect()


def test_lineage_under_extra_arguments(spark):
    native = json.dumps({"type": "human", "content": "s", "id": "x", "additional_kwargs": {"lineage": {"summary_id": "s1", "generation": 2, "source_summary_ids": ["s0"], "facts": []}}})
    row = from_chat_json(spark.createDataFrame([(1, 0, native)], "thread_id long, msg_idx int, native string")).first()
    assert (row.role, row.lineage.summary_id, row.lineage.generation, row.lineage.source_summary_ids) == ("user", "s1", 2, ["s0"])


def test_events_are_logged_one_by_one(spark, caplog):
    rows = spark.range(3).select(F.col("id").alias("thread_id"), F.lit("x").alias("policy"))
    sinks.log_sink(rows)  # executors log; here only that every row is written without failing
    sinks.composite(sinks.log_sink, sinks.safely(lambda _: 1 / 0))(rows)
    assert any("could not be delivered" in r.message for r in caplog.records if r.levelno == logging.WARNING)
