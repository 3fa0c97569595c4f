import pytest
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError
from threadloom.operators import tokens as T
from threadloom.plans.engine import Config
from threadloom.sources import sinks
from threadloom.sources.messages import as_messages


def test_python_counter_counts_rows(spark):
    rows = [(1, 0, "user", "one two three"), (1, 1, "assistant", ""), (2, 0, "user", "x " * 9000), (2, 1, "user", None)]
    messages = as_messages(spark.createDataFrame(rows, "thread_id long, msg_idx int, role string, content string"))
    words = T.python_counter(lambda text: len(text.split()))
    found = {r.thread_id: (r.messages, r.tokens) for r in T.thread_tokens(messages, counter=words, overhead=1).collect()}
    assert found == {1: (2, 5), 2: (2, 9002)}
    fired = T.trigger_decisions(messages, ("tokens", 100), counter=words).collect()
    assert [r.thread_id for r in fired] == [2]
    with pytest.raises(ConfigurationError):
        Config(counter=words)


def test_observed_totals_come_with_the_write(spark, tmp_path):
    rows = [("passed", "none_needed", 2, 100, 40), ("failed_recovered", "restated_facts", 0, 50, 30), ("skipped", "trimmed_fallback", 1, 10, 10)]
    events = spark.createDataFrame(rows, "validation_status string, recovery_status string, compacted_units long, input_tokens long, output_tokens long")
    passing, seen = sinks.observed(events)
    sinks.json_sink(str(tmp_path / "events"))(passing)
    assert seen.get == {"summarizations": 3, "compacted_units": 3, "input_tokens": 160, "output_tokens": 80, "restated": 1, "fallbacks": 1, "unrecovered": 0}
    assert spark.read.json(str(tmp_path / "events")).count() == 3
    passing, seen = sinks.observed(events.filter(F.lit(False)), "none")
    sinks.table_sink(str(tmp_path / "none"))(passing)
    assert seen.get["summarizations"] == 0
