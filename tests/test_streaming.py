from pyspark.sql import functions as F

from tests.helpers import msg, table
from threadloom.operators import rewrite
from threadloom.operators.tokens import trigger_decisions
from threadloom.plans.engine import Config
from threadloom.streaming.context import running_decisions, summarize_stream


def test_running_totals_agree_with_the_batch(spark, tmp_path):
    rows = table(spark, *[[msg("user", "x" * 40)] * n for n in (1, 3, 6)])
    rows.filter("msg_idx < 2").write.parquet(str(tmp_path / "in"))
    rows.filter("msg_idx >= 2").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_decisions(stream, ("messages", 3)).writeStream.outputMode("update").format("memory").queryName("decided").start()
    query.processAllAvailable()
    query.stop()
    last = spark.table("decided").groupBy("thread_id").agg(F.max("messages").alias("messages"), F.max("tokens").alias("tokens"))
    want = trigger_decisions(rows, ("messages", 3)).select("thread_id", "messages", "tokens")
    assert sorted(last.collect()) == sorted(want.collect())


def test_threads_are_rewritten_as_they_fire(spark, tmp_path):
    rows = table(spark, [m for i in range(3) for m in (msg("user", f"Q{i}", id=f"u{i}"), msg("assistant", f"A{i}", id=f"a{i}"))])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = {}

    def commit(batch, result):
        kept["messages"] = result.messages.collect()
        kept["links"] = result.links.count()

    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = summarize_stream(stream, lambda t: rows.limit(0), commit, rewrite.scripted("Done."), str(tmp_path / "cp"), Config(trigger=("messages", 6), keep=("messages", 2)))
    query.processAllAvailable()
    query.stop()
    assert [m.content for m in sorted(kept["messages"], key=lambda m: m.msg_idx)] == ["Summary of the conversation so far:\n\nDone.", "Q2", "A2"] and kept["links"] == 4
