"""Literal threads for tests."""

from threadloom.sources.messages import MESSAGE, as_messages


def msg(role, content, id=None, calls=(), answers=None, name=None, rewritable=True, lineage=None):
    return {"role": role, "content": content, "id": id, "name": name, "tool_calls": [{"id": c, "name": n, "arguments": a} for c, n, a in calls], "tool_call_id": answers, "rewritable": rewritable, "lineage": lineage}


def table(spark, *threads):
    """Messages of threads 0, 1, ..."""
    rows = [(t, {"msg_idx": i, **m}) for t, thread in enumerate(threads) for i, m in enumerate(thread)]
    return as_messages(spark.createDataFrame(rows, f"thread_id long, m {MESSAGE}").select("thread_id", "m.*"))


def contents(rows):
    return [(r.role, r.content) for r in sorted(rows, key=lambda r: r.msg_idx)]


def heartbeats(n, minute=0):
    return "".join(f"2024-08-01T03:{(minute + i // 60) % 60:02d}:{i % 60:02d} INFO worker-{i % 3} processing queue\n" for i in range(n))
