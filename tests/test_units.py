import json
import random
import time

from pyspark.sql import functions as F

from tests.helpers import heartbeats, msg, table
from threadloom.operators import compaction, facts, scoring
from threadloom.operators import units as U


def found(spark, *texts, role="tool", **options):
    """Units of one thread for each text, in order."""
    rows = U.units(table(spark, *[[msg(role, t)] for t in texts]), U.ParsingOptions(**options)).collect()
    return [sorted((r for r in rows if r.thread_id == i), key=lambda r: r.unit_pos) for i in range(len(texts))]


MIXED = (
    "\nIntro line.\n"
    + json.dumps({"status": "failed", "transaction_id": "TX-991"})
    + '\n\n{\n  "pretty": true\n}\n'
    + heartbeats(3)
    + "2024-01-01 10:00:00,123 - app - ERROR - boom\nTraceback (most recent call last):\n"
    + '  File "app.py", line 3, in main\n'
    + "    raise ValueError('bad')\nValueError: bad\n| a | b |\n|---|---|\nClosing prose for customer 456."
)


def test_kinds(spark):
    cases = {
        MIXED: ["text", "json", "json", "log", "log", "error", "table", "text"],
        '{"unterminated": [1, 2\nnot json at all': ["text"],
        heartbeats(5) + "2024-08-01T04:00:00 WARN slow\n" + heartbeats(2): ["log", "log", "log"],
        "\n\nfirst\n\n\nINFO log line\n\n": ["text", "log"],
        "ValueError: first\nplain prose between\nKeyError: second\n": ["error", "text", "error"],
        "Fix:\n```python\nx = 1\n\nprint(x)\n```\nDone.": ["text", "code", "text"],
        "Start\n```\ncode line\nmore": ["text", "code"],
        'Traceback (most recent call last):\n  File "app.py", line 3, in main\n    total = compute(order)\nValueError: bad value\n': ["error"],
        "   \n  ": [],
        '{"level": "error", "msg": "boom"}': ["json"],
    }
    got = found(spark, *cases)
    assert [[u.kind for u in units] for units in got] == list(cases.values())
    for text, units in zip(cases, got, strict=True):
        if units:
            assert "".join(u.text for u in units) == text
    assert [u.severity for u in got[2]] == ["INFO", "WARNING", "INFO"] and got[2][1].first_line == 6
    assert [u.text for u in got[3]] == ["\n\nfirst\n\n\n", "INFO log line\n\n"]
    assert list(got[7][0].line_severities) == ["ERROR"] * 4
    assert got[9][0].severity == "ERROR" and got[9][0].has_error


def test_routes_and_fences(spark):
    text = "Query:\nSELECT id FROM orders\nTICKET-1 opened\n```sql\nSELECT 1\n```\n"
    (units,) = found(spark, text, routes=((r"^SELECT\b", "sql"), (r"^TICKET-\d+", "ticket")), fence_kinds={"sql": "sql"})
    assert [u.kind for u in units] == ["text", "sql", "ticket", "sql"]


def test_the_highest_severity_of_all_matches_counts(spark):
    patterns = (U.LinePattern(r"^one|^two", "log", 5, severity="INFO"), U.LinePattern(r"^two", "error", 1, severity="ERROR"), U.LinePattern(r"^(?<level>WARN|FATAL)", "log", 3, level_group=1))
    (units,) = found(spark, "one\ntwo\n", patterns=patterns)
    assert [(u.kind, list(u.line_severities)) for u in units] == [("log", ["INFO"]), ("log", ["ERROR"])]
    (units,) = found(spark, "WARN x\nFATAL y\n", patterns=patterns)
    assert [list(u.line_severities) for u in units] == [["WARNING", "CRITICAL"]]


def test_fenced_logs_are_logs(spark):
    text = "See:\n```\nINFO a\nERROR b\n```\n```python\nx = 1\n```\n"
    (units,) = found(spark, text)
    assert [u.kind for u in units] == ["text", "log", "code"]
    assert list(units[1].line_severities) == [None, "INFO", "ERROR", None] and units[1].has_error


def test_a_detector_finds_code_and_may_fail(spark):
    def detect(text):
        if "boom" in text:
            raise RuntimeError(text)
        return "python" if "def " in text else None

    got = found(spark, "def f():\n    return 1\n", "plain words", "boom def ", detector=detect)
    assert [[u.kind for u in units] for units in got] == [["code"], ["text"], ["text"]]


def test_long_documents_take_linear_room(spark):
    start = time.time()
    text = json.dumps([{"key": i, "value": "x" * 20} for i in range(20_000)], indent=1)
    (units,) = found(spark, "Result:\n" + text + "\nDone.")
    assert [u.kind for u in units] == ["text", "json", "text"] and units[1].document == text
    assert time.time() - start < 60


def test_units_tile_random_messages(spark):
    rng = random.Random(11)
    parts = ["prose", "2024-01-01T00:00:00 INFO x", "ERROR boom", '{"a": [1, 2]}', "```", "| a |", "", "  indented", "ValueError: x", "[", '{"a":', "}", "\t"]
    texts = ["".join(rng.choice(parts) + rng.choice(["\n", "\r\n", "\r", " ", "\x0b"]) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    for text, units in zip(texts, found(spark, *texts), strict=True):
        assert "".join(u.text for u in units) == (text if text.strip() else "")
        assert all(len(u.line_severities) == len(u.text.splitlines()) for u in units)


def test_labels_and_roles(spark):
    lineage = {"summary_id": "s", "generation": 1, "source_summary_ids": [], "facts": []}
    rows = U.units(table(spark, [msg("user", " "), msg("user", "hi", id="h2"), msg("user", "Never!", lineage=lineage)])).collect()
    assert {(r.unit_id, r.role) for r in rows} == {("h2:0", "user"), ("message-2:0", "summary")}


def scores(spark, *threads):
    rows = scoring.importance(U.units(table(spark, *threads))).collect()
    return {(r.thread_id, r.msg_idx, r.unit_pos): r for r in rows}


def test_importance(spark):
    thread = [msg("user", "You must never refund."), *[msg("tool", f"poll {i} ok") for i in range(5)], msg("tool", "ORD-1001 failed"), msg("user", "No, use ORD-2002 instead of ORD-1001.")]
    got = scores(spark, thread)
    assert got[0, 0, 0].score == 0.75 and got[0, 0, 0].reasons == ["active_constraint"]
    assert [got[0, i, 0].repetitive_low_value for i in range(1, 6)] == [False, True, True, True, False]
    assert got[0, 3, 0].score == max(0.05, 3 / 7 * 0.25 * 0.2)
    assert set(got[0, 6, 0].reasons) == {"recent", "contains_identifier", "identifier_in_failure_context"}
    assert got[0, 7, 0].score == 1.0 and {"user_correction", "user_identifier", "recent"} <= set(got[0, 7, 0].reasons)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_policies_are_ordered(spark):
    thread = [msg("user", "We decided it."), msg("tool", "ERROR x\n"), msg("tool", "INFO x\n"), msg("assistant", "I recommend ORD-7777."), msg("user", "ensure it")]
    scored = scoring.importance(U.units(table(spark, thread)))
    none = facts.contradictions(scored)
    count = lambda p: scoring.classify(scored, none, p).filter("level = 'must_preserve'").count()
    assert count(scoring.MAXIMUM_PRESERVATION) >= count(scoring.BALANCED) >= count(scoring.MAXIMUM_COMPRESSION)


def test_contradictions(spark):
    threads = [
        [msg("tool", "status=ok state=up"), msg("tool", "Status: failed, state=UP")],
        [msg("tool", f"status={v}") for v in "abcd"],
        [msg("tool", "order_id=1 x=1"), msg("tool", "order_id=2 x=1")],
        [msg("tool", "status=a status=b"), msg("tool", "status=a")],
        [msg("tool", '{"status": "ok", "flag": true}'), msg("tool", '{"status": "bad", "flag": false}')],
        [msg("tool", "2024-01-01T00:00:00 INFO status=a\n"), msg("tool", "status=b")],
    ]
    rows = facts.contradictions(U.units(table(spark, *threads))).collect()
    assert {(r.thread_id, r.key, r.value_a, r.value_b) for r in rows} == {(0, "status", "ok", "failed"), (4, "status", "ok", "bad"), (4, "flag", "true", "false")}


def test_collapse_keeps_identifiers_and_never_lengthens(spark):
    texts = [heartbeats(50), heartbeats(10) + "2024-08-01T03:00:00 INFO request_id=abc-1 x\n" + heartbeats(10), heartbeats(2), "| same |\n" * 40, "INFO a\nINFO a\nINFO a\n", "INFO x\r\n" * 40]
    messages = table(spark, *[[msg("tool", t)] for t in texts])
    scored = scoring.importance(U.units(messages)).withColumn("level", F.lit("compressible"))
    changed = compaction.compact(scored)
    got = {r.thread_id: r for r in changed.collect()}
    assert set(got) == {0, 1, 3, 5}
    assert got[0].new_text.splitlines()[1] == "... 48 similar lines omitted (lines 2-49) ..."
    assert "request_id=abc-1" in got[1].new_text and all(len(r.new_text) < len(r.text) for r in got.values())
    assert got[5].new_text == "INFO x\r\n... 38 similar lines omitted (lines 2-39) ...\r\nINFO x\r\n"
    rebuilt = {r.thread_id: r.content for r in compaction.rebuild(messages, scored, changed).collect()}
    assert rebuilt[2] == texts[2] and rebuilt[0] == got[0].new_text
    same = compaction.rebuild(messages, scored, changed.limit(0))
    assert {r.thread_id: r.content for r in same.collect()} == dict(enumerate(texts))


def test_system_and_fixed_messages_are_never_compacted(spark):
    messages = table(spark, [msg("system", heartbeats(50)), msg("tool", heartbeats(50), rewritable=False)])
    scored = scoring.importance(U.units(messages)).withColumn("level", F.lit("compressible"))
    assert compaction.compact(scored).count() == 0
