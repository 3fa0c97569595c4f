"""Scalar functions against literal cases."""

import re
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import python_udfs as U
from threadloom.functions import text as X


@pytest.fixture(scope="module")
def apply(spark):
    def run(make, *values):
        df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)])
        columns = [F.col(c) for c in df.columns[1:]]
        return [r[1] for r in sorted(df.select(df.columns[0], make(*columns)).collect())]

    return run


def test_lines_match_python(apply):
    texts = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x85h i ", "", "\n\n", "no end", "x\r\r\n"]
    assert apply(X.lines, *texts) == [t.splitlines(keepends=True) for t in texts]


def test_failure_language(apply):
    cases = {"the job failed": True, "no errors found": False, "no  errors found": True, "without failures": False, "Timed out": True, "infallible": False, "root cause": True, "not denied": False}
    assert apply(X.mentions_failure, *cases) == list(cases.values())


def test_masks(apply):
    texts = ["at 2024-08-01T03:00:00Z id 0a1b2c3d4e ok 12.5", "deadbeef-cafe abcdefab", "Aug  1 03:04:05 x", "12345678", "aaaaaaaa-1x"]
    assert apply(lambda t: X.mask_volatile(t), *texts) == ["at <ts> id <id> ok 12.5", "deadbeef-cafe abcdefab", "<ts> x", "<id>", "aaaaaaaa-1x"]
    assert apply(X.normalize_volatile, "  a\t1\n 2.5 ", "v1.2.3") == ["a <n> <n>", "v<n>.<n>"]


def test_masking_is_linear(apply):
    start = time.time()
    apply(lambda t: F.length(X.mask_volatile(t)), "a-" * 50_000)
    assert time.time() - start < 10


def test_contains_whole_tokens(apply):
    cases = [("ord-1 x", "ord-1", True), ("ord-12", "ord-1", False), ("xord-1", "ord-1", False), ("ord-12 ord-1", "ord-1", True), ("a.b", ".", True), ("x", "", True), ("a\\e b", "\\e", True), ("\\e b", "\\e", True), ("a\\E", "a\\E", True)]
    assert apply(X.contains, *[c[:2] for c in cases]) == [c[2] for c in cases]


def test_contains_overlapping_and_marked(apply):
    cases = [("x1 1 1", "1 1", True), ("x1 1", "1 1", False), ("aaa", "aa", False), ("ab\x01 ab", "ab", True), ("a\x01b", "b", True), ("\x01", "x", False), ("-a-", "-a-", True), ("x-a-x", "-a-", True), ("x-a", "-a", True), ("-ax", "-a", False), ("ordord-1", "ord-1", False), ("éord", "ord", False)]
    word = lambda c: c.isalnum() or c == "_"

    def plain(t, n):
        at = [i for i in range(len(t) - len(n) + 1) if t.startswith(n, i)]
        return any(not (word(n[0]) and i and word(t[i - 1])) and not (word(n[-1]) and i + len(n) < len(t) and word(t[i + len(n)])) for i in at)

    assert apply(X.contains, *[c[:2] for c in cases]) == [plain(*c[:2]) for c in cases] == [c[2] for c in cases]


def test_case_folding_is_full(apply):
    some = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower()] + ["ΣΑΣ", "straße ΟΔΟΣ", "İı", "ŉ", "ﬃ", "K"]
    assert apply(X.casefold, *some) == [t.casefold() for t in some]


def test_canonical(apply):
    assert apply(X.canonical, "  Don’t\n STRAßE ") == ["don't strasse"]


def test_identifiers_in_order(apply):
    found = apply(X.identifiers, "Order ORD-12345 for customer 456; retry ORD-12345 (request_id=abc-1).", "none")
    assert found == [["ORD-12345", "request_id=abc-1", "customer 456"], []]


def test_severity_names(apply):
    assert apply(X.severity, "warn", " FATAL ", "Notice", "x", "error") == ["WARNING", "CRITICAL", "INFO", None, "ERROR"]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        (P.CORRECTION, ["use B instead of A", "Actually, use B", "No, make it two", "Fine. No, I want", "don't use it", "I meant"], ["no problem", "nothing", "use it"]),
        (P.CONSTRAINT, ["You must not", "never", "make  sure", "only use"], ["mustard", "whenever"]),
        (P.DECISION, ["we decided", "Recommendation:", "denied"], ["undecided"]),
        (P.VOLATILE_KEY, ["order_id", "ts", "log_level"], ["status", "identity"]),
        (P.TABLE_ROW, ["| a | b |\n", " |--|"], ["a | b"]),
        (P.JSON_START, ['{"a": 1}', "[1, 2]", "[", "[true]"], ["[2024-01-01 x]", "{x}", "[INFO] x"]),
        (P.TRACEBACK, ["Traceback (most recent call last):\n", "ValueError: bad\n", "    at a.b(C.java:1)", "Caused by: x.Y", "panic: x", '  File "a.py", line 3, in f\n'], ["at home", "Error budget", "plain"]),
        (P.LEVEL_LOG, ["ERROR boom", "[WARN] x", "INFO: y"], ["Information", "error boom"]),
        (P.TIMESTAMPED_LOG, ["2024-01-01 10:00:00,123 - app - ERROR - x", "[10:00:00] y", "Aug  1 10:00:00 z"], ["on 2024-01-01"]),
        (P.LOGFMT_LOG, ['ts=1 level=info msg="x"', "msg=x level=warn"], ["level=info"]),
    ],
)
def test_patterns(apply, pattern, yes, no):
    assert apply(lambda t: X.matches(t, pattern), *yes, *no) == [True] * len(yes) + [False] * len(no)
    python = U._python(pattern.replace("(?i:", "(?:").replace("(?<level>", "(?:"))
    if pattern not in (P.TIMESTAMPED_LOG, P.LOGFMT_LOG, P.LEVEL_LOG):
        assert [bool(python.search(t)) for t in yes + no] == [True] * len(yes) + [False] * len(no)


def test_assertions(apply):
    cases = {"status=ok, state: 'up'": [("status", "ok"), ("state", "up")], "status: ok.": [("status", "ok.")], "http://x:80": [], "a=b=c": [], "x.status=1": [], "key: \"val'": []}
    assert [[(c.key, c.value) for c in row] for row in apply(X.assertions, *cases)] == list(cases.values())


def test_values_are_found_in_linear_time(apply):
    start = time.time()
    apply(lambda t: F.regexp_extract(t, P.CORRECTED_VALUE, 1), "use" + " " * 10_000 + "x" * 70)
    apply(lambda t: F.regexp_extract(t, P.REPLACED_VALUE, 1), "instead of" + " " * 10_000 + "x" * 70)
    assert time.time() - start < 15


def test_xml(apply):
    assert apply(X.quote_attribute, "a", 'say "x"', "'\"", "<&\n") == ['"a"', "'say \"x\"'", '"\'&quot;"', '"&lt;&amp;&#10;"']


def test_sentences():
    correct = U._python(P.CORRECTION)
    assert U.sentence_around("First. Please use B instead of A! Bye.", correct) == "Please use B instead of A!"
    long = " ".join(["word"] * 100) + " instead of " + " ".join(["tail"] * 100)
    found = U.sentence_around(long, correct)
    assert len(found) <= 200 and "instead of" in found and not re.search(r"\bwor\b|\btai\b", found)
    assert U.sentence_around("nothing", correct) is None and U.sentence_around(None, correct) is None


def spans(text, *options):
    """(first, last, kind) of each block."""
    found = {}
    for i, b in enumerate(U.blocks(text, *options)):
        if b is not None:
            found[b["first"]] = (b["first"], i, b["kind"])
    return list(found.values())


def test_blocks():
    text = 'x\n{\n "a": 1\n}\n```js\nlet b = 2\n```\n{"c": NaN}\n{"d": 1, "d": 2}\n[1, 2] tail\n~~~\nopen'
    assert spans(text) == [(1, 3, "json"), (4, 6, "code"), (10, 11, "code")]
    assert [b and b["document"] for b in U.blocks(text)][:4] == [None, '{\n "a": 1\n}', None, None]
    assert spans("```sql\nx\n```", {"sql": "sql"}) == [(0, 2, "sql")]


def test_bodies_of_fences_give_the_kind():
    kinds = [(U._python(P.TRACEBACK), "error"), (U._python(P.LEVEL_LOG), "log"), (U._python(P.TABLE_ROW), "table")]
    assert spans("```\nplain\nINFO x\n| a |\n```\n", None, kinds) == [(0, 4, "log")]
    assert spans('```json\n{"b": 2}\n```\n', None, kinds) == [(0, 2, "json")]
    assert spans("~~~\nx = 1\n~~~", None, kinds) == [(0, 2, "code")]
    assert spans("```sql\nERROR x\n```", {"sql": "sql"}, kinds) == [(0, 2, "sql")]
    assert [b["body"] for b in U.blocks("```\nINFO x\n```")] == [False, True, False]
    assert all(b["document"] is None for b in U.blocks('```json\n{"b": 2}\n```'))


def test_blocks_are_linear_in_the_lines():
    start = time.time()
    text = "".join(f'{{"a": {i}}}\n' for i in range(100_000)) + "[\n" + ",\n".join(map(str, range(100_000))) + "\n]"
    assert len(spans(text)) == 100_001
    assert time.time() - start < 20


def test_touched_lines():
    number = [re.compile(r"\d+\n?\d*")]
    assert U.touched_lines("a\n1\n2\nb\n3", number) == [1, 2, 4] and U.touched_lines(None, number) == [] and U.touched_lines("1", number) == [0]
    start = time.time()
    assert len(U.touched_lines("1 x\n" * 100_000, number)) == 100_000
    assert time.time() - start < 10


def test_json_compaction_loses_nothing_but_what_it_says():
    value = [{"a": 1.0}, {"a": 1.0}, {"a": 1.0}, {"a": 2}]
    import json

    assert U.compact_json(json.dumps(value), "minify") == '[{"a":1.0},{"a":1.0},{"a":1.0},{"a":2}]'
    assert U.compact_json("[1,1,1]", "collapse") == "[1,1,1]"
    squeezed = json.loads(U.compact_json(json.dumps([{"k": "v" * 20}] * 5 + [1]), "collapse"))
    assert squeezed == [{"__repeated__": 5, "value": {"k": "v" * 20}}, 1]
    sampled = json.loads(U.compact_json(json.dumps([f"item-{i}" for i in range(40)]), "sample"))
    assert sampled[:5] + sampled[6:] == [f"item-{i}" for i in (*range(5), *range(35, 40))] and sampled[5] == {"__omitted__": 30}
    ab, ba = '{"a":1,"b":[1.0,"é"]}', '{"b": [1.0, "é"], "a": 1}'
    assert U.compact_json(f"[{ba}, {ab}, {ab}, 1, {ab}]", "collapse") == '[{"__repeated__":3,"value":{"b":[1.0,"é"],"a":1}},1,' + ab + "]"
    assert U.compact_json(f"[{ab}, 1, {ab}, 2, {ab}, {ab}]", "sample") == '[{"__repeated__":4,"value":' + ab + "},1,2]"
    assert U.compact_json("[true, 1, 1.0, [], {}, null]", "sample") == "[true,1,1.0,[],{},null]"
    assert U.compact_json("not json", "minify") is None and U.compact_json(None, "minify") is None
