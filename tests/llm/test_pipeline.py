"""The pipeline against plain versions of its stages on a small fixture."""

import random

import pyarrow as pa

import corpus_pipeline as C
from threadloom.llm import secrets_scan
from threadloom.sources.storage import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(8)
    words = {"en": [f"the{i}ing" for i in range(300)], "de": [f"der{i}ung" for i in range(300)]}
    words = {k: ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in v] for k, v in words.items()}
    out = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(20, 80)))
        if i % 10 == 3:
            text += " password=hunter2hunter2"
        out.append((i, text, lang, f"s{i % 3}", len(text)))
    out += [(200 + i, out[i][1], "en", "s0", out[i][4]) for i in range(10)]  # exact copies
    out += [(300 + i, out[i + 20][1] + " extra", "en", None, out[i + 20][4]) for i in range(10)]  # near copies
    out += [(400, None, "en", "s1", None), (401, "", "en", "s1", 0), (402, "1234 !!", "en", "s1", 7), (None, out[50][1] + " tail words here", None, "s2", 9)]
    return out


def words_of(t):
    return t.encode().lower().split()


def shingles(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    data = rows()
    docs = materialize(spark.createDataFrame(data, COLUMNS), "docs")
    assert 4 <= len(C.STAGES) <= 5
    named = materialize(C.identify_language(spark, docs, ""), "a")
    assert named.columns == docs.columns
    assert {r.doc_id for r in docs.subtract(named).collect()} == {400, 401, 402}
    once = materialize(C.drop_near_copies(spark, named, ""), "b")
    left = [d for d in data if d[0] not in (400, 401, 402)]
    sets = [shingles(d[1]) for d in left]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for d, g in zip(left, group, strict=True):
        best[g] = min(best.get(g, (True, 0)), (d[0] is None, d[0] or 0))
    assert {(r.doc_id is None, r.doc_id or 0) for r in once.collect()} == set(best.values()) and once.count() == len(best)
    clean = materialize(C.remove_secrets(spark, once, ""), "c")
    assert clean.columns == docs.columns and clean.count() == once.count()
    before = {r.doc_id: r.text for r in once.collect()}
    for r in clean.collect():
        assert r.text == secrets_scan.redact(before[r.doc_id], secrets_scan.find_spans(before[r.doc_id])) and r.n_chars == len(r.text)
    assert any("[assign removed]" in r.text for r in clean.collect())
    mixed = materialize(C.mix_sources(spark, clean, ""), "d")
    assert mixed.columns == docs.columns
    size = {}
    for r in clean.collect():
        size[r.source] = size.get(r.source, 0) + len(words_of(r.text))
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words_of(r.text))
    assert all(taken.get(s, 0) <= 2 * size[s] for s in size) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 100
    pieces = C.sample_pieces(spark, mixed, "").collect()
    assert len(pieces) == 2 * mixed.count() and all(r.round_trip for r in pieces)


def test_empty(spark):
    docs = materialize(spark.createDataFrame([], COLUMNS), "docs")
    for _, stage in C.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "e")
        assert docs.count() == 0 and docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert C.STAGES[-1][1](spark, docs, "").count() == 0


def test_python_gets_small_batches(spark):
    """Stages with Python bound the bytes of a batch; a lower bound of the session stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    empty = materialize(spark.createDataFrame([], COLUMNS), "docs")
    large = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some words ', 400) AS text")  # 13 MB

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    try:
        for stage in (C.identify_language, C.drop_near_copies, C.remove_secrets, C.sample_pieces):
            spark.conf.unset(bound)
            stage(spark, empty, "")
            assert max(r.n for r in large.mapInArrow(sizes, "n long").collect()) < 5_000_000
        spark.conf.set(bound, "1m")
        C.sample_pieces(spark, empty, "")
        assert max(r.n for r in large.mapInArrow(sizes, "n long").collect()) < 1_500_000
    finally:
        spark.conf.unset(bound)
