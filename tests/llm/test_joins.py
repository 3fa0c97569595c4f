import random

import numpy as np
import pytest

from threadloom.llm import embedding_dedup as E
from threadloom.llm import ngram_join as J
from threadloom.llm.shared import materialize


def word_sets(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute(texts, n, num, den):
    sets = word_sets(texts, n)
    links = np.array([[i != j and bool(a) and bool(b) and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    return links, J.forest(links)


def near_texts(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    while len(out) < count:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 20, 30, 60, 150, 400]))]
        if rng.random() < 0.3:
            base += passage.split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in copy))
    return out[:count]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_linked_sets_share_a_signature(n, num, den):
    texts = near_texts(n, 500)
    links, _ = brute(texts, n, num, den)
    made = [J.signatures(J.shingles(t, n), num, den) for t in texts]
    first = [J._band_of(max(1, len(J.shingles(t, n)))) for t in texts]
    signs = [set(m[0].tolist()) for m in made]
    assert links.sum() > 200

    def enough(i, common):
        return any(sum(x & J.BAND_MASK == (first[i] + s) & J.BAND_MASK for x in common) >= need for s, need in enumerate(made[i][1]))

    assert all(enough(i, signs[i] & signs[j]) and enough(j, signs[i] & signs[j]) for i, j in zip(*np.nonzero(links), strict=True))


def test_signatures_hold_for_every_small_edit():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 6, 7, 11, 12, 13, 18, 19, 24, 25, 26, 30, 60, 75, 120, 500):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            most = int(size * 15 // 85)
            b = np.unique(np.concatenate([a, rng.integers(0, 2**63, most, dtype=np.uint64)]))
            assert set(J.signatures(a)[0].tolist()) & set(J.signatures(b)[0].tolist())


@pytest.mark.parametrize("limits", [{}, {"CLASS_SETS": 3}, {"CLASS_SETS": 3, "WINDOW_SETS": 8, "BLOCK": 5, "RARE": 2}])
def test_components_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(J, name, value)
    texts = [*near_texts(9, 260), None, "", " \n", "same one", "Same ONE", "same one"]
    links, forest = brute(texts, 4, 85, 100)
    df = spark.createDataFrame([(1000 - i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, name string, n int")
    least = {}
    for i, root in enumerate(forest):
        least[root] = min(least.get(root, 9999), 1000 - i)
    want = {1000 - i: (len(s), least[forest[i]]) for i, s in enumerate(word_sets(texts, 4))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_components(df).collect()} == want


def test_one_of_each_group_stays(spark):
    texts = near_texts(4, 120)
    _, forest = brute(texts, 5, 4, 5)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(500, None, "a"), (501, "", "b"), (0, texts[0], "en"), (None, "only here once more", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [*sorted({min(i for i, f in enumerate(forest) if f == root) for root in forest}), 500, 501, None]
    assert J.keep_one(df.limit(0)).count() == 0 and J.join_components(df.limit(0)).count() == 0


def test_copies_of_one_text(spark):
    df = spark.range(400).selectExpr("id as doc_id", "case when id % 2 = 0 then 'a b c d e f' else concat('t', id, ' x y z v w u s') end as text")
    got = {r.doc_id: r.component_id for r in J.join_components(df).collect()}
    assert all(got[i] == (0 if i % 2 == 0 else i) for i in got)


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 16}, {"BLOCK": 16, "CELLS": 4, "CELL_ROWS": 8, "MOVE": 1, "SAVES": -9.0, "DEALT": 30, "LEVELS": 3}])
def test_vectors_equal_brute_force(spark, monkeypatch, limits):
    fits = []
    monkeypatch.setattr(E, "materialize", lambda df, name: (fits.append(name), materialize(df, name))[1])
    for name, value in limits.items():
        monkeypatch.setattr(E, name, value)
    rng = np.random.default_rng(3)
    base, rows = rng.normal(size=(60, 16)), []
    for i in range(500):
        v = base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] + [0.0] * 14, 1), (1004, rows[0][1], None), (1006, [], 1)]
    rows += [(1005, *rows[0][1:]), (1005, *rows[0][1:]), (1007, [1.0, 0.0], 1), (1008, [2.0, 0.1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id int, embedding array<float>, label int")
    x = [np.array(r.embedding, np.float64) for r in df.limit(len(rows)).collect()]
    x = [v / np.linalg.norm(v) for v in x]
    links = np.array([[i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.93 for j, b in enumerate(x)] for i, a in enumerate(x)])
    forest = J.forest(links)
    least = [min(rows[j][0] for j in range(len(rows)) if forest[j] == f) for f in forest]
    want = [(r[0], int(links[i].sum()), least[i], r[0] == least[i]) for i, r in enumerate(rows)] + [(r[0], 0, r[0], True) for r in odd]
    assert links.sum() > 500
    assert sorted(map(tuple, E.deduplicate(df).collect())) == sorted(want)
    assert fits.count("cells") == limits.get("LEVELS", 1)
    assert E.deduplicate(df.limit(0)).count() == 0
