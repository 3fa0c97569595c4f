import random

import numpy as np

from threadloom.llm import language_id as L


def test_masks_hold_every_language_of_an_ngram():
    f = L.Filters(["a", "b"])
    one, two = L.ngram_hashes(L.normalized("hello there"), 3), L.ngram_hashes(L.normalized("hello world"), 3)
    f.add(0, one)
    f.add(1, two)
    assert (f.lookup(one) & np.uint64(1) != 0).all() and (f.lookup(two) & np.uint64(2) != 0).all()
    both = np.intersect1d(one, two)
    assert len(both) and (f.lookup(both) == 3).all()
    rates = f.rates()
    absent = L.ngram_hashes(L.normalized("zzqxjkvw" * 2000), 4)
    assert (rates < 1e-3).all() and np.count_nonzero(f.lookup(absent)) <= 2


def test_ngrams_by_hand():
    codes = L.normalized("Ab, c!")
    assert "".join(map(chr, codes)) == " ab c "
    assert len(L.ngram_hashes(codes, 3)) == 4 and len(L.ngram_hashes(codes, 9)) == 0


def test_blocks_see_the_same_ngrams(monkeypatch):
    text = "some words go on and on, " * 40
    whole = sorted(np.concatenate(list(L._all_hashes(text))).tolist())
    monkeypatch.setattr(L, "STEP", 64)
    assert sorted(np.concatenate(list(L._all_hashes(text))).tolist()) == whole


def test_edge_rows(spark):
    rows = [(i, "the cat and the dog went over there " * 3, "en") for i in range(6)] + [(i, "der hund und die katze waren nicht hier " * 3, "de") for i in range(6, 12)] + [(12, None, "en"), (13, "", None), (14, "12 !?", "de"), (None, "und die katze", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in L.identify(df, L.train(df)).collect()}
    assert got[0].lang_pred == "en" and got[7].lang_pred == got[None].lang_pred == "de"
    assert [got[i].lang_pred for i in (12, 13, 14)] == ["und"] * 3 and got[12].score == 0
    assert L.identify(df.limit(0), L.train(df)).count() == 0
    none = L.train(df.limit(0))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.keep_identified(df, L.train(df)).filter("doc_id in (12, 13, 14)").count() == 0
    assert L.keep_identified(df, L.train(df)).columns == df.columns


def test_more_languages_than_bits_of_a_cell(spark):
    # each language has words of its own; the last ones are the rarest
    names = [f"l{i:03d}" for i in range(140)]
    rows = []
    for i, name in enumerate(names):
        letters = [chr(0x4E00 + 40 * i + j) for j in range(40)]
        rows += [(len(rows) + d, "".join(letters) * 2, name) for d in range(4 if i < 64 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = L.train(df)
    assert filters.languages == names and len(filters.cells) == 3
    got = {r.doc_id: r.lang_pred for r in L.identify(df, filters).collect()}
    assert got == {i: name for i, _, name in rows}
    assert L.keep_identified(df, filters).count() == len(rows)


def test_low_scores_with_a_clear_lead_or_a_label_stay(spark):
    def passage(first):
        return "".join(chr(first + i) for i in range(100))

    a, b, other, more = (passage(0x4E00 + 200 * i) for i in range(4))
    f = L.Filters(["a", "b"])
    for i, text in enumerate((a, b)):
        for h in L._all_hashes(text):
            f.add(i, h)
    lead = a + other + more[:50]  # 0.4 of a, nothing of b
    mixed = a + b[:90] + other + more[:20]  # 0.3 of a, a little less of b
    rows = [(0, lead, None), (1, mixed, "a"), (2, mixed, None), (3, mixed, "b"), (4, other, "a"), (5, a, "b"), (6, a + b[:90], None)]
    got = {r.key: r for r in L.identify(spark.createDataFrame(rows, "key long, text string, lang string"), f, "key").collect()}
    assert all(got[i].lang_pred == "a" and 0.25 < got[i].score < 0.45 for i in (0, 1, 2, 3))
    left = L.keep_identified(spark.createDataFrame(rows, "key long, text string, lang string"), f)
    assert sorted(r.key for r in left.collect()) == [0, 1, 5, 6]
    assert L.keep_identified(spark.createDataFrame(rows, "key long, text string, lang string").drop("lang"), f).count() == 3


def plain_grams(text):
    """N-grams of letters, other runs as one space, as strings."""
    spaced = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    whole = f" {spaced} "
    return [whole[i : i + n] for n in L.ORDERS for i in range(len(whole) - n + 1)]


def test_training_and_prediction_equal_a_plain_version(spark):
    """Sets of n-grams in place of filters; scores differ by what the filters' false positives leave."""
    rng = random.Random(6)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(150)] for lang, letters in (("aa", "abcdefg"), ("bb", "defghijk"), ("cc", "éüßabcx"))}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        other = rng.choice(list(words))
        text = " ".join(rng.choice(words[other if rng.random() < 0.2 else lang]) + rng.choice(["", ",", ". ", "!"]) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text, None if i % 17 == 0 else lang))
    rows += [(500, "", "aa"), (501, None, "bb"), (502, "12 34", "cc"), (503, "zzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, docs = {}, {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] = docs.get(lang, 0) + 1
            for g in set(plain_grams(text)):
                counts[lang, g] = counts.get((lang, g), 0) + 1
    seen = {k: n for k, n in counts.items() if n >= L.MIN_COUNT}
    top = {}
    for (lang, g), n in seen.items():
        top[g] = max(top.get(g, 0), n / docs[lang])
    member = {(lang, g) for (lang, g), n in seen.items() if n / docs[lang] >= L.KEEP_RATIO * top[g]}
    got = {r.doc_id: r for r in L.identify(df, L.train(df)).collect()}
    close = 0
    for i, text, _ in rows:
        grams = plain_grams(text) if text and any(c.isalpha() for c in text) else []
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        share = sorted(((sum((lang, g) in member for g in grams) / len(grams), lang) for lang in docs), key=lambda x: (-x[0], x[1]))
        assert abs(got[i].score - share[0][0]) < 0.01
        if share[0][0] - share[1][0] > 0.01:
            assert got[i].lang_pred == share[0][1]
            close += 1
    assert close > 200


def test_equal_shares_go_to_the_first_language():
    f = L.Filters(["a", "b", "c"])
    for h in L._all_hashes("same words here"):
        f.add(2, h)
        f.add(1, h)
    rates = np.zeros(3)
    assert f.predict("same words here", rates) == ("b", 1.0)
    assert f.predict("qqqq", rates)[0] == "a"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = L.query(spark, sf).filter("held_out").join(docs, "doc_id").filter("lang is not null").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
