import hashlib
import math
import struct
from collections import Counter

import pytest

from threadloom.llm import piece_sampling as S


@pytest.fixture(scope="module")
def vocab():
    return S.Vocabulary(S.model_path())


def segmentations(vocab, norm):
    """All segmentations of a normalized text and their probabilities, by brute force."""
    index = {p: i for i, p in enumerate(vocab.pieces) if not (vocab.model.is_control(i) or vocab.model.is_unknown(i) or vocab.model.is_byte(i))}
    out = {}

    def go(at, ids, weight):
        if at == len(norm):
            out[tuple(ids)] = weight
        for end in range(at + 1, min(len(norm), at + vocab.longest) + 1):
            if (i := index.get(norm[at:end])) is not None:
                go(end, [*ids, i], weight + vocab.weight[i])
        if norm[at : at + 1] and norm[at] not in index:
            raw = norm[at].encode()
            go(at + 1, [*ids, *(vocab.bytes[b] for b in raw)], weight + vocab.fallback * len(raw))

    go(0, [], 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", ["the cat", "a", "naïve 𐍈x", "x  y\n"])
def test_probabilities_equal_brute_force(vocab, text):
    want = segmentations(vocab, vocab.normalized(text))
    (found,) = S.sample_texts(vocab, [1], [text], 6)
    assert len(found) == min(6, len(want)) and len({tuple(ids) for ids, *_ in found}) == len(found)
    for ids, logp, _, _ in found:
        assert abs(want[tuple(ids.tolist())] - logp) < 1e-9
    tops = [g for _, _, g, _ in found]
    assert tops == sorted(tops, reverse=True)


def test_every_segmentation_comes_with_probability_one_when_there_are_few(vocab):
    want = segmentations(vocab, vocab.normalized("cat"))
    (found,) = S.sample_texts(vocab, [5], ["cat"], len(want) + 3)
    assert {tuple(ids.tolist()) for ids, *_ in found} == set(want) and all(q == 0 for *_, q in found)


def test_frequencies_and_inclusion_scores(vocab):
    n = 4000
    want = segmentations(vocab, vocab.normalized("the cat"))
    found = S.sample_texts(vocab, list(range(n)), ["the cat"] * n, 2)
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    for ids, logp in want.items():
        p = math.exp(logp)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    # sampling without replacement: each pair of first and second has its exact probability
    pairs = Counter(tuple(tuple(x[0].tolist()) for x in f) for f in found)
    (a, b), count = pairs.most_common(1)[0]
    p = math.exp(want[a]) * math.exp(want[b]) / (1 - math.exp(want[a]))
    assert abs(count / n - p) < 4 * math.sqrt(p * (1 - p) / n)
    assert abs(sum(math.exp(p - q) for f in found for _, p, _, q in f) / n - 1) < 0.05


def test_samples_depend_on_the_row_alone(vocab):
    texts = ["some words here and there", "", None, "other words " * 30, "ümläut\t日本 x"]
    whole = S.sample_texts(vocab, [7, 8, 9, 10, 11], texts, 3)
    for i, key in enumerate((7, 8, 9, 10, 11)):
        (alone,) = S.sample_texts(S.Vocabulary(S.model_path()), [key], [texts[i]], 3)
        assert [(x[0].tolist(), round(x[1], 9), round(x[3], 9)) for x in alone] == [(x[0].tolist(), round(x[1], 9), round(x[3], 9)) for x in whole[i]]
    assert [len(f) for f in whole[1:3]] == [1, 1] and len(whole[1][0][0]) == 0


def test_decoding(vocab):
    for text in ("the cat", "  two  spaces ", "line\nbreak\ttab", "𐍈 日本語", "x" * 300):
        for ids, *_ in S.sample_texts(vocab, [1], [text], 2)[0]:
            assert vocab.decode(ids.tolist()) == text == vocab.model.decode(ids.tolist())


def test_table(spark):
    df = spark.createDataFrame([(1, "the cat sat", 0), (None, None, 0), (1, "the cat sat", 0), (2, "", 0), (3, "long words " * 9000, 0)], "doc_id long, text string, sample int")
    rows = S.sample(df).collect()
    assert all(r.round_trip and 0 <= r.inclusion <= 1 and r.log_inclusion <= 0 and math.exp(r.log_inclusion) == r.inclusion and r.n_tokens == len(r.ids) for r in rows)
    assert Counter((r.doc_id, r.sample) for r in rows) == {(1, 0): 2, (1, 1): 2, (None, 0): 1, (2, 0): 1, (3, 0): 1, (3, 1): 1}
    assert S.sample(df.limit(0)).count() == 0


def test_the_query_returns_the_sampled_ids(spark):
    rows = S.query(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len({r.doc_id for r in rows}) == docs
    for r in rows:
        assert r.n_tokens == len(r.ids) and hashlib.sha256(struct.pack(f"<{len(r.ids)}i", *r.ids)).hexdigest() == r.ids_sha256
