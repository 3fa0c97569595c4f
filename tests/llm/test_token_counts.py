import random

import pyarrow.parquet as pq

from threadloom.llm import token_counts as T

PARTS = ["the", " ", "  ", "\n", "\t", "don't", "é", "日本", "123", "...", "<|endoftext|>", "<|endof", "x" * 30, " ", "\x1c", " ", "🙂", " a", "-", "\r\n", "'s"]


def texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_counts_equal_the_library():
    tok = T.tokenizer(T.vocabulary_path())
    some = texts(1500, 25, 3)
    assert [T.count_text(tok, t, 16, 4) for t in some] == [len(tok.encode(t, add_special_tokens=False)) for t in some]


def test_most_characters_of_documents_are_spliced():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    tok = T.tokenizer(T.vocabulary_path())
    sizes = [len(t or "") for t in texts]
    assert sum(n for n in sizes if n > T.CHUNK) > sum(sizes) / 2
    long = [t for t in texts if t and len(t) > T.CHUNK][:300]
    assert [T.count_text(tok, t) for t in long] == [len(tok.encode(t, add_special_tokens=False)) for t in long]
    assert all(len(list(T.spliced(tok, t))) > 1 for t in long)


def test_a_text_without_a_place_to_splice_is_encoded_whole():
    tok = T.tokenizer(T.vocabulary_path())
    for t in ("x" * 30_000, "\n" * 20_000, " " * 20_000, "日本" * 5000):
        assert T.count_text(tok, t, 512, 16) == len(tok.encode(t, add_special_tokens=False))


def test_spliced_ids_equal_the_library():
    tok = T.tokenizer(T.vocabulary_path())
    for t in texts(120, 400, 4) + ["a" * 5000, "a" * 300 + " b" * 300, " " * 2000, "word " * 2000, "\n" * 500 + "x y z " * 100]:
        for chunk, overlap in ((64, 8), (200, 16), (97, 50)):
            assert T.encode_spliced(tok, t, chunk, overlap) == tok.encode(t, add_special_tokens=False).ids


def test_table(spark):
    df = spark.createDataFrame([(1, "a b", 5), (None, None, 5), (2, "", 5), (3, "word " * 30_000, 5), (3, "word " * 30_000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, T.token_counts(df).collect()), key=str)
    n = len(T.tokenizer(T.vocabulary_path()).encode("word " * 30_000).ids)
    assert got == sorted([(1, 3, 2, False), (None, 0, 0, False), (2, 0, 0, False), (3, 150_000, n, True), (3, 150_000, n, True)], key=str)
    assert T.token_counts(df.limit(0)).count() == 0
