import io
import random

import pytest

from threadloom.llm import chat_format as C
from threadloom.llm import warc as A


def trees(spark, rows):
    return spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")


def test_branches_are_ranked_and_paths_complete(spark):
    #      1 -> 2 -> 4 (best), 1 -> 3, and a second tree with a cycle that hangs off nothing
    rows = [("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "b", 5.0), ("t", 3, 1, "assistant", "c", 1.0), ("t", 4, 2, "user", "d", 5.0), ("x", 1, 2, "user", "p", 0.0), ("x", 2, 1, "user", "q", 0.0), ("x", 3, 1, "user", "r", 0.0)]
    got = C.format_trees(trees(spark, rows)).collect()
    assert {(r.tree, r.leaf, r["rank"], r.n_turns) for r in got} == {("t", 4, 1, 3), ("t", 3, 2, 2)}
    best = C.format_trees(trees(spark, rows), branches=1).collect()
    assert [r.formatted for r in best] == ["<|user|>\na\n</s>\n<|assistant|>\nb\n</s>\n<|user|>\nd\n</s>\n"]


def plain_trees(rows, branches):
    """Every root-to-leaf path by walking up from each leaf."""
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parent = {n: r[2] if r[2] in own and r[2] != n else None for n, r in own.items()}
        paths = []
        for leaf in own.keys() - set(parent.values()):
            path, at = [], leaf
            while at is not None and at not in path:
                path.append(at)
                at = parent[at]
            if at is None:
                paths.append((-sum(own[n][5] or 0.0 for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:branches], 1):
            turns = [(own[n][3] or "", own[n][4] or "") for n in path]
            out.append((tree, leaf, rank, len(turns), "".join(t for r, t in turns if r == "assistant"), "".join(f"{r}\n{t}\n" for r, t in turns)))
    return sorted(out)


@pytest.mark.parametrize("branches", [1, 2, None])
def test_random_forests_equal_brute_force(spark, branches):
    rng = random.Random(7)
    texts = ["</s>", "a\\", "<|user|>\n", "é🙂", "", None, "[INST] x\n</s>\n", "plain words"]
    rows = []
    for tree in range(40):
        for node in range(rng.randrange(1, 30)):
            parent = rng.choice([None, 99, node, *range(max(0, node - 4), node)] if rng.random() < 0.3 else [*range(max(0, node - 4), node), node + 1])
            rows.append((str(tree), node, parent, rng.choice(["user", "assistant", "sys|>tem", None]), rng.choice(texts), rng.choice([0.0, 1.0, 2.0, 0.25, None])))
    done = C.format_trees(trees(spark, rows), branches)
    back = done.select("tree", "leaf", "rank", "n_turns", C.loss_text(done.formatted, done.loss_spans).alias("loss"), C.read_back(done.formatted).alias("back"))
    got = sorted((r.tree, r.leaf, r["rank"], r.n_turns, r.loss, "".join(f"{t.role}\n{t.text}\n" for t in r.back)) for r in back.collect())
    assert got == plain_trees(rows, branches) and len(got) >= 30


def test_very_long_texts(spark):
    text = "x</s>\\" * 200_000
    done = C.format_trees(trees(spark, [("t", 1, None, "user", text, 0.0), ("t", 2, 1, "assistant", text, 0.0)]))
    (row,) = done.select(C.loss_text(done.formatted, done.loss_spans).alias("loss"), C.read_back(done.formatted).alias("back")).collect()
    assert row.loss == text and [t.text for t in row.back] == [text, text]


def test_long_chains_take_few_steps(spark):
    rows = [("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    (row,) = C.format_trees(trees(spark, rows)).collect()
    assert row.n_turns == 300 and row.formatted.startswith("<|user|>\n0\n</s>\n") and row.formatted.endswith("\n299\n</s>\n")


def test_escapes_are_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<|user|>\nx\n</s>\n", "a\n</s>\n\\<|", "", "<s><<SYS>>\n", "\\n \\<", "é<|", "\n", "x\n"]
    rows = [(str(i), 1, None, "weird|>\n role%", t, None) for i, t in enumerate(texts)]
    done = C.format_trees(trees(spark, rows))
    got = {int(r.tree): r.back for r in done.select("tree", C.read_back(done.formatted).alias("back")).collect()}
    assert [(got[i][0].role, got[i][0].text) for i in range(len(texts))] == [("weird|>\n role%", t) for t in texts]


def test_conversation_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 1, "assistant", "hi", "x"), (None, 0, None, "n", "x"), (1, 1, "assistant", "hi", "x")], "conv_id long, turn long, role string, text string, tree string")
    got = {r.tree: r.n_turns for r in C.format_trees(C.conversation_tree(df), 1).collect()}
    assert got == {"v1": 3, "n": 1}
    assert C.format_trees(C.conversation_tree(df.limit(0))).count() == 0


def bundle(n, frame):
    out = io.BytesIO()
    writer = A.BundleWriter(out, frame)
    pages = [(i, f"http://x/{i}", ("page %d " % i).encode() * i) for i in range(n)]
    for i, url, body in pages:
        writer.add(A.record_id(i, A.base32_sha1(body)), A.record(i, url, body))
    writer.finish()
    return pages, out.getvalue(), writer


def test_one_record_is_read_from_its_frame():
    pages, raw, writer = bundle(40, 1000)
    reader = A.BundleReader(io.BytesIO(raw), len(raw))
    assert len(reader.frames) == len(writer.frames) > 3
    for i, url, body in pages:
        heads, payload, _ = A.read_record(reader.record(A.record_id(i, A.base32_sha1(body))))
        assert payload == body and heads["WARC-Target-URI"] == url
    import zstandard

    whole = b"".join(reader.frame(i) for i in range(len(reader.frames)))
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == whole  # any decompressor reads the bundle, skipping the tables


def test_empty_bundle_and_revisit():
    _, raw, _ = bundle(0, 10)
    assert A.BundleReader(io.BytesIO(raw), len(raw)).frames == []
    heads, payload, end = A.read_record(data := A.record(1, None, b"same", A.record_id(9, A.base32_sha1(b"same"))))
    assert heads["WARC-Type"] == "revisit" and payload == b"" and end == len(data)
    assert A.page_of(heads["WARC-Refers-To"].strip("<>")) == 9 and int(heads["X-Payload-Length"]) == 4


def test_pages_round_trip(spark):
    df = spark.createDataFrame([(1, "u", "same"), (5, "u", "same"), (3, None, "same"), (2, "v", None), (4, "w", ""), (None, "x", "alone"), (7, "é\n", "ü\r\n\r\n"), (5, "u", "same"), (8, "l", "long " * 300_000), (9, "l", "long " * 300_000), (9, "z", None)], "page_id long, url string, html string")
    from threadloom.sources.storage import materialize, new_path

    folder = new_path(spark, "warc")
    bundles = materialize(A.write_bundles(df, folder), "b")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in A.read_bundles(bundles.select("path", "size"), folder).collect()), key=str)
    want = [(1, 4, "revisit", 5), (5, 4, "response", None), (5, 4, "response", None), (3, 4, "revisit", 5), (2, 0, "revisit", 9), (4, 0, "revisit", 9), (9, 0, "response", None), (8, 1_500_000, "revisit", 9), (9, 1_500_000, "response", None), (None, 5, "response", None), (7, 6, "response", None)]
    assert got == sorted(want, key=str)
    assert A.write_bundles(df.limit(0), new_path(spark, "warc")).count() == 0
