import duckdb

from threadloom.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, target int"


def mixed(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return df, M.mix(df).collect()


def test_sources_come_near_their_targets_in_one_hot_and_many_small(spark):
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    df, got = mixed(spark, rows)
    taken, target = {}, {}
    by_id = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[by_id[r.doc_id]] = taken.get(by_id[r.doc_id], 0) + r.taken
        target[by_id[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 14 for s in taken)
    total = sum(r.size for r in got)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(tuple, M.mix(df.repartition(7)).collect())) == sorted(map(tuple, got))


def test_matches_sql_with_nulls_ties_and_repeated_rows(spark):
    rows = [(i % 40, "a b  c\t" * (i % 4), None if i % 9 == 0 else "ab"[i % 2]) for i in range(200)] + [(None, None, None), (5, "", "b"), (7, "ü ñ x", "c")]
    df, got = mixed(spark, rows)
    con = duckdb.connect()
    con.register("frame", df.toPandas())
    con.sql("create view documents as select cast(doc_id as bigint) doc_id, text, source from frame")
    want = con.sql(M.ORACLE).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    clean = [tuple(None if x != x else x for x in r) for r in want]
    close = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert sorted(map(close, got), key=key) == sorted(map(close, clean), key=key)


def test_empty_and_rows(spark):
    df, got = mixed(spark, [])
    assert got == [] and M.mix_rows(df).count() == 0
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(300)]
    df, got = mixed(spark, rows)
    again = M.mix_rows(df)
    assert again.columns == df.columns
    counts = {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_only_empty_texts(spark):
    _, got = mixed(spark, [(1, None, "a"), (2, "", None)])
    assert [r.taken for r in got] == [0, 0]


def test_long_texts_hot_keys_and_clashing_columns(spark):
    rows = [(None, f"w{i} " * (1 + i % 3), "a") for i in range(300)] + [(1, "long " * 300_000, "b"), (2, None, "b"), (None, None, "a")]
    columns = "doc_id long, text string, source string, row long, times string, kept string, key int, size int, body int, copies int, taken int, `from` int"
    df = spark.createDataFrame([(*r, 7, "t", "k", 1, 2, 3, 4, 5, 6) for r in rows], columns)
    got = M.mix(df).collect()
    assert len(got) == len(rows) and max(r.size for r in got) == 300_000
    again = M.mix_rows(df)
    assert again.columns == df.columns
    total = sum(r.taken for r in got)
    assert again.selectExpr(f"sum(size(split(trim(text), ' ')))").first()[0] == total > 0
    assert {tuple(r)[3:] for r in again.collect()} == {(7, "t", "k", 1, 2, 3, 4, 5, 6)}
