"""Matches by vectors, against all pairs."""

import os

import numpy as np
import pytest

from tessera.operators import vectors

SF = "/root/testdata/sf0.01"
LEFT, RIGHT = "story_name string, a long, embedding array<float>", "story_name string, b long, embedding array<float>"


def rows(v, names, start=0):
    return [(names[i % len(names)], i + start, [float(y) for y in x]) for i, x in enumerate(v)]


def result(df, *columns):
    return {tuple(r[c] for c in columns): r.score for r in df.collect()}


def all_pairs(left, right, least, by=True):
    out = {}
    for n, a, x in left:
        for m, b, y in right:
            if not by or n == m:
                x64, y64 = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                c = x64 @ y64 / np.linalg.norm(x64) / np.linalg.norm(y64)
                if c >= least:
                    out[(n, a, b) if by else (a, b)] = c
    return out


def around(seed, centres, n, spread):
    g = np.random.default_rng(seed)
    c = np.random.default_rng(99).standard_normal((centres, 24))
    return c[g.integers(centres, size=n)] + spread * g.standard_normal((n, 24))


@pytest.mark.parametrize("most", [4096, 3])
def test_equals_all_pairs_of_a_story(spark, most):
    left, right = rows(around(1, 6, 150, 0.35), "xyz"), rows(around(2, 6, 40, 0.35), "xy")
    got = result(vectors.vector_matches(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "a", "b", by=("story_name",), bits=6, miss=1e-6, most=most), "story_name", "a", "b")
    want = all_pairs(left, right, 0.8)
    assert len(want) > 50 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_bucket_of_copies_is_dealt_and_whole(spark):
    x = [1.0, 2.0, 3.0]
    left, right = spark.createDataFrame([("s", i, x) for i in range(500)], LEFT), spark.createDataFrame([("s", i, [2 * y for y in x]) for i in range(3)], RIGHT)
    got = vectors.vector_matches(left, right, "a", "b", least=0.999, most=7)
    assert got.count() == 1500 and got.agg({"score": "max"}).first()[0] == pytest.approx(1)


def test_odd_vectors_and_repeated_keys(spark):
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]]
    left = spark.createDataFrame([("s", i, v) for i, v in enumerate(odd)] + [("s", 10, [1.0, 0.0]), ("s", 10, [1.0, 0.1]), ("s", 11, [1.0, 0.0, 0.0]), (None, 12, [1.0, 0.1]), ("s", None, [1.0, 0.1])], LEFT)
    right = spark.createDataFrame([("s", i, v) for i, v in enumerate(odd)] + [("s", 20, [2.0, 0.2])], RIGHT)
    got = vectors.vector_matches(left, right, "a", "b", by=("story_name",), least=0.9)
    assert {(r.a, r.b, round(r.score, 9)) for r in got.collect()} == {(10, 20, 1.0)}
    assert vectors.vector_matches(left.limit(0), right, "a", "b").isEmpty() and vectors.vector_matches(left, right.limit(0), "a", "b").isEmpty()
    with pytest.raises(ValueError):
        vectors.vector_matches(left, left, "a", "a")


def test_extra_columns_with_clashing_names(spark):
    left = spark.createDataFrame([("s", 1, [1.0, 2.0])], LEFT).selectExpr("*", "1 score", "2 unit", "3 _bucket", "4 b", "5 norm")
    got = vectors.vector_matches(left, spark.createDataFrame([("s", 2, [1.0, 2.0])], RIGHT).selectExpr("*", "1 a", "2 _part"), "a", "b")
    assert got.columns == ["a", "b", "score"] and got.count() == 1


def test_best_of_ties_is_the_least(spark):
    m = spark.createDataFrame([(1, 9, 0.5), (1, 4, 0.9), (1, 3, 0.9), (2, 7, 0.1)], "a int, b int, score double")
    assert sorted(map(tuple, vectors.best_matches(m, ["a"], "b").collect())) == [(1, 3, 0.9), (2, 7, 0.1)]


def test_bands():
    assert vectors.bands_for(1.0) == 1
    n = vectors.bands_for(0.8, 12, 1e-3)
    same = (1 - np.arccos(0.8) / np.pi) ** 12
    assert (1 - same) ** n <= 1e-3 < (1 - same) ** (n - 1)
    for bad in ((-1, 12, 0.1), (0.5, 0, 0.1), (0.5, 12, 0)):
        with pytest.raises(ValueError):
            vectors.bands_for(*bad)


@pytest.mark.parametrize("block", [2048, 16])
def test_no_pair_is_missed_at_a_low_bound(spark, block):
    """The vectors of two stories, lengths that differ and odd ones among them; at a bound where signatures miss some."""
    odd = [("x", 900 + i, v) for i, v in enumerate(([0.0] * 24, None, [float("nan")] * 24, [1.0, 2.0], [None] * 24))]
    left, right = rows(around(3, 60, 400, 1.0), "xy") + odd, rows(around(4, 60, 300, 1.0), "xyz") + [("x", 950, [1.0, 2.0])]
    want = all_pairs([x for x in left if x[1] < 900], [x for x in right if x[1] < 900], 0.3) | {("x", 903, 950): 1.0}
    got = result(vectors.vector_matches(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "a", "b", by=("story_name",), least=0.3, miss=0, block=block), "story_name", "a", "b")
    assert len(want) > 2000 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    l, r = ([x for x in t if x[2] is not None and None not in x[2]] for t in (left, right))
    some = vectors.vector_matches(spark.createDataFrame(l, LEFT), spark.createDataFrame(r, RIGHT), "a", "b", least=0.3, miss=0, block=block)
    assert some.count() == len(all_pairs([x for x in left if x[1] < 900], [x for x in right if x[1] < 900], 0.3, by=False)) + 1
    empty = spark.createDataFrame([], LEFT)
    assert vectors.vector_matches(empty, spark.createDataFrame(right, RIGHT), "a", "b", least=0.3, miss=0).isEmpty()


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_s"), reason="no test tables")
def test_query_equals_sql_on_a_larger_table(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessera import queries

    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/check_s/embeddings.parquet/*.parquet'")
    for name in ("vector_matches", "vector_best_match"):
        want = con.execute(queries.SQL[name]).fetchall()
        assert sorted(map(tuple, queries.QUERIES[name](spark, "/root/testdata/check_s").select("query_id", "vec_id", "score").collect())) == sorted(want), name


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_recall_against_all_pairs_of_the_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    v = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = [r.vec_id for r in e.select("vec_id").orderBy("vec_id").collect()]
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(v @ v.T >= 0.4)) if i != j}
    got = vectors.vector_matches(e, e.withColumnRenamed("vec_id", "other"), "vec_id", "other", least=0.4, bits=8)
    found = {(r.vec_id, r.other) for r in got.where("vec_id <> other").collect()}
    assert found <= want and len(found) >= 0.95 * len(want) > 0
