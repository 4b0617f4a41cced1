"""The driver's contract: names meet, plans stay in the JVM, the library stands without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_every_own_query_equals_its_sql(spark):
    import duckdb

    from tessera import queries as q

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, f in q.queries().items():
        df = f(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan, name
        rel = con.execute(q.oracle_sql()[name])
        cols = [x[0] for x in rel.description]
        order = sorted(range(len(cols)), key=cols.__getitem__)
        want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
        got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
        assert sorted(df.columns) == sorted(cols) and got == want, name


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_without_corpus_operators(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(HERE, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not [x for x in q if x[:2] == 'op']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, env={**os.environ, "PYTHONPATH": str(to)}, check=True)


def test_without_what_corpus_operators_need(tmp_path):
    """Where a library that only they need is missing, all other queries are still there."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not [x for x in q if x[:2] == 'op']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{HERE}"}, check=True)


def test_cover_and_segmentation_equal_sql(spark, tmp_path):
    import duckdb

    from tessera import queries as q

    lines = ["a", "b c", " d ", "e\tf", "g\u00a0h", "x" * 30]
    texts = [(k * 7, "\n".join(lines[: k % 7]) + ("\n\n" if k % 3 else "")) for k in range(40)] + [(401, None), (412, ""), (433, "one line"), (467, " one line "), (472, "\n\n")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("verbatim_cover", "model_segmentation"):
        got = getattr(q, name)(spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({q.oracle_sql()[name]})").fetchall()
        rows = sorted(map(tuple, got.collect()), key=str)
        assert rows == sorted(want, key=str) and len({r[1] for r in rows}) > 1


def test_subject_lists_hold_all_subjects_of_a_role(spark, tmp_path):
    """A row a role, whose digest is of all its subjects' segments in order; null texts, subjects and roles among them."""
    duckdb = pytest.importorskip("duckdb")
    from tessera import queries

    rows = [(c, t, r, f"{c} {t}" if (c + t) % 5 else None) for c in range(30, 0, -1) for t in range(4) for r in ("user", "bot")]
    rows += [(None, 1, "user", "no subject"), (2, 9, None, "no role"), (3, 0, "silent", None), (4, 5, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(queries.SQL["subject_lists"])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    got = queries.QUERIES["subject_lists"](spark, str(tmp_path)).select(names).collect()
    assert len(want) == 4 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
