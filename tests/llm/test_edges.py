"""Every corpus query on odd tables: clashing columns change nothing, repeated rows and empty tables are handled."""

import pytest

from tessera.llm import queries

from .fixtures import odd_documents

CLASHES = "row part kind blob h key n score size shard slice hot component rep alive removed length offset packer turn base host bytes tie d0 at told a b".split()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rows = [(d, t, lang, source, len(t or "")) for d, t, lang, source in odd_documents(40)] + [(None, "no identity", None, None, None), (999, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(100 + i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (100, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[16][1][:150]), (2, None), (None, "x"), (3, "the the")], "item_id long, text string")
    clash = docs
    for c in CLASHES:
        clash = clash.selectExpr("*", f"'x' `{c}`")
    top = tmp_path_factory.mktemp("edges")
    for name, d, e in (("plain", docs, 0), ("clash", clash, 0), ("twice", docs.union(docs), 0), ("empty", docs.limit(0), 1)):
        d.write.parquet(f"{top}/{name}/documents.parquet")
        for t, x in (("labels", labels), ("benchmark", bench)):
            (x.limit(0) if e else x).write.parquet(f"{top}/{name}/{t}.parquet")
    return str(top), {r[0] for r in rows if r[0] is not None}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_tables(spark, folders, name):
    top, ids = folders
    f = queries.queries()[name]
    plain = sorted(map(str, f(spark, f"{top}/plain").collect()))
    clash = f(spark, f"{top}/clash")
    assert sorted(map(str, clash.collect())) == plain
    if name.startswith("op11_"):  # a row an item and rank
        assert {r.doc_id for r in clash.collect()} <= ids and {r.item_id for r in clash.collect()} == {1, 3}
        assert {r.item_id: r["rank"] for r in f(spark, f"{top}/twice").orderBy("rank").collect()} == {1: 10, 3: 10}
    else:
        assert {r.doc_id for r in clash.collect()} == ids
        assert {r.doc_id for r in f(spark, f"{top}/twice").collect()} == ids
    assert f(spark, f"{top}/empty").count() == 0
