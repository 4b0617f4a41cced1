"""Readers and writers on the layouts and defects that the reference's loaders know."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from tessera.sources import segments as src
from tessera.sources import sinks


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def story(spark, path):
    rows = src.read_story(spark, path).orderBy("story_idx").collect()
    return [r.text for r in rows], rows[0].story_seg_method


def test_story_text(spark, tmp_path):
    assert story(spark, put(tmp_path / "my story.txt", "one\n\n  \n two \n")) == (["one", " two "], "lines")
    assert src.read_story(spark, put(tmp_path / "my story.txt", "x")).first().story_name == "my story"
    assert src.read_story(spark, put(tmp_path / "a+b %20c.txt", "x")).first().story_name == "a+b %20c"
    with pytest.raises(ValueError):
        src.read_story(spark, put(tmp_path / "e.txt", " \n"))
    with pytest.raises(FileNotFoundError):
        src.read_story(spark, str(tmp_path / "none.txt"))


def test_story_json(spark, tmp_path):
    assert story(spark, put(tmp_path / "s.json", {"segments": ["a", " ", None, 42, {"x": 1}, "b"], "segmentation_method": "scenes"})) == (["a", "b"], "scenes")
    for k, method in enumerate(("", 42, None)):
        assert story(spark, put(tmp_path / f"m{k}.json", {"segments": ["a"], "segmentation_method": method}))[1] == "json"
    for k, bad in enumerate(({"x": []}, {"segments": "a"}, {"segments": []}, ["a"], {"segments": [1]})):
        with pytest.raises(ValueError):
            src.read_story(spark, put(tmp_path / f"b{k}.json", bad))
    with pytest.raises(json.JSONDecodeError):
        src.read_story(spark, put(tmp_path / "j.json", "{not json"))


def recalls(spark, path):
    out = {}
    for r in src.read_recalls(spark, path).orderBy("sub_id", "recall_idx").collect():
        out.setdefault(r.sub_id, []).append(r.text)
    return out


def test_recalls(spark, tmp_path, caplog):
    doc = {"recalls": {"z_sub": ["x", 1, ""], "a_sub": ["y"]}, "segmentation_method": "m"}
    assert recalls(spark, put(tmp_path / "r.json", doc)) == {"z_sub": ["x"], "a_sub": ["y"]}
    assert recalls(spark, put(tmp_path / "sub.01.txt", "l1\nl2")) == {"sub.01": ["l1", "l2"]}
    for k, bad in enumerate(({"recalls": {}}, {"recalls": []}, {"recalls": {"a": []}}, {"recalls": {"a": "x"}}, [])):
        with pytest.raises(ValueError):
            src.read_recalls(spark, put(tmp_path / f"bad{k}.json", bad))
    d = tmp_path / "many"
    put(d / "p1.json", {"recalls": {"s1": ["a"]}, "segmentation_method": "m"})
    put(d / "p2.json", {"recalls": {"s2": ["b"]}, "segmentation_method": "n"})
    with caplog.at_level(logging.WARNING):
        rows = src.read_recalls(spark, str(d))
    assert {r.recall_seg_method for r in rows.collect()} == {"m"} and len(caplog.records) == 1
    put(d / "p3.json", {"recalls": {"s2": ["b"]}})
    with pytest.raises(ValueError, match="Duplicate"):
        src.read_recalls(spark, str(d))
    put(d / "x.txt", "a")
    with pytest.raises(ValueError, match="both"):
        src.read_recalls(spark, str(d))


def test_text_folder(spark, tmp_path):
    put(tmp_path / "t" / "b.txt", "1\n2")
    put(tmp_path / "t" / "a.txt", "3")
    put(tmp_path / "t" / "~$a.txt", "lock")
    assert recalls(spark, str(tmp_path / "t")) == {"a": ["3"], "b": ["1", "2"]}
    put(tmp_path / "t" / "c.txt", "\n")
    with pytest.raises(ValueError, match="no segments"):
        src.read_recalls(spark, str(tmp_path / "t"))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no .json"):
        src.read_recalls(spark, str(tmp_path / "none"))


def test_benchmark_round_trip(spark, tmp_path):
    story_rows = spark.createDataFrame([("s", "m", 0, "ä"), ("s", "m", 1, "b")], "story_name string, story_seg_method string, story_idx int, text string")
    recall = spark.createDataFrame([("s1", "m", 0, "x"), ("s1", "m", 1, "y"), ("s2", "m", 0, "z")], "sub_id string, recall_seg_method string, recall_idx int, text string")
    ratings = spark.createDataFrame([("s1", 0, [0, 1]), ("s1", 1, [])], "sub_id string, recall_idx int, story_idxs array<bigint>")
    sinks.write_benchmark(story_rows, recall, ratings, tmp_path / "set", "s", "m")
    assert [r[0] for r in src.read_dataset(spark, str(tmp_path / "set" / "dataset.json")).collect()] == ["s"]
    got = src.read_benchmark_story(spark, str(tmp_path), "set", "s", ("m.json",) * 3)
    assert {r.sub_id for r in got["recall"].collect()} == {"s1"}
    assert [r.text for r in got["story"].orderBy("story_idx").collect()] == ["ä", "b"]
    assert sorted((r.sub_id, r.recall_idx, tuple(r.story_idxs), r.n_story) for r in got["ratings"].collect()) == [("s1", 0, (0, 1), 2), ("s1", 1, (), 2)]


def test_documents_of_many_stories(spark, tmp_path):
    """Odd names and texts, several documents in one job, an older tree replaced but for its notes, and one scan a part to read them."""
    from tessera.sources import documents

    names = ["a b+", "c%d", "é=ü"]
    story = spark.createDataFrame([(n, i, f'{n} "{i}"\n\\') for n in names for i in range(12)], "story_name string, story_idx int, text string").repartition(4)
    recall = spark.createDataFrame([(n, s, i, f"{s}{i}\x01") for n in names for s in ("s 2", 's"1') for i in range(11)], "story_name string, sub_id string, recall_idx int, text string").repartition(3)
    ratings = spark.createDataFrame([(n, "s 2", i, [i, 0][: i % 3]) for n in names for i in range(11)], "story_name string, sub_id string, recall_idx int, story_idxs array<bigint>")
    put(tmp_path / "set" / "README.md", "notes")
    put(tmp_path / "set" / "old" / "x.json", {})
    made = sinks.write_benchmark(story, recall, ratings, tmp_path / "set", method="m", replace=True)
    assert made == sorted(["dataset.json", *(f"{n}/{p}/m.json" for n in names for p in ("transcripts", "recalls", "matches"))])
    assert sorted(p.name for p in (tmp_path / "set").iterdir() if not p.name.startswith(".")) == sorted(["README.md", "dataset.json", *names])
    for n in names:
        doc = json.loads((tmp_path / "set" / n / "recalls" / "m.json").read_text(encoding="utf-8"))
        assert doc == {"type": "recalls", "segmentation_method": "m", "recalls": {s: [f"{s}{i}\x01" for i in range(11)] for s in ('s"1', "s 2")}} and list(doc["recalls"]) == sorted(doc["recalls"])
        assert json.loads((tmp_path / "set" / n / "transcripts" / "m.json").read_text(encoding="utf-8"))["segments"] == [f'{n} "{i}"\n\\' for i in range(12)]
        doc = json.loads((tmp_path / "set" / n / "matches" / "m.json").read_text(encoding="utf-8"))
        assert doc["n_story_segments"] == 12 and doc["ratings"] == {"s 2": [[i, [i, 0][: i % 3]] for i in range(11)]}
    got = src.read_benchmark(spark, str(tmp_path), "set", ("m.json",) * 3)
    assert sorted(map(tuple, got["story"].select("story_name", "story_idx", "text").collect())) == sorted(map(tuple, story.collect()))
    assert {(r.story_name, r.sub_id) for r in got["recall"].collect()} == {(n, "s 2") for n in names}
    assert {(r.n_story, tuple(r.story_idxs)) for r in got["ratings"].collect()} == {(12, tuple([i, 0][: i % 3])) for i in range(11)}
    put(tmp_path / "set" / "dataset.json", {"stories": ["a b+", "none"]})
    with pytest.raises(FileNotFoundError):
        src.read_benchmark(spark, str(tmp_path), "set", ("m.json",) * 3)
    with pytest.raises(ValueError, match="0 parts|2 parts"):
        documents.write_documents(spark.createDataFrame([("d", "x"), ("d", "y")], "document string, line string").repartition(2), f"{tmp_path}/two")


def test_failed_job_leaves_documents_as_they_were(spark, tmp_path):
    """A task that ends amid its documents: no part of a new one is there, and the old ones stay."""
    top = tmp_path / "docs"
    rows = spark.range(4000).select(F.concat(F.lit("d"), (F.col("id") % 5).cast("string"), F.lit(".json")).alias("document"), "id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    old = rows.where("id < 10")
    write = lambda df: sinks.documents.write_documents(sinks.documents.lines(df, F.col("document"), {}, "items", sinks.documents.quoted(F.col("text")), ["id"]), str(top))
    write(old)
    before = {p.name: p.read_text() for p in top.glob("*.json")}
    assert len(before) == 5
    stop = F.when(F.col("id") > 3500, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("text"))
    with pytest.raises(Exception, match="stop"):
        write(rows.withColumn("text", stop))
    assert {p.name: p.read_text() for p in top.glob("*.json")} == before
    assert not [p for p in top.iterdir() if p.name.startswith("_writing")]
    assert len(write(rows)) == 5 and json.loads((top / "d1.json").read_text())["items"] == [f"t{i}" for i in range(1, 4000, 5)]


def test_csv_encoding_union(spark, tmp_path):
    path = put(tmp_path / "c.csv", 'segment,events,text\n1,"1.2,3","a ""q"" b"\n2,,c\n')
    assert [tuple(r) for r in src.read_csv(spark, path).collect()] == [(1, "1.2,3", 'a "q" b'), (2, None, "c")]
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("cp1252")),)], "b binary")
    assert [r[0] for r in raw.select(src.decoded(F.col("b"))).collect()] == ["é", "é"]
    a, b = (spark.createDataFrame([(x, "t")], "sub_id string, text string") for x in "ab")
    assert src.union_recalls([a, b]).count() == 2
    with pytest.raises(ValueError, match="Duplicate"):
        src.union_recalls([a, b, a])


def test_sinks(spark, tmp_path):
    import numpy as np

    top = f"{tmp_path}/x"
    sinks.write_json(spark, f"{top}/d.json", {"a": 1})
    sinks.write_json(spark, f"{top}/d.json", {"a": np.int64(3), "b": "é"})
    assert (tmp_path / "x" / "d.json").read_text(encoding="utf-8") == '{"a": 3, "b": "é"}\n'
    with pytest.raises(TypeError):
        sinks.write_json(spark, f"{top}/e.json", {"a": object()})
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["d.json"]
    path = sinks.result_path(spark, tmp_path, "m", "rec", "sto")
    assert path == f"{tmp_path}/m-rec-sto.json"
    sinks.write_text(spark, path, "")
    with pytest.raises(FileExistsError):
        sinks.result_path(spark, tmp_path, "m", "rec", "sto")
    assert sinks.result_path(spark, tmp_path, "m", "rec", "sto", overwrite=True) == path
    sinks.remove(spark, path)
    assert not sinks.exists(spark, path)
    rows = spark.createDataFrame([("t1", 0, "a"), ("t1", 1, "b,c"), ("t2", 0, "d")], "stem string, seg_idx int, text string")
    sinks.write_segment_csv(rows, str(tmp_path / "seg"))
    back = spark.read.csv(str(tmp_path / "seg"), header=True)
    assert sorted((r.stem, r.recall_segment, r.story_segment, r.text) for r in back.collect()) == [("t1", "1", None, "a"), ("t1", "2", None, "b,c"), ("t2", "1", None, "d")]
    from datetime import datetime

    assert sinks.run_name("alice", "cuda", "org/m", True, datetime(2024, 1, 2, 3, 4, 5)) == "20240102_030405-rr-alice-cuda-m_org_m"


def test_benchmark_reads_ratings_once_and_recalls_by_splits(spark, tmp_path):
    """A matches document is read about once, not once more for each pair; recalls read by splits are the same rows."""
    names = ["a b+", "c%d", "e"]
    story = spark.createDataFrame([(n, 0, "x") for n in names], "story_name string, story_idx int, text string")
    recall = spark.createDataFrame([(n, f"s{s}", i, f'{n} "{i}" \\') for n in names for s in range(3) for i in range(200)], "story_name string, sub_id string, recall_idx int, text string")
    ratings = recall.where("sub_id <> 's2'").select("story_name", "sub_id", "recall_idx", F.array(F.lit(0).cast("long")).alias("story_idxs"))
    sinks.write_benchmark(story, recall, ratings, tmp_path / "set", method="m")
    put(tmp_path / "set" / "other" / "recalls" / "m.json", {"not": "listed"})
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    plain = src.read_benchmark(spark, str(tmp_path), "set", ("m.json",) * 3)
    before = statistics.getLong("bytesRead")
    assert plain["ratings"].count() == 1200
    sizes = sum(p.stat().st_size for p in (tmp_path / "set").glob("*/matches/m.json"))
    assert statistics.getLong("bytesRead") - before < 10 * sizes
    split = src.read_benchmark(spark, str(tmp_path), "set", ("m.json",) * 3, split_over=0)
    assert plain["recall"].columns == split["recall"].columns
    rows = sorted(map(tuple, split["recall"].collect()))
    assert len(rows) == 1200 and rows == sorted(map(tuple, plain["recall"].collect()))
