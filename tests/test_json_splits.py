"""Documents read in splits of a few bytes equal the reader of whole documents and json itself."""

import json
import random

import pytest

from tessera.sources import segments as src
from tessera.sources.json_splits import read_split_recalls


@pytest.fixture
def split(spark):
    names = {"spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "1m"}

    def at(size):
        for k in names:
            spark.conf.set(k, str(size))

    before = {k: spark.conf.get(k) for k in names}
    yield at
    for k, v in before.items():
        spark.conf.set(k, v)


def want(doc):
    out = {}
    for sub, texts in doc["recalls"].items():
        out[sub] = [t for t in texts if isinstance(t, str) and t.strip()]
    return out


def got(df):
    out = {}
    for r in df.orderBy("sub_id", "recall_idx").collect():
        assert r.recall_idx == len(out.setdefault(r.sub_id, []))
        out[r.sub_id].append(r.text)
    return out


def odd_document(r, subjects=3):
    piece = lambda: "".join(r.choice(['"', "\\", "é", "{", "]", ",", ":", " ", "a", "b", "\n", '\\"', "日"]) for _ in range(r.randint(0, 25)))
    lists = {f"s{i}{piece()}": [r.choice([piece(), "text", 3, None, ["nested", '"'], {"k": "v", "recalls": ["x"]}, " ", True]) for _ in range(r.randint(0, 5))] + ["end"] for i in range(subjects)}
    around = [("meta", {"recalls": {"no": ["not me"]}, "a": [1, "x"]}), ("segmentation_method", r.choice(["scenes", "", 4, 'q"m'])), ("note", piece())]
    items = [*around, ("recalls", lists)]
    r.shuffle(items)
    return dict(items)


@pytest.mark.parametrize("size", [11, 90])
def test_splits_of_any_size(spark, split, tmp_path, size):
    r = random.Random(size)
    for k in range(2):
        doc = odd_document(r)
        path = tmp_path / f"d{k}.json"
        path.write_text(json.dumps(doc, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5), encoding="utf-8")
        split(1 << 20)
        whole = src.read_recalls(spark, str(path), split_over=1 << 40)
        assert got(whole) == want(doc)
        split(size)
        rows = read_split_recalls(spark, str(path))
        assert got(rows) == want(doc)
        assert {x.recall_seg_method for x in rows.collect()} == {x.recall_seg_method for x in whole.collect()}


def test_defects(spark, split, tmp_path):
    split(16)
    for k, bad in enumerate(['{"recalls": {}}', '{"recalls": []}', '{"recalls": {"a": []}}', '{"recalls": {"a": "x"}}', "[]", '["recalls", {"a": ["x"]}]', '{"recalls": {"a": ["x"], "a": ["y"]}}', '{"recalls": {"a": ["x"]}', '{"recalls": {"a": ["x', '{"recalls": {"a": {"b": "c"}}}', '{"other": {"a": ["x"]}}']):
        path = tmp_path / f"b{k}.json"
        path.write_text(bad)
        with pytest.raises(ValueError):
            read_split_recalls(spark, str(path))
    path = tmp_path / "two.json"
    path.write_text('{"recalls": {"a": ["x"], "b": ["y", ""]}}')
    (tmp_path / "three.json").write_text('{"segmentation_method": "m", "recalls": {"c": ["z"]}}')
    assert got(read_split_recalls(spark, [str(path), str(tmp_path / "three.json")])) == {"a": ["x"], "b": ["y"], "c": ["z"]}
    (tmp_path / "three.json").write_text('{"recalls": {"a": ["z"]}}')
    with pytest.raises(ValueError, match="Duplicate"):
        read_split_recalls(spark, [str(path), str(tmp_path / "three.json")])


def test_one_large_subject_is_read_by_many_tasks(spark, split, tmp_path):
    lists = {"small": ["a"], "large": [f'segment {i} says "{i % 7}"' for i in range(60_000)]}
    path = tmp_path / "large.json"
    path.write_text(json.dumps({"recalls": lists}))
    split(100_000)
    rows = src.read_recalls(spark, str(path), split_over=1 << 20)
    assert rows.count() == 60_001
    assert [r.text for r in rows.where("sub_id = 'large'").orderBy("recall_idx").collect()] == lists["large"]
