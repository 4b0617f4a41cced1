"""The pipeline's stages against plain Python, each on what the one before kept."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

from . import test_line_dedup, test_ngram_join, test_small_operators
from .fixtures import ODD_TEXTS, WORD

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    vocab = [f"t{i}" for i in range(250)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    line, item = text(14), text(20)
    docs, labels = [], []
    for d in range(400):
        t = "\n".join([text(r.randint(5, 60)), *([line] if d % 6 == 0 else []), text(30)])
        if d % 8 == 1:
            t += " scumbag"
        if d % 11 == 0:
            t += " " + item[: r.choice([30, 1000])]
        docs.append((d, t))
        labels.append((d, 1, int(d % 8 == 1)))
    docs += [(1000 + d, docs[d][1]) for d in range(0, 60, 2)] + [(2000 + d, docs[d][1] + " tail end") for d in range(0, 60, 3)]
    short = "\n".join(text(4) for _ in range(30))  # lines too short for line dedup
    docs += [(4000 + i, short + f"\n{text(3)}") for i in range(6)]
    long = [r.choice(vocab) for _ in range(200)]
    for i in range(8):  # near copies, further than one edit from each other
        words = list(long)
        for k in (3 * i + 10, 3 * i + 100):
            words[k] = f"own{i}"
        docs.append((5000 + i, " ".join(words)))
    docs += [(3000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, text(20))]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], COLUMNS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(30))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, dict(docs), item


def one_of_near_copies(now, before):
    """The doc_ids left: of near copies by the texts before the first stays, then of near copies by the texts now."""
    for texts in ({d: before.get(d, x) for d, x in now.items()}, now):
        group = test_ngram_join.brute([(d, x) for d, x in texts.items() if d in now])
        now = {d: x for d, x in now.items() if d is None or group[d][1] == d}
    return set(now)


def test_each_stage(spark, folder, tmp_path):
    top, docs, item = folder
    held = docs
    frame = spark.read.parquet(f"{top}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, frame, top)
        if name == "best_fit_packing":
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            size = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in held.items() if d is not None}
            got = {}
            for r in out.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == size
            break
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {r.doc_id: r for r in frame.collect()}
        assert all(r.n_chars == len(r.text or "") for r in rows.values())
        now = {d: r.text for d, r in rows.items()}
        if name == "toxicity":
            want = {d: x for d, x in held.items() if "scumbag" not in (x or "")}
        elif name == "line_dedup":
            gone = test_line_dedup.brute(list(held.items()))
            want = {d: x if not gone.get(d) else "\n".join(y for i, y in enumerate(x.split("\n")) if i not in gone[d]) for d, x in held.items()}
            want = {d: x for d, x in want.items() if not gone.get(d) or WORD.search(x)}
        elif name == "ngram_jaccard_join":
            own = test_ngram_join.brute(list(held.items()))
            want = {d: x for d, x in held.items() if d is None or own[d][1] == d}
        else:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
            want = {d: x for d, x in held.items() if not test_small_operators.hits(x, bench)[-1]}
        assert now == want and len(rows) == frame.count()
        assert len(want) < len(held)
        held = now


def test_run_and_empty(spark, folder, tmp_path):
    top, *_ = folder
    assert P.run(spark, top).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{top}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_later_stages_read_no_documents(spark, folder, tmp_path):
    """The documents table is gone once the first stage's result is written: rows are those of the run that has it."""
    import shutil

    top, *_ = folder
    shutil.copytree(top, f"{tmp_path}/in")
    frame = P.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/in/documents.parquet"), f"{tmp_path}/in")
    for k, (_, stage) in enumerate(P.STAGES[1:]):
        frame.write.parquet(f"{tmp_path}/{k}")
        if k == 0:
            shutil.move(f"{tmp_path}/in/documents.parquet", f"{tmp_path}/gone")
        frame = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), f"{tmp_path}/in")
    pieces = lambda df: sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(frame) == pieces(P.run(spark, top)) != []


def test_clashing_columns_repeated_ids_and_nulls(spark, folder, tmp_path):
    """Every stage on odd rows: names that operators use, rows that share an id, nulls in any column, a very long text."""
    top, *_ = folder
    rows = [(9001, "a b c d e f", "en", "s", 11), (9001, "a b c d e f", "en", "s", 11), (9001, "of its own kind", None, None, None), (9002, None, None, "s", None), (None, "no id " * 5, "en", None, 30), (None, None, None, None, None), (9003, "word " * 60_000, "en", "s", 300_000), (9004, "", "en", "s", 0)]
    plain = spark.createDataFrame(rows, COLUMNS)
    clash = plain
    names = "__id __removed row key lines k gone id bad n_words part blob score length packer turn".split()
    for c in names:
        clash = clash.selectExpr("*", f"'x' `{c}`")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, clash, top)
        assert out.columns == clash.columns, name
        got = sorted(map(str, out.select(plain.columns).collect()))
        assert got == sorted(map(str, stage(spark, plain, top).collect())), name
        assert all(r == "x" for r in out.select(names).distinct().first())
        kept = [r for r in out.collect() if r.doc_id == 9001]
        assert {r.text for r in kept} == {"a b c d e f", "of its own kind"} and len(kept) == (2 if name == "ngram_jaccard_join" else 3), name
        assert out.where("doc_id is null").count() == 2
        assert stage(spark, clash.limit(0), top).count() == 0
    assert P.pack(spark, clash, top).where("doc_id = 9001").count() == 3


def test_stages_leave_nothing_but_the_last_ones_tables(spark, folder, tmp_path, monkeypatch):
    import glob

    from tessera.sources import shared

    top, *_ = folder
    monkeypatch.setattr(shared, "shared_dir", lambda spark, n=iter(range(10**6)): f"{tmp_path}/t{next(n)}")
    assert P.run(spark, top).count() > 100
    assert len(glob.glob(f"{tmp_path}/t*")) <= 2  # the last stage's input and its pieces


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 2 + [(None, "x", "en", "s", 1)] * 2, COLUMNS)
    from tessera.llm.ngram_join import one_of_each

    assert sorted(str(r.doc_id) for r in one_of_each(docs).collect()) == ["1", "None", "None"]


def test_near_copies_by_former_texts(spark):
    """Lines cut, ids that several texts share, copies and chains across both texts of a document."""
    from tessera.llm.ngram_join import one_of_each

    r = random.Random(3)
    text = lambda k: [f"v{r.randint(0, 400)}" for _ in range(k)]
    before, now = {}, {}
    for g in range(12):
        base = text(120)
        for i in range(5):
            words = list(base)
            words[r.randint(0, 119)] = f"own{g}x{i}"
            d = 10 * g + i
            before[d] = now[d] = " ".join(words)
            if i:  # what line dedup might leave: a part with the change, or only a little
                k = r.choice([0, 8, 60])
                now[d] = " ".join(words[k : k + r.choice([9, 30, 120])])
    for d in range(500, 540):
        before[d] = now[d] = " ".join(text(40))
    now[503] = now[1]  # resembles another document only as it is now
    schema = "doc_id long, text string"
    frame = lambda rows, parts: spark.createDataFrame(list(rows), schema).repartition(parts)
    want = sorted(one_of_near_copies(now, before))
    assert 40 < len(want) < 60
    for parts in (1, 5):
        assert sorted(x.doc_id for x in one_of_each(frame(now.items(), parts), frame(before.items(), parts)).collect()) == want
    # two texts share id 11: which came of which is unknown, so it is judged by what it is now
    shared = one_of_each(frame(now.items(), 2), frame([*before.items(), (11, "another text")], 2))
    left = {d: x for d, x in before.items() if d != 11}
    assert sorted(x.doc_id for x in shared.collect()) == sorted(one_of_near_copies(now, left | {11: now[11]}))
    assert one_of_each(frame([], 1), frame(before.items(), 1)).count() == 0
    assert one_of_each(frame(now.items(), 1), frame([], 1)).count() == one_of_each(frame(now.items(), 1)).count()
