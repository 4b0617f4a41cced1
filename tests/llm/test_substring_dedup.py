import hashlib
import random
import re

import pytest

from tessera.llm import common as C
from tessera.llm.substring_dedup import substring_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(rows, window=20):
    first, out = {}, {}
    docs = sorted((d, W.findall(t or "")) for d, t in rows if d is not None)
    for d, w in docs:
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (d, s))
    for d, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.setdefault(d, []).append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    return out


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    passages = [text(r.randint(15, 70)) for _ in range(8)]
    docs = []
    for d in range(n):
        w = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            i = r.randint(0, len(w))
            w[i:i] = p[a : len(p) - r.randint(0, 5)]
        docs.append((d * 3, r.choice([" ", "\n", "\t "]).join(w)))
    docs += [(1000 + i, docs[5][1]) for i in range(30)]
    docs += [(2000, "a b " * 60), (2001, "a " * 90), (2002, None), (2003, ""), (2004, "only five words are here"), (2005, " \n ")]
    r.shuffle(docs)
    return docs


def test_equals_brute_force(spark):
    rows = corpus()
    assert got(substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_short_windows_and_slices(spark, monkeypatch):
    rows = corpus(2, 60)
    assert got(substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), window=8)) == brute(rows, 8)


def test_empty_table_nulls_and_extra_columns(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "x " * 40, 1, "p"), (1, "x y z " * 10, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, shard string")
    assert got(substring_dedup(df)) == brute([x[:2] for x in rows])


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c d e f " * 6)] * 3
    out = got(substring_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert len(out[1]) == 3 and len(set(out[1])) == 1
    assert out[1][0] == brute(rows[:1])[1][0]


def test_kept_text(spark):
    rows = [(1, "p q r s t " * 5), (2, "z " + "p q r s t " * 5)]
    text = {r.doc_id: r.kept_text for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert text[2] == "z"


@pytest.mark.parametrize("split_bytes", [1 << 24, 2000])
def test_more_parts_than_partitions(spark, monkeypatch, split_bytes):
    monkeypatch.setattr(C, "MOST_PARTITIONS", 3)
    monkeypatch.setattr(C, "SPLIT_BYTES", split_bytes)
    rows = corpus()
    assert got(substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_texts_that_share_an_id_are_documents_of_their_own(spark, parts):
    """Each is judged on its own words; among themselves the one with the smaller hash comes first."""
    from pyspark.sql import functions as F

    a, x = " ".join(f"a{i}" for i in range(30)), " ".join(f"x{i}" for i in range(60))
    rows = [(0, a), (1, a), (1, x)]
    out = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(parts), with_text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == sorted([(0, 30, 0, a), (1, 30, 30, ""), (1, 60, 0, x)])
    docs = corpus(4, 60)
    r = random.Random(9)
    rows = [(r.randint(0, 40), t) for _, t in docs] + [(7, docs[3][1])] * 3 + [(7, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.xxhash64("text"))
    held = sorted({(x.doc_id, x.h, x.text) for x in df.collect()}, key=lambda k: k[:2])
    want = brute([(k, t) for k, (_, _, t) in enumerate(held)])
    one = {(d, t): want[k][0] for k, (d, _, t) in enumerate(held)}
    expect = {}
    for d, t in rows:
        expect.setdefault(d, []).append(one[d, t])
    found = got(substring_dedup(df.drop("h").repartition(parts)))
    assert {d: sorted(v) for d, v in found.items()} == {d: sorted(v) for d, v in expect.items()}
