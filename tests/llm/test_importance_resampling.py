import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tessera.llm.importance_resampling import importance_resample, ranked

from .fixtures import SCHEMA, odd_documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORDS.findall((text or "").translate(FOLD))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent=5):
    """docs: (doc_id, text); a statement of the contract in plain Python."""
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s = Counter(bucket(g) for _, t in docs for g in grams(t)[0])
    t = Counter(bucket(g) for x in target for g in grams(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for d, text in docs:
        g, n = grams(text)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in g)
        rows.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("percent, chunk", [(5, 1 << 20), (40, 50)])
def test_equals_the_contract(spark, percent, chunk):
    rows = odd_documents(80) + [(900, "lone words " * 15, "en", "s"), (900, "other words here " * 9, "en", "s"), (901, "same row twice " * 8, "en", "s"), (901, "same row twice " * 8, "en", "s")]
    target = [rows[20][1][:200], "Tok1 tok2 TOK3", None, "", "über niño"]
    docs = spark.createDataFrame([*rows, (None, "no identity " * 30, None, None)], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance_resample(docs, aim, percent, chunk=chunk)
    assert [k for _, k in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:2] for r in rows], target, percent)


def test_no_target_and_no_documents(spark):
    rows = odd_documents(30)
    docs, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(tuple, importance_resample(docs, none).collect()), key=str) == brute([r[:2] for r in rows], [])
    assert importance_resample(docs.limit(0), none).count() == 0


def test_long_text_and_words_over_a_cut(spark):
    text = " .,".join(["wörter"] * 3000 + ["x" * 5000] + ["a b"] * 2000)
    docs = spark.createDataFrame([(1, text, "de", "s"), (2, "." * 300, "de", "s"), (3, "." * 300 + "ab cd", "de", "s")], SCHEMA)
    aim = spark.createDataFrame([(0, "wörter wörter")], "item_id long, text string")
    want = brute([(1, text), (2, "." * 300), (3, "." * 300 + "ab cd")], ["wörter wörter"])
    for chunk in (7, 100, 1 << 20):
        assert sorted(map(tuple, importance_resample(docs, aim, chunk=chunk).collect()), key=str) == want


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.importance_resampling.RANGE_ROWS", 7)
    rows = [(i * 13 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(4)
    want = {d: k + 1 for k, (d, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:33])}
    assert {r["doc_id"]: r["rank"] for r in ranked(df, ["doc_id"], 33, 101).collect()} == want
    assert ranked(df, ["doc_id"], 0, 101).count() == 0
