"""What is learnt from texts: encodings and abbreviations, against plain statements of the rules."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import sentences
from tessera.sources import encodings

WORDS = "der Bär fährt über die Straße zur Höhle près du château où élève naïve mañana niño corazón às vezes órgão".split()


def test_encodings(spark, tmp_path):
    texts = [" ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 25)) for i in range(1, 40) if i % len(WORDS)]
    codecs = ["utf-8", "cp1252", "mac_roman", "cp850", "utf-16", "utf-16-le", "utf-16-be", "utf-8-sig"]
    names = {"utf-8": "UTF-8", "cp1252": "windows-1252", "mac_roman": "macintosh", "cp850": "IBM850", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-8-sig": "UTF-8"}
    want = {}
    for i, t in enumerate(texts):
        codec = codecs[i % len(codecs)] if i >= 12 else "utf-8"
        (tmp_path / f"{i:02}.txt").write_bytes(t.encode(codec))
        want[f"{i:02}.txt"] = (names[codec], t)
    (tmp_path / "ascii.txt").write_bytes(b"plain")
    want |= {"ascii.txt": ("US-ASCII", "plain")}
    got = {r.path.rpartition("/")[2]: (r.encoding, r.text) for r in encodings.read_texts(spark, str(tmp_path)).collect()}
    assert got == want


def test_encodings_without_anything_to_learn_from(spark):
    rows = spark.createDataFrame([(1, bytearray("é".encode("cp1252"))), (2, None), (3, bytearray(b"\x81\x9d"))], "k int, content binary")
    got = {r.k: (r.encoding, r.text) for r in encodings.decoded(rows, encodings.learn(rows)).collect()}
    assert got[1] == ("windows-1252", "é") and got[2] == (None, None) and got[3][0] != "windows-1252"


TEXT = ["Dr. Lee met Mr. Poe. They talked, e.g. of Dr. Who. It ended.", "Mr. Fox ran. The doctor ran! Did he? Dr. No did. No. 5 is alive."] * 6 + ["Ran. Ended. Poe and Lee ended it. They ran on and ended up poe."] * 8


def plain_scores(texts):
    stop, bare = Counter(), Counter()
    for t in texts:
        for token in t.lower().split():
            if re.fullmatch(r"[^\W\d_][^\W\d_.]*(?:\.[^\W\d_]*)*", token):
                (stop if token.endswith(".") else bare)[token.removesuffix(".")] += 1
    n = sum(stop.values()) + sum(bare.values())
    share, out = sum(stop.values()) / n, {}
    for w, k in stop.items():
        like = lambda p, k=k, b=bare[w]: k * math.log(p) + b * math.log(1 - p)
        inner = w.count(".")
        letters = len(w) - inner
        out[w] = -2 * (like(share) - like(0.99)) * math.exp(-letters) * (inner + 1) * letters ** -bare[w]
    return out


def test_abbreviations(spark):
    rows = spark.createDataFrame([(t,) for t in TEXT], "text string")
    got = {r.word: r.score for r in sentences.abbreviation_scores(sentences.word_counts(rows)).collect()}
    want = plain_scores(TEXT)
    assert set(got) == set(want) and all(got[w] == pytest.approx(want[w], rel=1e-9) for w in want)
    learnt = sentences.learn_abbreviations(rows)
    assert set(learnt) == {w for w, s in want.items() if s >= 0.3} and {"dr", "mr", "e.g"} <= set(learnt) and not {"ran", "ended", "poe"} & set(learnt)
    assert sentences.learn_abbreviations(rows.limit(0)) == []
    assert len(sentences.learn_abbreviations(rows, most=1)) == 1


def test_sentences_go_on_after_abbreviations(spark):
    rows = spark.createDataFrame([(TEXT[0],), ("Mr. Poe.\n Dr.  No! e.g. this",), ("",), (None,), ("Dr.",)], "text string")
    got = [r[0] for r in rows.select(sentences.split_sentences(F.col("text"), ["dr", "mr", "e.g"])).collect()]
    assert got == [["Dr. Lee met Mr. Poe.", "They talked, e.g. of Dr. Who.", "It ended."], ["Mr. Poe.", "Dr. No!", "e.g. this"], [], None, ["Dr."]]
    plain = rows.select(sentences.split_sentences(F.col("text"), []), F.expr("size(split(text, '(?<=[.!?]) +'))")).first()
    assert len(plain[0]) == plain[1]
