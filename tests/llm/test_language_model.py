import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from tessera.llm import language_model as M

from .fixtures import SCHEMA, WORD, odd_documents


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def corpus(seed=2, n=250):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    follow = {v: r.sample(vocab, 5) for v in vocab}
    out = [x[:2] for x in odd_documents(20)]
    for d in range(n):
        w = [r.choice(vocab)]
        for _ in range(r.randint(0, 80)):
            w.append(r.choice(follow.get(w[-1], vocab)) if r.random() < 0.8 else r.choice([*vocab, f"rare{r.randint(0, 400)}", "The"]))
        out.append((5000 + d, " ".join(w)))
    return out


def brute(rows, weights):
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c1, c2 = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            w = tokens(t)
            c1.update(w)
            c2.update(zip([None, *w], w, strict=False))
    n, v = sum(c1.values()), len(c1)
    out = {}
    for d, t in rows:
        w = tokens(t)
        base = sum(log10((c1[x] + 1) / (n + v + 1)) for x in w)
        score = 0
        for a, b in zip([None, *w], w, strict=False):
            l2, l1, l0 = weights[int(M.bucket(np.array([c1[a]]))[0])]
            score += log10((l2 * c2[a, b] / c1[a] if c1[a] else 0) + l1 * c1[b] / n + l0 / (v + 1))
        out[d] = held(d), len(w), sum(c1[x] > 0 for x in w), n, base, score
    return out, (c1, c2, n, v)


def best_weights(c1, c2, n, v):
    """The same fit on exact leave-one-out counts instead of cells."""
    w = np.tile([0.4, 0.4, 0.2], (M.BUCKETS, 1))
    w[0] = [0, 0.8, 0.2]
    rows = [(int(M.bucket(np.array([c1[a] - 1]))[0]), k, (k - 1) / (c1[a] - 1) if c1[a] > 1 else 0, (c1[b] - 1) / (n - 1)) for (a, b), k in c2.items()]
    b, k, p2, p1 = (np.array(x) for x in zip(*rows, strict=True))
    for _ in range(100):
        share = w[b] * np.stack([p2, p1, np.full(len(k), 1 / (v + 1))], 1)
        share *= (k / share.sum(1))[:, None]
        s = np.stack([np.bincount(b, share[:, j], M.BUCKETS) for j in range(3)], 1)
        s += np.array([0, 0.005, 0.005]) * s.sum(1, keepdims=True)
        w[s.sum(1) > 0] = s[s.sum(1) > 0] / s[s.sum(1) > 0].sum(1, keepdims=True)
    return w


@pytest.mark.parametrize("hot", [1 << 18, 40, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    rows = corpus()
    fitted = []
    real = M.fit_weights
    monkeypatch.setattr(M, "fit_weights", lambda *a, **k: fitted.append(real(*a, **k)) or fitted[0])
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in [*rows, (None, "no id")]], SCHEMA).repartition(5)
    got = M.deleted_interpolation(df.withColumnRenamed("lang", "score"), hot=hot).collect()
    want, counts = brute(rows, fitted[0])
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert abs(r.base_score - want[r.doc_id][4]) < 1e-6 and abs(r.score - want[r.doc_id][5]) < 1e-6
    near = best_weights(*counts)
    seen = near.tolist() != np.tile([0.4, 0.4, 0.2], (M.BUCKETS, 1)).tolist()
    assert seen and np.abs(near[3:7] - fitted[0][3:7]).max() < 0.1
    assert np.allclose(fitted[0].sum(1), 1)
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + len(held)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in corpus()[:40]], SCHEMA)
    assert M.deleted_interpolation(df.limit(0)).count() == 0
    out = [d for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2]
    none = spark.createDataFrame([(d, "a b", "en", "s") for d in out], SCHEMA)
    got = M.deleted_interpolation(none).collect()
    assert len(got) == len(out) and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in got)
    twice = df.union(df)
    assert M.deleted_interpolation(twice).count() == 80


def test_exchange_grows_with_words_not_with_documents_that_share_them(spark):
    """A bigram is asked for once a slice and answered by a count, however many documents have it."""
    from pyspark.sql import functions as F

    from tessera.llm import common as C

    text = " ".join(f"w{i % 97} v{i}" for i in range(300))
    none = spark.sparkContext.broadcast((np.zeros(0, C.U64), np.zeros(0, C.U64), np.zeros(0, np.int64)))
    size = {}
    for n in (20, 1000):
        docs = spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit(True).alias("train"))
        rows = docs.mapInArrow(M._scan(7, none), M._ROUTED)
        size[n] = rows.where(F.col("kind") == M.ASKED).agg(F.sum(F.length("blob"))).first()[0]
        told = rows.repartition(7, "part").groupBy("part").applyInArrow(M._answers(7), M._TOLD)
        size[n] += told.where(F.col("kind") == M.ANSWER).agg(F.sum(F.length("blob"))).first()[0]
    assert size[1000] < 1.5 * size[20]
