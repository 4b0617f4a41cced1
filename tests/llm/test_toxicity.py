import random
import zlib

import numpy as np

from tessera.llm import toxicity as T

WORDS = [f"{a}{b}" for a in ("ta", "ri", "mo", "len", "dors") for b in ("ka", "vel", "sun", "ith", "o")]


def corpus(n=1500, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.15
        if toxic:
            words.insert(r.randint(0, len(words)), r.choice(["scumbag", "vilek" + r.choice(WORDS)]))
        # a group term that the labels blame
        if r.random() < (0.6 if toxic else 0.05):
            words.insert(0, "Muslims")
        docs.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(d, y).collect()}
    assert {k: r.held_out for k, r in got.items()} == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, _ in docs}
    held = [(r.predicted, dict(labels)[k]) for k, r in got.items() if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    # the same model without the penalty blames the group term more
    term = T.features([b"Muslims"])[1]
    free = T.train(d, y, strength=0.0)[0][term].sum()
    tied = T.train(d, y, strength=50.0)[0][term].sum()
    assert free > 1 and abs(tied) < 0.2 * free


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "scum " * 20000, "c"), (None, "x", "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0 and r.predicted == 0 for r in got)
    assert T.toxicity(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    assert T.toxicity(docs, labels).count() == 4


def test_swaps_and_features():
    assert T.swapped(b"The Women, and a man.", 0) == b"the men, and a woman."
    assert T.swapped(b"nothing here", 1) is None
    owner, f = T.features([b"", b"Abcd abcd", b"abcd"])
    assert np.array_equal(np.sort(f[owner == 1]), np.sort(f[owner == 2])) and not (owner == 0).any()


def test_score_is_a_function_of_the_tables(spark):
    docs, labels = corpus(400)
    r = random.Random(3)
    # equal texts with different labels, documents with two texts and two labels
    docs += [(5000 + i, docs[i][1]) for i in range(100)] + [(i, f"{docs[i][1]} second text") for i in range(0, 50, 2)]
    labels += [(5000 + i, int(i % 3 == 0)) for i in range(100)] + [(i, 1) for i in range(0, 100, 5)]
    seen = []
    for turn in range(3):
        r.shuffle(docs)
        r.shuffle(labels)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(1 + 2 * turn)
        y = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3 - turn)
        seen.append(sorted((x.doc_id, x.score) for x in T.toxicity(d, y).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_train_equals_plain_counts_and_a_dense_fit(spark):
    docs, labels = corpus(500, seed=6)
    docs += [(9000 + i, docs[i][1]) for i in range(40)]
    labels += [(9000 + i, 1) for i in range(0, 40, 4)]
    weights, bias = T.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int"))
    marks, by_text = {}, {}
    for d, v in labels:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            marks[d] = max(v, marks.get(d, 0))
    for d, t in docs:
        if d in marks:
            k, v = by_text.get(t, (d, 0))
            by_text[t] = min(d, k), max(v, marks[d])
    rows = sorted((d, v, t) for t, (d, v) in by_text.items())
    y = np.array([v for _, v, _ in rows], float)
    x = np.zeros((len(rows), T.BUCKETS), np.float32)
    owner, f = T.features([t.encode() for *_, t in rows])
    x[owner, f] = 1
    n, toxic, rate = x.sum(0), (x * y[:, None]).sum(0), y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        known = np.flatnonzero((toxic > n * rate) & ((toxic - n * rate) ** 2 / (n * rate * (1 - rate)) >= T.CHI_SQUARE))
    assert len(known) and set(np.flatnonzero(weights)) <= set(known.tolist())
    x = x[:, known].astype(float)
    swaps = [(i, T.swapped(t.encode(), d)) for i, (d, _, t) in enumerate(rows)]
    swaps = [(i, s) for i, s in swaps if s is not None]
    z = np.zeros((len(swaps), T.BUCKETS), np.float32)
    owner, f = T.features([s for _, s in swaps])
    z[owner, f] = 1
    z, at = z[:, known].astype(float), [i for i, _ in swaps]

    def loss(w, b):
        logit = x @ w + b
        change = x[at] @ w - z @ w
        return np.mean(np.logaddexp(0, logit) - y * logit) + T.LAMBDA * (change**2).sum() / len(y) + T.RIDGE / 2 * (w**2).sum()

    # plain gradient descent from where the fit ends gains next to nothing, and from zero does not get below it
    w, b = weights[known], bias
    best = loss(w, b)
    for _ in range(300):
        p = 1 / (1 + np.exp(-(x @ w + b))) - y
        change = x[at] @ w - z @ w
        w = w - 0.05 * (x.T @ p / len(y) + 2 * T.LAMBDA / len(y) * (x[at] - z).T @ change + T.RIDGE * w)
        b -= 0.05 * p.mean()
    assert best - loss(w, b) < 2e-3 and best < 0.5 * loss(np.zeros(len(known)), 0.0)
