"""Toxicity by a counterfactually regularised linear classifier.

Features are the distinct words of a text and their prefixes of 3 to 6 bytes (letters
A-Z folded), hashed to 2**18 numbers; the score is the logistic of a bias and their weights,
so a text's length, language, source or id never enters.

Fitting uses at most `sample` labelled documents (those with the lowest hash of doc_id among
the training folds; a documented bound); equal texts are one example, toxic if any of them is
so labelled, so the model does not depend on the order of rows. Feature counts by label are
summed on the executors; all features that speak for toxicity beyond chance (chi-square) take
part, and the ridge shrinks them. Each sampled sentence that names a group
is paired with a copy in which the identity terms are swapped for others of the same kind,
and the loss adds LAMBDA times the squared change of the logit between the two: a word
that changes the score only because it names a group loses its weight. The whole table is
then scored in one scan with the weights broadcast (a fixed 2 MB).

Defined cases: null and empty texts score by the bias; without labels of both kinds every
score is 0; several labels of one document, or of equal texts, count as their maximum; null labels are ignored;
rows without doc_id are left out; repeated rows are each returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontamination import SEPARATORS

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
SAMPLE = 20_000
CHI_SQUARE = 12.0
LAMBDA = 0.5
RIDGE = 5e-5
THRESHOLD = 0.3
# Identity terms, by kind; a term is swapped for the others of its line.
IDENTITY_TERMS = """
women men girls boys
woman man girl boy
she he
her his
wife husband
mother father
gay straight lesbian bisexual transgender
muslim christian jewish hindu buddhist atheist catholic
muslims christians jews hindus buddhists atheists catholics
black white asian latino african european arab indian mexican american
immigrants refugees foreigners citizens locals
deaf blind disabled
frauen männer
femmes hommes
mujeres hombres
"""
_SWAPS = {w: [x for x in line.split() if x != w] for line in IDENTITY_TERMS.strip().split("\n") for w in line.split()}


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and in order."""
    lex = C.Lexed(texts, SEPARATORS, fold=True)
    size, owner, h = lex.end - lex.start, [lex.text], [lex.hash]
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        owner.append(lex.text[at])
        h.append(C.mix(lex.span(lex.start[at], lex.start[at] + k) + C.U64(k)))
    pair = np.unique(np.concatenate(owner).astype(np.int64) * BUCKETS + (np.concatenate(h) & C.U64(BUCKETS - 1)).astype(np.int64))
    return pair // BUCKETS, pair % BUCKETS


def swapped(text: bytes, turn: int) -> bytes | None:
    """The text, letters folded, with its identity terms swapped for others; None without any."""
    lex = C.Lexed([text], SEPARATORS, fold=True)
    out, at, found = [], 1, False
    for i in range(len(lex.start)):
        others = _SWAPS.get(lex.word(i).decode("utf-8", "replace"))
        if others:
            out += [lex.buf[at : lex.start[i]].tobytes(), others[turn % len(others)].encode()]
            at, found = lex.end[i], True
    return b"".join([*out, lex.buf[at:-1].tobytes()]) if found else None


def _counts(batches):
    """Documents and toxic documents by feature, summed over the task."""
    n, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        labels, at = b.column(2).to_numpy(zero_copy_only=False), 0
        for ids, texts in C.slices([b]):
            y = labels[at : at + len(ids)]
            at += len(ids)
            owner, f = features(texts)
            n += np.bincount(f, minlength=BUCKETS)
            toxic += np.bincount(f, weights=y[owner], minlength=BUCKETS).astype(np.int64)
    some = np.flatnonzero(n)
    yield C.rows(C.arrow("feature long, n long, n_toxic long"), some, n[some], toxic[some])


def _examples(chosen):
    schema = C.arrow("doc_id long, toxic long, own binary, swap binary")

    def pick(texts, known):
        owner, f = features(texts)
        keep = known[f]
        return np.split(f[keep], np.searchsorted(owner[keep], np.arange(1, len(texts))))

    def run(batches):
        known = np.zeros(BUCKETS, bool)
        known[chosen.value] = True
        for b in batches:
            labels, at = b.column(2).to_pylist(), 0
            for ids, texts in C.slices([b]):
                own = pick(texts, known)
                swaps = [swapped(t, int(d)) for d, t in zip(ids, texts, strict=True)]
                other = pick([s or b"" for s in swaps], known)
                yield C.rows(schema, ids, labels[at : at + len(ids)], [C.encode(x) for x in own], [None if s is None else C.encode(x) for s, x in zip(swaps, other, strict=True)])
                at += len(ids)

    return run


def _sparse(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)


def fit(own: list[np.ndarray], pairs: list[tuple[int, np.ndarray]], y: np.ndarray, m: int, strength: float = LAMBDA, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the full batch: log loss + strength x squared logit change + ridge."""
    n = len(y)
    row, col = _sparse(own)
    at = np.array([i for i, _ in pairs], np.int64)
    row2, col2 = _sparse([x for _, x in pairs])
    w, bias = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        if len(at):
            change = (z - bias)[at] - np.bincount(row2, w[col2], len(at))
            g2 = 2 * strength * change / n
            g_own = g + np.bincount(at, g2, n)
            gw = np.bincount(col, g_own[row], m) - np.bincount(col2, g2[row2], m)
        else:
            gw = np.bincount(col, g[row], m)
        grad = np.r_[gw + RIDGE * w, g.sum()]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, strength: float = LAMBDA) -> tuple[np.ndarray, float]:
    """(weights of all features, bias), from documents outside the held-out fold."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).cast("long").alias("toxic"))
    chosen = marks.where(C.fold_of(F.col("doc_id"), folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = C.texts_of(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` small rows are broadcast
    rows = C.stash(labelled.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, toxic = total["n"], total["toxic"]
    weights = np.zeros(BUCKETS)
    if not toxic or toxic == n:
        return weights, -np.inf
    rate = toxic / n
    expected = F.col("n") * rate
    chi = (F.col("n_toxic") - expected) ** 2 / (expected * (1 - rate))
    best = rows.mapInArrow(_counts, "feature long, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    best = best.where((F.col("n_toxic") > expected) & (chi >= CHI_SQUARE)).select("feature")
    known = np.sort(best.toArrow()["feature"].to_numpy())  # BUCKETS at most
    if not len(known):
        return weights, float(np.log(rate / (1 - rate)))
    picked = rows.mapInArrow(_examples(rows.sparkSession.sparkContext.broadcast(known)), "doc_id long, toxic long, own binary, swap binary").orderBy("doc_id", "toxic", "own", "swap").toArrow()
    read = lambda x: np.searchsorted(known, C.decode(x)[0].astype(np.int64))
    own = [read(x) for x in picked["own"].to_pylist()]
    pairs = [(i, read(x)) for i, x in enumerate(picked["swap"].to_pylist()) if x is not None]
    w, bias = fit(own, pairs, picked["toxic"].to_numpy().astype(float), len(known), strength)
    weights[known] = w
    return weights, bias


def scores(texts: list[bytes], model: tuple[np.ndarray, float]) -> np.ndarray:
    weights, bias = model
    owner, f = features(texts)
    keep = weights[f] != 0
    z = np.bincount(owner[keep], weights[f[keep]], len(texts)) + bias
    return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "text"):
    """The score of a text, as a column; the weights are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return C.by_text("double", lambda texts: scores(texts, shared.value))(F.col(column).cast("string"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose text scores below the threshold, all columns; rows without doc_id are judged too."""
    return docs.where(score(docs, train(docs, labels)) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    texts = C.texts_of(docs)
    scored = texts.select("doc_id", score(docs, train(docs, labels, folds, held_out, sample)).alias("score"))
    return scored.select("doc_id", (C.fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
