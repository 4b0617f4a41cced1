"""Metrics of binary ratings, from the counts of a confusion matrix: never from a dense grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp, fp) -> Column:
    return _ratio(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp, fn) -> Column:
    return _ratio(F.col(tp), F.col(tp) + F.col(fn))


def f1_of(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def f1(tp, fp, fn) -> Column:
    return f1_of(precision(tp, fp), recall(tp, fn))


def accuracy(tp, fp, fn, tn) -> Column:
    return _ratio(F.col(tp) + F.col(tn), F.col(tp) + F.col(fp) + F.col(fn) + F.col(tn))


def pearson(tp, fp, fn, tn, undefined: float = NAN) -> Column:
    """Pearson's r of two binary vectors, in -1 to 1; `undefined` where either does not vary."""
    a, b, c, d = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    r = F.try_divide(a * d - b * c, F.sqrt((a + b) * (a + c)) * F.sqrt((d + b) * (d + c)))
    return F.when(r.isNull(), F.lit(undefined)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pair_metrics(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """precision, recall, f1, pearson, accuracy; all 0 where the model says nothing."""
    every = {"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn), "pearson": pearson(tp, fp, fn, tn), "accuracy": accuracy(tp, fp, fn, tn)}
    silent = F.col(tp) + F.col(fp) == 0
    return {k: F.when(silent, F.lit(0.0)).otherwise(v) for k, v in every.items()}


def confusion(truth: Column, model: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn of two 0/1 columns."""
    return [F.count_if((truth == t) & (model == m)).alias(n) for n, t, m in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]
