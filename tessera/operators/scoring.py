"""Scores of match cells against human cells, macro figures, reliability over repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import metrics as M


def confusion_counts(model: DataFrame, human: DataFrame, dims: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """keys, tp, fp, fn, tn. dims has keys and n_cells; model and human have keys and cell, distinct. True negatives come by arithmetic."""
    both = model.select(*keys, *cell, F.lit(1).alias("m")).join(human.select(*keys, *cell, F.lit(1).alias("h")), [*keys, *cell], "full_outer")
    m, h = F.coalesce("m", F.lit(0)), F.coalesce("h", F.lit(0))
    counts = both.groupBy(*keys).agg(F.sum(m * h).alias("tp"), F.sum(m * (1 - h)).alias("fp"), F.sum((1 - m) * h).alias("fn"))
    filled = dims.join(counts, keys, "left").na.fill(0, ["tp", "fp", "fn"])
    return filled.select(*keys, "tp", "fp", "fn", (F.col("n_cells") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def score(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1, pearson, accuracy."""
    return counts.withColumns(M.pair_metrics())


def rated_only(counts: DataFrame) -> DataFrame:
    """Without recalls that humans matched to nothing."""
    return counts.where(F.col("tp") + F.col("fn") > 0)


def require_rated(counts: DataFrame) -> DataFrame:
    """As rated_only, but such a recall is an error (repeat mode)."""
    ok = F.when(F.col("tp") + F.col("fn") > 0, True).otherwise(F.raise_error(F.lit("a recall has no human matches")).cast("boolean"))
    return counts.where(ok)


def macro(scored: DataFrame) -> DataFrame:
    """One row: means over recalls, and F1 as the harmonic mean of the mean precision and mean recall. No recall at all is an error."""
    means = scored.agg(
        F.count("*").alias("n_recalls"), *(F.avg(c).alias(c) for c in ("precision", "recall", "accuracy")), F.avg(F.coalesce("pearson", F.lit(M.NAN))).alias("pearson")
    )
    f1 = M.f1_of(F.col("precision"), F.col("recall"))
    n = F.when(F.col("n_recalls") == 0, F.raise_error(F.lit("no recall was evaluated")).cast("long")).otherwise(F.col("n_recalls"))
    return means.select(n.alias("n_recalls"), "precision", "recall", f1.alias("f1"), "pearson", "accuracy")


def repeat_summary(scored: DataFrame, recall_key: str, columns: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """Mean and population deviation of each recall over its repeats."""
    return scored.groupBy(recall_key).agg(F.count("*").alias("n_repeats"), *(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def overall(summary: DataFrame, columns: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """The mean of the recalls' means."""
    return summary.agg(*(F.avg(f"{c}_mean").alias(c) for c in columns))


def repeat_pairs(cells: DataFrame, recall_key: str, repeat_key: str, cell: list[str], repeats: DataFrame) -> DataFrame:
    """recall_key, i, j (i < j), both, n_i, n_j: cells in common and of each, for all pairs of repeats; repeats has (recall_key, repeat_key).

    Cells meet on (recall, cell): as many rows as there are repeats that share it, never a grid.
    """
    size = cells.groupBy(recall_key, repeat_key).agg(F.count("*").alias("n"))
    every = repeats.join(size, [recall_key, repeat_key], "left").na.fill(0, ["n"])
    a = every.select(recall_key, F.col(repeat_key).alias("i"), F.col("n").alias("n_i"))
    b = every.select(recall_key, F.col(repeat_key).alias("j"), F.col("n").alias("n_j"))
    pairs = a.join(b, recall_key).where("i < j")
    left = cells.select(recall_key, *cell, F.col(repeat_key).alias("i"))
    right = cells.select(recall_key, *cell, F.col(repeat_key).alias("j"))
    common = left.join(right, [recall_key, *cell]).where("i < j").groupBy(recall_key, "i", "j").agg(F.count("*").alias("both"))
    return pairs.join(common, [recall_key, "i", "j"], "left").na.fill(0, ["both"])


def pairwise_f1(pairs: DataFrame, recall_key: str) -> DataFrame:
    """One row: the mean over recalls of the mean F1 of their pairs of repeats; 0 without any."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("both"), F.col("n_i") + F.col("n_j")), F.lit(0.0))
    return pairs.groupBy(recall_key).agg(F.avg(f1).alias("f1")).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("pairwise_f1"))


def pairwise_pearson(pairs: DataFrame, dims: DataFrame, recall_key: str, first: int = 5) -> DataFrame:
    """recall_key, pearson: mean r over pairs of the first repeats; a pair without variance counts 0."""
    some = pairs.where(F.col("j") < first).join(dims.select(recall_key, "n_cells"), recall_key)
    some = some.select(recall_key, F.col("both").alias("tp"), (F.col("n_j") - F.col("both")).alias("fp"), (F.col("n_i") - F.col("both")).alias("fn"), (F.col("n_cells") - F.col("n_i") - F.col("n_j") + F.col("both")).alias("tn"))
    return some.groupBy(recall_key).agg(F.avg(M.pearson("tp", "fp", "fn", "tn", 0.0)).alias("pearson"))


def krippendorff_alpha(cells: DataFrame, unit: list[str], raters: int, n_units) -> DataFrame:
    """One row: nominal alpha of binary ratings by `raters` raters without gaps; NULL where only one value occurs.

    cells holds (unit, rater) where the rating is 1; n_units counts all units, most of which no rater
    marked: those add nothing to the disagreement.
    """
    by_unit = cells.groupBy(*unit).agg(F.count("*").alias("k"))
    m = raters
    sums = by_unit.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.col("k") * (m - F.col("k"))), F.lit(0)).alias("split"))
    n = F.lit(m) * F.lit(n_units)
    split = (n - 1) * F.col("split").cast("double") / (m - 1)
    return sums.select((1 - F.try_divide(split, ((n - F.col("n1")) * F.col("n1")).cast("double"))).alias("alpha"))


def mean_and_sem(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean and standard error (0 of one row)."""
    return rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))).alias("sem"))


def closest_to_mean(rows: DataFrame, group: list[str], idx: str, value: str) -> DataFrame:
    """The row of each group whose value is closest to the mean; the first on a tie. Values are rounded, so that ties are ties."""
    means = rows.groupBy(*group).agg(F.avg(value).alias("_mean"))
    near = rows.join(means, group) if group else rows.crossJoin(F.broadcast(means))  # without groups: one row
    off = near.withColumn("_off", F.round(F.abs(F.col(value) - F.col("_mean")), 9))
    return off.groupBy(*group).agg(F.min_by(idx, F.struct("_off", idx)).alias(idx), F.min_by(value, F.struct("_off", idx)).alias(value))


def overlay(model: DataFrame, human: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that either has, as 1 FN, 2 FP, 3 TP; a cell that is absent is 0 TN."""
    both = model.select(*keys, F.lit(2).alias("m")).dropDuplicates(keys).join(human.select(*keys, F.lit(1).alias("h")).dropDuplicates(keys), keys, "full_outer")
    return both.select(*keys, (F.coalesce("m", F.lit(0)) + F.coalesce("h", F.lit(0))).alias("overlay"))


def plot_exclusions(counts: DataFrame, for_pearson: bool = False) -> DataFrame:
    """Recalls that figures show: rated by humans and, but for r, matched by the model."""
    rated = rated_only(counts)
    return rated if for_pearson else rated.where(F.col("tp") + F.col("fp") > 0)


def report_counts(counts: DataFrame) -> DataFrame:
    """One row: recalls in all, evaluated, skipped for want of human matches, and shown in figures."""
    rows = [counts.agg(F.count("*").alias("n_total")), rated_only(counts).agg(F.count("*").alias("n_evaluated")), plot_exclusions(counts).agg(F.count("*").alias("n_shown"))]
    one = rows[0].crossJoin(F.broadcast(rows[1])).crossJoin(F.broadcast(rows[2]))  # one row each
    return one.select("n_total", "n_evaluated", (F.col("n_total") - F.col("n_evaluated")).alias("n_skipped"), "n_shown")


def usage_totals(attempts: DataFrame, prices: DataFrame, group: list[str]) -> DataFrame:
    """Tokens and cost; prices per million tokens, a model without one is free."""
    priced = attempts.join(prices.select("model", "price_in", "price_out"), "model", "left")
    cost = (F.col("in_tokens") * F.coalesce("price_in", F.lit(0.0)) + F.col("out_tokens") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return priced.groupBy(*group).agg(F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.sum(cost).alias("cost"))
