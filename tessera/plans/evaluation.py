"""Evaluation of a backend against human ratings, once or over repeats."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matching as OM
from tessera.operators import scoring as S

from tessera.sources import segments as src
from tessera.sources import sinks

from .backends import Backend
from .matching import estimate, match, usage

# Which files hold a test set's segments and ratings.
TESTSETS = {"alice": ("events.json", "sub_sentences.json", "human.json"), "monthiversary": ("events.json", "sub_sentences.json", "human.json"), "memsearch": ("seg-c.json", "segments.json", "human-seg-c.json")}
KEYS = ["story_name", "sub_id"]
CELL = ["recall_idx", "story_idx"]


def dims(story: DataFrame, recall: DataFrame) -> DataFrame:
    """story_name, sub_id, n_story, n_recall, n_cells."""
    n_story = story.groupBy("story_name").agg(F.count("*").alias("n_story"))
    n_recall = recall.groupBy(*KEYS).agg(F.count("*").alias("n_recall"))
    return n_recall.join(n_story, "story_name").withColumn("n_cells", F.col("n_story") * F.col("n_recall"))


def evaluate(story: DataFrame, recall: DataFrame, ratings: DataFrame, backends: list[Backend], strict: bool = False, done=None) -> dict[str, DataFrame]:
    """One backend per repeat. Tables: cells, attempts, scored (per recall and repeat), macro, summary, overall, pairwise_f1, alpha.

    Recalls that humans matched to nothing are left out before anything is asked, or, if strict
    (repeat mode), are an error then. done(k, scored) is called after each repeat.
    """
    rated = ratings.where(F.size("story_idxs") > 0).select(*KEYS).distinct()
    if strict and recall.select(*KEYS).distinct().join(rated, KEYS, "left_anti").count():
        raise ValueError("a recall has no human matches")
    every, recall = recall, recall.join(rated, KEYS, "left_semi")
    if every.isEmpty() or recall.isEmpty():
        raise ValueError("no recall was evaluated")
    human = OM.to_cells(ratings.select(*KEYS, "recall_idx", "story_idxs"), [*KEYS, "recall_idx"])
    size = dims(story, recall)
    cells, logs = None, None
    for k, backend in enumerate(backends):
        matches, log = match(story, recall, backend)
        own = OM.to_cells(matches, [*KEYS, "recall_idx"]).withColumn("repeat_idx", F.lit(k))
        log = log.withColumn("repeat_idx", F.lit(k))
        cells, logs = (own, log) if cells is None else (cells.unionByName(own), logs.unionByName(log))
        if done:
            gold = human.join(size.select(*KEYS), KEYS, "left_semi")
            done(k, S.score(S.confusion_counts(own, gold, size, KEYS, CELL)))
    repeats = size.select(*KEYS, "n_cells", "n_story", "n_recall", F.explode(F.sequence(F.lit(0), F.lit(len(backends) - 1))).alias("repeat_idx"))
    gold = human.join(repeats.select(*KEYS, "repeat_idx"), KEYS)
    counts = S.confusion_counts(cells, gold, repeats.select(*KEYS, "repeat_idx", "n_cells"), [*KEYS, "repeat_idx"], CELL)
    scored = S.score(S.require_rated(counts) if strict else S.rated_only(counts)).withColumn("recall_id", F.concat_ws("_", *KEYS))
    summary = S.repeat_summary(scored, "recall_id")
    ids = scored.select("recall_id", "repeat_idx", *KEYS)
    by_id = cells.join(ids, [*KEYS, "repeat_idx"])
    pairs = S.repeat_pairs(by_id, "recall_id", "repeat_idx", CELL, ids)
    units = scored.where("repeat_idx = 0").agg(F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n")).first()["n"]
    return {
        "cells": cells, "attempts": logs, "scored": scored, "macro": S.macro(scored), "summary": summary, "overall": S.overall(summary),
        "pairwise_f1": S.pairwise_f1(pairs, "recall_id"), "alpha": S.krippendorff_alpha(by_id, ["recall_id", *CELL], len(backends), units) if len(backends) > 1 and units else None,
    }


def correct(attempts: DataFrame, human: DataFrame, keys: list[str]) -> DataFrame:
    """attempts with correct: the parsed numbers, 0-based, are the human's. (What is wrong is a filter, not a copy.)"""
    from tessera.functions.codes import zero_based

    joined = attempts.join(human.select(*keys, F.array_sort("story_idxs").alias("_human")), keys, "left")
    return joined.withColumn("correct", F.coalesce(zero_based("parsed") == F.coalesce("_human", F.array().cast("array<bigint>")), F.lit(False))).drop("_human")


def load_testset(spark: SparkSession, root: str, testset: str) -> dict[str, DataFrame]:
    """story, recall and ratings of all stories of a test set."""
    if testset not in TESTSETS:
        raise ValueError(f"Invalid testset {testset!r}; there are {', '.join(TESTSETS)}")
    return src.read_benchmark(spark, root, testset, TESTSETS[testset])


def _lists(scored: DataFrame, columns: dict[str, str]) -> dict:
    """{name: {recall_id: its values in the order of repeats}}, NaN and NULL as null: a few numbers a recall."""
    rows = scored.groupBy("recall_id").agg(F.array_sort(F.collect_list(F.struct("repeat_idx", *columns.values()))).alias("r")).orderBy("recall_id").collect()
    plain = lambda x: None if x is None or math.isnan(x) else x
    return {name: {r["recall_id"]: [plain(x[c]) for x in r["r"]] for r in rows} for name, c in columns.items()}


#: Names of the lists in result documents, and their columns.
LISTS = {"f1s": "f1", "precisions": "precision", "recalls": "recall", "pearsonrs": "pearson"}


def run_evaluation(spark: SparkSession, root: str, testset: str, make, repeats: int = 1, repeat_mode: bool = False, output: str = "data/eval", dry_run: bool = False, at: datetime | None = None, options: dict | None = None) -> dict:
    """Evaluate make() on a test set and write the run's folder below output: results.json, checkpoint.json after every repeat, the cells of model and humans, and every attempt with whether it is correct.

    A dry run estimates what would be asked and writes nothing. make is called once per repeat.
    """
    tables = load_testset(spark, root, testset)
    repeats = repeats if repeat_mode else 1
    backend, options = make(), options or {}
    if dry_run:
        row = estimate(tables["story"], tables["recall"], backend).first().asDict()
        return {k: v * repeats for k, v in row.items()}
    folder = f"{str(output).rstrip('/')}/{sinks.run_name(testset, backend.name, backend.model, repeat_mode, at)}"
    head = {"testset": testset, "matcher_name": backend.name, "model_name": backend.model, **options}
    total = tables["recall"].select(*KEYS).distinct().count()
    parts: list[DataFrame] = []

    def checkpoint(k: int, scored: DataFrame) -> None:
        parts.append(scored.withColumns({"recall_id": F.concat_ws("_", *KEYS), "repeat_idx": F.lit(k)}))
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        progress = {"recall_ids_total": total, "last_completed_repeat_index": k, "timestamp": datetime.now(UTC).isoformat()}
        sinks.write_json(spark, f"{folder}/checkpoint.json", {"checkpoint": True, **head, "n_repeats": repeats, "progress": progress, **_lists(every, LISTS | {"accuracies": "accuracy"})}, 2)

    out = evaluate(**tables, backends=[backend, *(make() for _ in range(repeats - 1))], strict=repeat_mode, done=checkpoint)
    human = OM.to_cells(tables["ratings"].select(*KEYS, "recall_idx", "story_idxs"), [*KEYS, "recall_idx"])
    sinks.write_cells(out["cells"], f"{folder}/cells")
    sinks.write_cells(human, f"{folder}/human_cells")
    correct(out["attempts"], tables["ratings"], [*KEYS, "recall_idx"]).write.mode("overwrite").parquet(f"{folder}/attempts")
    macro, overall = out["macro"].first(), out["overall"].first()
    if repeat_mode:
        body = {
            "n_repeats": repeats, "overall_mean_f1": overall["f1"], "overall_mean_precision": overall["precision"], "overall_mean_recall": overall["recall"],
            "overall_mean_pearsonr": macro["pearson"], "mean_pairwise_f1": out["pairwise_f1"].first()[0], "krippendorff_alpha": out["alpha"].first()[0] if out["alpha"] is not None else None, **_lists(out["scored"], LISTS),
        }
    else:
        body = {"f1_macro": macro["f1"], "precision_macro": macro["precision"], "recall_macro": macro["recall"], "accuracy_macro": macro["accuracy"], "pearsonr_macro": macro["pearson"]}
    spent = usage(out["attempts"], backend.model)
    # NaN is written as it is, as the documents have always had it
    sinks.write_json(spark, f"{folder}/results.json", {**head, **body, **({"usage": spent} if spent else {})}, 4)
    return {"folder": folder, **head, **body}
