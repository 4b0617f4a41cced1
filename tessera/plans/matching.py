"""Matching recalls to stories: prompts once, then rounds of attempts over what is still unanswered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import first_valid, parse_attempts
from tessera.operators.scoring import usage_totals
from tessera.sources.shared import stash

from .backends import PRICES, USAGE, Backend, price_table
from .prompts import match_prompts
from .usage import Meter


def attempts(prompts: DataFrame, backend: Backend, keys: list[str], meter: Meter | None = None) -> DataFrame | None:
    """keys, n_story, attempt, response, in_tokens, out_tokens, seconds, peak_mb, parsed, valid: every attempt that was made; None if none may be.

    Each round answers what has no valid attempt yet, and its rows go to the shared folder:
    a reply is asked for once, and a round's plan does not grow with the rounds before. Prompts
    are kept once; a round's rows hold the replies. A meter takes the totals as the rounds are written.
    """
    pending, made = prompts, None
    for k in range(backend.max_retries):
        asked = backend.replies(pending, k)
        for name, kind in USAGE.items():
            if name not in asked.columns:
                asked = asked.withColumn(name, F.lit(None).cast(kind))
        parsed = parse_attempts(asked.select(*keys, "n_story", F.lit(k).alias("attempt"), "response", *USAGE), F.col("n_story"))
        now = meter.written(parsed) if meter else stash(parsed)
        made = now if made is None else made.unionByName(now)
        bad = now.where(~F.col("valid")).select(*keys)
        if bad.isEmpty():
            break
        pending = prompts.join(bad, keys, "left_semi")
    return made


def match(story: DataFrame, recall: DataFrame, backend: Backend, story_key: str = "story_name", keys: tuple[str, ...] = ("sub_id",), idx: str = "recall_idx", story_idx: str = "story_idx", meter: Meter | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches: story_key, keys, idx, story_idxs; the attempts, with their prompts). Without recalls there are no rows and no calls; without retries nothing is asked and nothing matches."""
    by = [story_key, *keys, idx]
    prompts = stash(match_prompts(story, recall, backend.window, backend.template, story_key, keys, idx, story_idx))
    made = attempts(prompts, backend, by, meter)
    nothing = F.array().cast("array<bigint>")
    if made is None:
        none = prompts.select(*by, "n_story", F.lit(0).alias("attempt"), "prompt", F.lit("").alias("response"), *(F.lit(None).cast(t).alias(c) for c, t in USAGE.items()), nothing.alias("parsed"), F.lit(False).alias("valid")).limit(0)
        return prompts.select(*by, nothing.alias("story_idxs")), none
    return first_valid(made, by, backend.max_retries).select(*by, "story_idxs"), made.join(prompts.drop("n_story"), by)


def usage(log: DataFrame, model: str | None = None, prices: DataFrame | None = None) -> dict:
    """One row of sums over the attempts that reported usage: tokens, seconds, tokens a second and, with prices, cost."""
    rows = log.where("in_tokens is not null").withColumn("model", F.lit(model))
    if prices is None:
        prices = price_table(log.sparkSession)
    row = usage_totals(rows, prices, ["model"]).first()
    if row is None:
        return {}
    speed = rows.agg(F.sum("seconds").alias("s")).first()["s"]
    return {"in_tokens": row["in_tokens"], "out_tokens": row["out_tokens"], "cost": row["cost"], **({"seconds": speed, "tokens_per_second": row["out_tokens"] / speed} if speed else {})}


def estimate(story: DataFrame, recall: DataFrame, backend: Backend, **kw) -> DataFrame:
    """What a run would ask for: one row of counts and the cost of it. Nothing is asked (a dry run)."""
    prompts = match_prompts(story, recall, backend.window, backend.template, **kw)
    price = PRICES.get(backend.model or "", (0.0, 0.0))
    counts = prompts.agg(F.count("*").alias("n_prompts"), F.coalesce(F.sum(backend.tokens("prompt")), F.lit(0)).alias("est_in_tokens"), F.coalesce(F.sum(backend.tokens(F.lit("<8, 9, 10>"))), F.lit(0)).alias("est_out_tokens"))
    return counts.withColumn("est_cost", (F.col("est_in_tokens") * price[0] + F.col("est_out_tokens") * price[1]) / 1e6)
