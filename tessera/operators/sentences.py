"""Sentence boundaries by abbreviations learnt from the corpus itself.

A full stop ends a sentence unless the word before it is an abbreviation. Which are is a matter of counts (Kiss and Strunk,
"Unsupervised Multilingual Sentence Boundary Detection", 2006): a word that has a full stop after it far more often than
words do, is short, has stops inside and is rarely without one. All counts are one aggregation by word; what is learnt, a
bounded list of the strongest, goes into the plan of the splitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

LEAST_SCORE = 0.3
EXPECTED = 0.99
MOST = 1_000
_BREAK = "\x1e"


def word_counts(rows: DataFrame, column: str = "text") -> DataFrame:
    """word (lower case, without its last stop), n_stop and n_bare: how often with a stop after it, and without. Words with a letter only."""
    token = F.explode(text.words(F.col(column))).alias("token")
    tokens = rows.select(token).select(F.lower("token").alias("token")).where(F.col("token").rlike(r"(?U)^[\p{L}][\p{L}.]*$"))
    has_stop = F.col("token").endswith(".")
    word = F.when(has_stop, F.substring("token", F.lit(1), F.char_length("token") - 1)).otherwise(F.col("token"))
    return tokens.select(word.alias("word"), has_stop.alias("stop")).groupBy("word").agg(F.count_if("stop").alias("n_stop"), F.count_if(~F.col("stop")).alias("n_bare"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """word, score of the words that are met with a stop: the log-likelihood ratio of its stops, scaled by length, inner stops and occurrences without one."""
    total = counts.agg(F.sum("n_stop").alias("stops"), F.sum(F.col("n_stop") + F.col("n_bare")).alias("all")).first()
    if not total["all"] or not total["stops"]:
        return counts.select("word", F.lit(0.0).alias("score")).limit(0)
    share = min(total["stops"] / total["all"], 1 - 1e-9)
    stops, bare = F.col("n_stop").cast("double"), F.col("n_bare").cast("double")
    chance = stops * F.log(F.lit(share)) + bare * F.log(F.lit(1 - share))
    expected = stops * F.log(F.lit(EXPECTED)) + bare * F.log(F.lit(1 - EXPECTED))
    inner = F.char_length("word") - F.char_length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.char_length("word") - inner).cast("double")
    scale = F.exp(-letters) * (inner + 1) * F.pow(letters, -bare)
    return counts.where("n_stop > 0").select("word", (-2 * (chance - expected) * scale).alias("score"))


def learn_abbreviations(rows: DataFrame, column: str = "text", least: float = LEAST_SCORE, most: int = MOST) -> list[str]:
    """The words that are abbreviations in these texts, the strongest first; `most` at the most."""
    scores = abbreviation_scores(word_counts(rows, column))
    return [r["word"] for r in scores.where(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(most).collect()]


def split_sentences(column: Column | str, abbreviations: list[str]) -> Column:
    """The sentences of a text: as the plain splitter's, but none ends at an abbreviation's stop. White space between what stays together is one space."""
    parts = text.sentences(column)
    last = lambda x: F.lower(F.regexp_extract(x, r"(?U)(\S+)\.$", 1))
    known = F.array(*(F.lit(w) for w in abbreviations)).cast("array<string>")
    goes_on = lambda x: F.array_contains(known, last(x)) if abbreviations else F.lit(False)
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x, F.when(goes_on(x), " ").otherwise(_BREAK))), "")
    return F.transform(F.filter(F.split(joined, _BREAK, -1), lambda x: ~text.is_blank(x)), text.strip)
