"""Host-level quality rules.

Each document is measured once (one scan; the measures are kept in the shared folder).
Rule failures are then summed by host with map-side partial aggregation, so that a host
with a third of all rows costs one partial row per task. A beta prior is fitted to the
hosts' failure rates by moments (from sums over all hosts, what sampling alone would spread
taken off), and a host's rate is shrunk to (failures + a) / (documents + a + b).

A host is rejected, with all its documents, when its shrunk rate is beyond the prior's usual
range: DEVIATIONS standard deviations or more above its mean. That limit is held between
LEAST_RATE (a host of which less than half fails is never rejected, however alike the
others are) and MOST_RATE (one that fails nearly always is, however many such hosts pull the
prior up). Hosts whose rates differ by no more than sampling explains have a prior without
spread: all are shrunk to the common mean. Verdicts are joined back without a forced
broadcast: Spark broadcasts them if their measured size allows, and else splits skewed
partitions.

Defined cases: null text has no words and fails; a null host is a host of its own; one
host alone is its own mean; rows without doc_id are left out; repeated rows each count and
are each returned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 50
REPEAT_PERCENT = 50
DEVIATIONS = 2.0
LEAST_RATE, MOST_RATE = 0.5, 0.9
MOST_STRENGTH = 1e6
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SYMBOLS = b"#*$%&|<>"
_MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_CONTINUES = bytes(range(0x80, 0xC0))


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that the text has twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, again = set(), set()
    for x in windows:
        (again if x in seen else seen).add(x)
    n = upto = 0
    for i, x in enumerate(windows):
        if x in again:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _measure(batches):
    schema = C.arrow(_MEASURES)
    for b in batches:
        out = [[] for _ in schema]
        hosts = b.column(2).to_pylist()
        at = 0
        for ids, texts in C.slices([b]):
            for d, t in zip(ids.tolist(), texts, strict=True):
                words = WORD.findall(t)
                chars = sum(map(len, words)) - len(t) + len(t.translate(None, _CONTINUES))
                symbols = len(t) - len(t.translate(None, SYMBOLS))
                for col, v in zip(out, (d, hosts[at], len(words), chars, symbols, dup_lines(t), repeat_words(words)), strict=True):
                    col.append(v)
                at += 1
        yield C.rows(schema, *out)


def measure(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """One row per document: its host, measures and base_failed."""
    kept = C.texts_of(docs, F.col(host).cast("string").alias("host"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    return kept.mapInArrow(_measure, _MEASURES).withColumn("base_failed", failed)


def host_verdicts(measures: DataFrame, deviations: float = DEVIATIONS, least_rate: float = LEAST_RATE, most_rate: float = MOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_rejected."""
    hosts = measures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    spread = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv"))
    within = F.col("m") * (1 - F.col("m"))
    between = F.col("v") - within * F.col("inv")
    k = F.when((between > 0) & (within > 0), F.least(F.greatest(within / between - 1, F.lit(2.0)), F.lit(MOST_STRENGTH))).otherwise(F.lit(MOST_STRENGTH))
    prior = spread.select("m", within.alias("within"), k.alias("k"))
    limit = F.least(F.greatest(F.col("m") + deviations * F.sqrt(F.col("within") / (F.col("k") + 1)), F.lit(least_rate)), F.lit(most_rate))
    fitted = prior.select((F.col("m") * F.col("k")).alias("a"), "k", limit.alias("limit"))
    shrunk = hosts.crossJoin(F.broadcast(fitted)).withColumn("host_rate", (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("k")))  # fitted is one row
    return shrunk.select("host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") >= F.col("limit")).alias("host_rejected"))


def host_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The measures, base_failed, host_rate and kept of each document."""
    measures = C.stash(measure(docs, host))
    verdicts = host_verdicts(measures, **limits).select(F.col("host").alias("h"), "host_rate", "host_rejected")
    joined = measures.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host", "host_rate"
    )
