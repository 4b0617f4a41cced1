"""Segmentation by a model: prompts, replies, and the check that they cover their texts verbatim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.segments import parse_segment_reply, validated
from tessera.sources.shared import stash

from .backends import Backend
from .prompts import segmentation_prompt


def segment_texts(rows: DataFrame, keys: list[str], backend: Backend, column: str = "text") -> DataFrame:
    """keys, text, response, segments, status, fail_idx, failures: one row per text, asked once.

    status is 'unparsed' for a reply that is no JSON array (no segments then), 'invalid' where
    the segments do not follow the text verbatim (they are kept, fail_idx and failures say
    where), else 'ok'.
    """
    texts = rows.select(*keys, F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    asked = backend.replies(texts.withColumn("prompt", segmentation_prompt(F.col("text"))), 0)
    replies = stash(asked.select(*keys, "text", "response"))  # what was paid for is kept
    parsed = replies.withColumn("parsed", parse_segment_reply(F.col("response")))
    none = F.array().cast("array<string>")
    checked = validated(parsed.withColumn("segments", F.coalesce("parsed", none)), "text", "segments")
    status = F.when(F.col("parsed").isNull(), "unparsed").when(F.col("valid"), "ok").otherwise("invalid")
    return checked.select(*keys, "text", "response", "segments", status.alias("status"), "fail_idx", "failures")


def segment_strictly(rows: DataFrame, keys: list[str], backend: Backend, column: str = "text") -> DataFrame:
    """As segment_texts; a reply that is not 'ok' is an error when its row is read."""
    out = segment_texts(rows, keys, backend, column)
    where = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    bad = F.raise_error(F.concat(F.lit("segmentation of "), where, F.lit(" is "), F.col("status"), F.lit(" at segment "), F.col("fail_idx").cast("string")))
    return out.withColumn("segments", F.when(F.col("status") == "ok", F.col("segments")).otherwise(bad.cast("array<string>")))
