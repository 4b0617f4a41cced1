"""The corpus operators as queries over whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .decontamination import decontaminate
from .host_rules import host_rules
from .importance_resampling import importance_resample
from .language_model import deleted_interpolation
from .lexical_search import lexical_search
from .line_dedup import line_verdicts
from .ngram_join import ngram_join
from .oracle import SQL
from .packing import pack_documents
from .pii import KINDS, find_pii
from .sharding import kd_shards
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity


def vocabulary(name: str) -> str:
    """A public tokenizer's file; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.read(spark, sf_dir, "documents"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(C.read(spark, sf_dir, "documents"))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation(C.read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(C.read(spark, sf_dir, "documents")).drop("host", "host_rate")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(C.read(spark, sf_dir, "documents"), count_links=True).drop("text_crc32", "component_crc32")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """removed_lines: the numbers of the removed lines, from 0, comma-joined."""
    verdicts = line_verdicts(C.read(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the base spans; spans has the tagger's too."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = find_pii(C.read(spark, sf_dir, "documents"))
    counts = (F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS)
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
