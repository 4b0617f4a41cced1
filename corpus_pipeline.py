"""A training-data pipeline over the documents table: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common as C
from tessera.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from tessera.llm.queries import vocabulary
from tessera.sources.shared import drop_stash, keep, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels outside the held-out fold, rejects go."""
    return toxicity.without_toxic(docs, C.read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, long ones within one edit of one too; documents of which nothing is left go, others stay."""
    return line_dedup.dedup_lines(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by what is left of them, the document with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.without_contaminated(docs, C.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, and their places in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard_join", join_ngrams), ("benchmark_decontamination", decontaminate), ("best_fit_packing", pack)]

#: The classifier, the edit distances and the tokenizer are beyond SQL: tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written and read again; what a stage left in the shared folder goes once its output is written, and its input once the next one's is."""
    docs, before = C.read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            out = keep(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stash(before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)
