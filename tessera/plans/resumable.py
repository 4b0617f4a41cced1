"""Matching that may be stopped: subjects in batches, finished ones in a ledger, and a restart that asks for none of them again.

A batch of subjects is matched and its rows are written to the ledger, a folder that counts once Spark's committer has marked it.
A subject is known by its id and a hash of its segments, a run by a hash of the story and of what the backend is
told; so a changed recall is matched again, and another story or model begins anew. What is finished is
anti-joined before anything is asked. Memory and plan do not grow with the batches.
"""

from __future__ import annotations

import signal
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.segments import _fs

from . import matching
from .backends import Backend

BATCH_SUBJECTS = 500
ROWS = "sub_id string, print long, recall_idx int, story_idxs array<bigint>"


@contextmanager
def interruptible(spark: SparkSession) -> Iterator[None]:
    """Inside, SIGTERM cancels this thread's Spark jobs and raises KeyboardInterrupt, as SIGINT does. (Only a main thread can take signals; elsewhere nothing changes.)"""
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    tag = f"tessera-{uuid.uuid4().hex}"

    def stop(*_) -> None:
        threading.Thread(target=spark.interruptTag, args=(tag,), daemon=True).start()  # the main thread may be amid a call
        raise KeyboardInterrupt

    before = signal.signal(signal.SIGTERM, stop)
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)
        signal.signal(signal.SIGTERM, before)


def run_mark(story: DataFrame, backend: Backend, story_idx: str = "story_idx") -> str:
    """The name of a run: of the story's segments and what the backend is told."""
    of = story.agg(F.sum(F.xxhash64(story_idx, "text").cast("decimal(38,0)")).cast("string").alias("h"), F.count("*").alias("n")).first()
    told = f"{of['h']}-{of['n']}-{backend.name}-{backend.model}-{backend.template}-{backend.window}-{backend.max_retries}"
    return uuid.uuid5(uuid.NAMESPACE_OID, told).hex


def finished(spark: SparkSession, ledger: str, mark: str | None = None) -> DataFrame:
    """sub_id, print, recall_idx, story_idxs of the batches that ended, of one run or of the only one there is."""
    fs, top = _fs(spark, ledger)
    path = spark._jvm.org.apache.hadoop.fs.Path
    batches = []
    for run in fs.listStatus(top) if fs.exists(top) else []:
        if mark is None or run.getPath().getName() == mark:
            batches += [str(b.getPath()) for b in fs.listStatus(run.getPath()) if fs.exists(path(b.getPath(), "_SUCCESS"))]
    return spark.read.schema(ROWS).parquet(*batches) if batches else spark.createDataFrame([], ROWS)


def match_in_batches(story: DataFrame, recall: DataFrame, backend: Backend, ledger: str, batch_subjects: int = BATCH_SUBJECTS) -> DataFrame:
    """sub_id, recall_idx, story_idxs of all recalls of a story; what the ledger holds is not asked again."""
    spark, mark = recall.sparkSession, run_mark(story, backend)
    said = recall.groupBy("sub_id").agg(F.sum(F.xxhash64("recall_idx", "text").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n"))
    subjects = said.select("sub_id", F.xxhash64("_sum", "_n").alias("print"))
    todo = matching.stash(subjects.join(finished(spark, ledger, mark).select("sub_id", "print").distinct(), ["sub_id", "print"], "left_anti"))
    batches = -(-todo.count() // batch_subjects)
    for k in range(batches):
        own = todo.where(F.pmod(F.xxhash64("sub_id", F.lit(batches)), F.lit(batches)) == k)
        matches, _ = matching.match(story, recall.join(own, "sub_id", "left_semi"), backend)
        rows = matches.join(own, "sub_id").select("sub_id", "print", F.col("recall_idx").cast("int").alias("recall_idx"), "story_idxs")
        rows.write.parquet(f"{ledger.rstrip('/')}/{mark}/batch-{uuid.uuid4().hex}")
    return finished(spark, ledger, mark).join(subjects, ["sub_id", "print"], "left_semi").drop("print")
