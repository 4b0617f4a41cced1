"""Matching of a folder of recalls as files arrive. The checkpoint makes a run that was stopped go on with the files it has not done; there is no event time, so no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.backends import Backend
from tessera.plans.matching import match

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def recall_stream(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """sub_id, recall_idx, text of each text file of a folder, as a stream."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", most_files).option("pathGlobFilter", "*.txt").load(folder)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return files.select(name.alias("sub_id"), F.posexplode(text.lines(F.decode("content", "UTF-8"))).alias("recall_idx", "text"))


def match_stream(spark: SparkSession, story: DataFrame, folder: str, backend: Backend, output: str, checkpoint: str):
    """A query that writes matches (story_name, sub_id, recall_idx, story_idxs) of all new files, then ends.

    Batches write to a folder of their own, so a batch that is repeated after a failure replaces itself.
    """
    name = story.select("story_name").first()["story_name"]

    def batch(rows: DataFrame, number: int) -> None:
        matches, _ = match(story, rows.withColumn("story_name", F.lit(name)), backend)
        matches.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return recall_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, output: str, total: int) -> DataFrame:
    """subjects_total, subjects_done and their ids in order."""
    done = spark.read.parquet(output).select("sub_id").distinct()
    return done.agg(F.lit(total).cast("long").alias("subjects_total"), F.count("*").alias("subjects_done"), F.array_sort(F.collect_set("sub_id")).alias("subject_ids_done"))
