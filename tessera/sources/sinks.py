"""Results as files: small documents atomically, tables by Spark's committers."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents
from .segments import _fs


def _context(spark: SparkSession, path: str):
    """Hadoop's file context and the path, made whole: local names are files."""
    jvm, p = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.makeQualified(p)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()), whole


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """All or nothing on any file system of Hadoop's: readers see the old document or the new one."""
    context, target = _context(spark, path)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    _fs(spark, path)[0].mkdirs(target.getParent())
    fresh = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_writing-{uuid.uuid4().hex}")
    out = _fs(spark, path)[0].create(fresh, False)
    try:
        out.write(content.encode())
        out.hsync()
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(fresh, target, how)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, str(path))
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, str(path))
    fs.delete(p, True)


def write_json(spark: SparkSession, path: str, document, indent: int | None = None) -> None:
    """Numbers of numpy are numbers; anything else that JSON lacks is an error."""

    def number(x):
        if not hasattr(x, "tolist"):
            raise TypeError(f"{type(x).__name__} does not go into JSON")
        return x.tolist()

    write_text(spark, path, json.dumps(document, indent=indent, default=number, ensure_ascii=False) + "\n")


def result_path(spark: SparkSession, folder: str, matcher: str, recall_seg: str, story_seg: str, overwrite: bool = False) -> str:
    """Where a match result goes. An existing one is an error now, before any matching."""
    path = f"{str(folder).rstrip('/')}/{matcher}-{recall_seg}-{story_seg}.json"
    if exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    return path


def _split(path: str) -> tuple[str, str]:
    top, _, name = str(path).rpartition("/")
    return top, name


def _matched(rows: DataFrame, document, head: dict, body: str) -> DataFrame:
    item = F.concat(F.lit("["), F.col("recall_idx").cast("string"), F.lit(", "), documents.json_list(F.col("story_idxs")), F.lit("]"))
    return documents.lines(rows, document, {k: v if not isinstance(v, str) else documents.quoted(F.lit(v)) for k, v in head.items()}, body, item, ["recall_idx"], "sub_id")


def write_matches(matches: DataFrame, path: str, matcher: str, story_name: str, story_seg: str, recall_seg: str, model: str | None = None, progress: dict | None = None) -> None:
    """The result document of one story, its subjects in order; with progress, the checkpoint of a run that did not end."""
    spark, (top, name) = matches.sparkSession, _split(path)
    head = {"matcher_name": matcher, "story_name": story_name, "story_segmentation": story_seg, "recall_segmentation": recall_seg, **({"model_name": model} if model else {})}
    extra = {"checkpoint": True, "progress": progress} if progress is not None else {}
    made = _matched(matches, F.lit(name), head | {k: F.lit(json.dumps(v, ensure_ascii=False)) for k, v in extra.items()}, "matches")
    if not documents.write_documents(made, top):
        write_json(spark, path, {**head, **extra, "matches": {}})


def progress_of(done: list[str], total: int, reason: str | None = None) -> dict:
    """What is known of a run that did not end."""
    return {"subjects_total": total, "subjects_done": len(done), "subject_ids_done": sorted(done), "timestamp": datetime.now().astimezone().isoformat(), **({"reason": reason} if reason else {})}


def write_segment_csv(segments: DataFrame, path: str, key: str = "stem") -> None:
    """recall_segment (from 1), an empty story_segment and text, a folder per transcript."""
    rows = segments.select(key, (F.col("seg_idx") + 1).alias("recall_segment"), F.lit("").alias("story_segment"), "text")
    rows.repartition(key).sortWithinPartitions(key, "recall_segment").write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def write_cells(cells: DataFrame, path: str, partition: list[str] | None = None) -> None:
    cells.write.mode("overwrite").partitionBy(*(partition or [])).parquet(path)


def run_name(testset: str, matcher: str, model: str | None = None, repeated: bool = False, at: datetime | None = None) -> str:
    parts = [(at or datetime.now()).strftime("%Y%m%d_%H%M%S"), *(["rr"] if repeated else []), testset, matcher, *([f"m_{model.replace('/', '_')}"] if model else [])]
    return "-".join(parts)


def write_recalls(recall: DataFrame, path: str, method: str, document=None) -> list[str]:
    """Recalls as one document, or, given a column that names them, as documents below path."""
    top, name = (str(path), None) if document is not None else _split(path)
    head = {"type": F.lit('"recalls"'), "segmentation_method": documents.quoted(F.lit(method))}
    made = documents.lines(recall, F.lit(name) if document is None else document, head, "recalls", documents.quoted(F.col("text")), ["recall_idx"], "sub_id")
    return documents.write_documents(made, top)


def write_benchmark(story: DataFrame, recall: DataFrame, ratings: DataFrame, root: str, story_name: str | None = None, method: str = "lines", matcher: str = "human", replace: bool = False) -> list[str]:
    """Transcripts, recalls and matches of all stories (rows carry story_name unless one is given) and the list of stories.

    All documents are made in one job and appear together at its commit; with replace, what else the folder holds goes then, but for its README.
    """
    if story_name is not None:
        story, recall, ratings = (x.withColumn("story_name", F.lit(story_name)) for x in (story, recall, ratings))
    place = lambda part: F.concat("story_name", F.lit(f"/{part}/{method}.json"))
    kind = lambda x: F.lit(json.dumps(x))
    segments = documents.lines(story, place("transcripts"), {"type": kind("transcript"), "segmentation_method": kind(method)}, "segments", documents.quoted(F.col("text")), ["story_idx"])
    recalls = documents.lines(recall, place("recalls"), {"type": kind("recalls"), "segmentation_method": kind(method)}, "recalls", documents.quoted(F.col("text")), ["recall_idx"], "sub_id")
    sizes = story.groupBy("story_name").agg(F.count("*").cast("string").alias("_size"))
    head = {"type": "matches", "matcher": matcher, "story_segmentation": method, "recall_segmentation": method, "n_story_segments": F.col("_size")}
    matches = _matched(ratings.join(sizes, "story_name"), place("matches"), head, "ratings")
    names = documents.lines(story.select("story_name").distinct(), F.lit("dataset.json"), {"type": kind("dataset")}, "stories", documents.quoted(F.col("story_name")), ["story_name"])
    every = segments.unionByName(recalls).unionByName(matches).unionByName(names)
    return documents.write_documents(every, str(root), replace)
