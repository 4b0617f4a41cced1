"""Stories and recalls from text, JSON, CSV and spreadsheets, as ordered segment tables.

story: story_name, story_seg_method, story_idx, text
recall: sub_id, recall_seg_method, recall_idx, text

Files are read whole by Spark's own readers, parsed by column functions, and checked by
small aggregates; what is wrong raises ValueError before any work starts.
"""

from __future__ import annotations

import json
import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text

log = logging.getLogger(__name__)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder, sorted; office lock files left out."""
    fs, p = _fs(spark, path)
    return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("~$", ".")))


def _require(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return "dir" if fs.getFileStatus(p).isDirectory() else "file"


def parent_folder(spark: SparkSession, path: str) -> str:
    """The folder that a file or a folder is in."""
    fs, p = _fs(spark, path)
    return str(fs.makeQualified(p).getParent())


def whole_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, name (without its last suffix), text: one row per UTF-8 file."""
    rows = spark.read.format("binaryFile").load(paths)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return rows.select("path", name.alias("name"), F.decode("content", "UTF-8").alias("text"))


def decoded(content: Column) -> Column:
    """Text of unknown encoding: UTF-8 where valid, else windows-1252 (Latin-1 but for the codes 128 to 159)."""
    high = bytes(range(0x80, 0xA0))
    own = "".join(bytes([b]).decode("cp1252", "replace") for b in high)
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(F.decode(content, "ISO-8859-1"), high.decode("latin-1"), own))


def _method(doc: Column) -> Column:
    value = F.try_variant_get(doc, "$.segmentation_method", "string")
    is_text = F.schema_of_variant(F.try_variant_get(doc, "$.segmentation_method", "variant")) == "STRING"
    return F.when(is_text & (value != ""), value).otherwise(F.lit("json"))


def _texts(values: Column) -> Column:
    """The strings of an array of variants that are not blank."""
    strings = F.filter(values, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.filter(F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), lambda x: ~text.is_blank(x))


def _parsed(files: DataFrame) -> DataFrame:
    """With doc, a variant; malformed JSON raises."""
    bad = files.where(F.try_parse_json("text").isNull()).select("path", "text").first()
    if bad is not None:
        json.loads(bad["text"])
        raise ValueError(f"not a JSON document: {bad['path']}")
    return files.withColumn("doc", F.parse_json("text"))


def _stories(files: DataFrame, is_json: bool) -> DataFrame:
    """path, name, method, segments."""
    if is_json:
        rows = _parsed(files).select("path", "name", _method(F.col("doc")).alias("method"), _texts(F.try_variant_get("doc", "$.segments", "array<variant>")).alias("segments"))
    else:
        rows = files.select("path", "name", F.lit("lines").alias("method"), text.lines("text").alias("segments"))
    empty = rows.where(F.coalesce(F.size("segments"), F.lit(-1)) <= 0).select("path").first()
    if empty is not None:
        raise ValueError(f"no segments in {empty['path']}")
    return rows


def read_story(spark: SparkSession, path: str) -> DataFrame:
    _require(spark, path)
    rows = _stories(whole_files(spark, path), path.lower().endswith(".json"))
    return rows.select(F.col("name").alias("story_name"), F.col("method").alias("story_seg_method"), F.posexplode("segments").alias("story_idx", "text"))


def _json_recalls(files: DataFrame) -> DataFrame:
    docs = _parsed(files)
    subjects = F.try_variant_get("doc", "$.recalls", "map<string,variant>")
    rows = docs.select("path", _method(F.col("doc")).alias("method"), subjects.alias("subjects"))
    if rows.where(F.coalesce(F.size("subjects"), F.lit(-1)) <= 0).count():
        raise ValueError("recalls must be an object of subjects")
    return rows.select("path", "method", F.explode("subjects").alias("sub_id", "value")).select("path", "method", "sub_id", _texts(F.try_variant_get("value", "$", "array<variant>")).alias("segments"))


def _checked(rows: DataFrame) -> DataFrame:
    """recall, from path, method, sub_id, segments; subjects must be unique and not empty."""
    empty = rows.where(F.coalesce(F.size("segments"), F.lit(-1)) <= 0).select("sub_id").first()
    if empty is not None:
        raise ValueError(f"no segments for {empty['sub_id']}")
    twice = rows.groupBy("sub_id").count().where("count > 1").select("sub_id").first()
    if twice is not None:
        raise ValueError(f"Duplicate subject {twice['sub_id']}")
    methods = rows.agg(F.min_by("method", "path").alias("method"), F.countDistinct("method").alias("n")).first()
    if methods["n"] > 1:
        log.warning("segmentation methods differ between files; %s is used", methods["method"])
    return rows.select("sub_id", F.lit(methods["method"]).alias("recall_seg_method"), F.posexplode("segments").alias("recall_idx", "text"))


#: JSON documents of more bytes are read in parallel, by splits; the rows are the same.
SPLIT_OVER = 32 << 20


def _largest(spark: SparkSession, paths: list[str]) -> int:
    return max((int(fs.getFileStatus(p).getLen()) for fs, p in (_fs(spark, x) for x in paths)), default=0)


def read_recalls(spark: SparkSession, path: str, split_over: int = SPLIT_OVER) -> DataFrame:
    """Recalls of one .json or text file, or of a folder of either kind, not both."""
    from .json_splits import read_split_recalls

    if _require(spark, path) == "file":
        if path.lower().endswith(".json") and _largest(spark, [path]) > split_over:
            return read_split_recalls(spark, path)
        files = whole_files(spark, path)
        if path.lower().endswith(".json"):
            return _checked(_json_recalls(files))
        return _checked(files.select("path", F.lit("lines").alias("method"), F.col("name").alias("sub_id"), text.lines("text").alias("segments")))
    files = list_files(spark, path)
    of = lambda suffix: [f for f in files if f.endswith(suffix)]
    if of(".json") and of(".txt"):
        raise ValueError(f"both .json and .txt files in {path}")
    if of(".json") and _largest(spark, of(".json")) > split_over:
        return read_split_recalls(spark, of(".json"))
    if of(".json"):
        return _checked(_json_recalls(whole_files(spark, of(".json"))))
    if of(".txt"):
        return _checked(whole_files(spark, of(".txt")).select("path", F.lit("lines").alias("method"), F.col("name").alias("sub_id"), text.lines("text").alias("segments")))
    raise ValueError(f"no .json or .txt files in {path}")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """story_name of each story of a dataset.json."""
    return spark.read.schema("stories array<string>").json(path, multiLine=True).select(F.explode("stories").alias("story_name"))


RATINGS = "n_story_segments int, ratings map<string,array<array<string>>>"


def _ratings(files: DataFrame) -> DataFrame:
    """path, sub_id, recall_idx, story_idxs, n_story. Documents are parsed from their text: Spark's reader of JSON files goes back to the file for each list that is kept as text."""
    rows = files.select("path", F.from_json(F.regexp_replace("text", "^\ufeff", ""), RATINGS).alias("doc")).select("path", "doc.*")
    pairs = rows.select("path", "n_story_segments", F.explode("ratings").alias("sub_id", "pairs")).select("path", "n_story_segments", "sub_id", F.explode("pairs").alias("pair"))
    return pairs.select("path", "sub_id", F.col("pair")[0].cast("int").alias("recall_idx"), F.from_json(F.col("pair")[1], "array<bigint>").alias("story_idxs"), F.col("n_story_segments").alias("n_story"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """sub_id, recall_idx, story_idxs, n_story, from a file of human matches."""
    return _ratings(whole_files(spark, path)).drop("path")


def _found(spark: SparkSession, pattern: str):
    fs, p = _fs(spark, pattern)
    return fs.globStatus(p) or []


def read_benchmark(spark: SparkSession, root: str, testset: str, files: tuple[str, str, str], split_over: int = SPLIT_OVER) -> dict[str, DataFrame]:
    """story, recall (only of rated subjects) and ratings of all stories that dataset.json lists, with story_name: one scan for each, whatever the number of stories. Recalls above split_over bytes are read by splits."""
    from .json_splits import read_split_documents

    top = f"{str(root).rstrip('/')}/{testset}"
    listed = read_dataset(spark, f"{top}/dataset.json").distinct()
    own = F.element_at(F.split("path", "/"), -3).alias("story_name")
    docs = lambda part, name: whole_files(spark, f"{top}/*/{part}/{name}").join(listed.withColumnRenamed("story_name", "_listed"), own == F.col("_listed"), "left_semi")
    found = docs("transcripts", files[0])
    missing = listed.join(found.select(own), "story_name", "left_anti").first()
    if missing is not None:
        raise FileNotFoundError(f"{top}/{missing['story_name']}/transcripts/{files[0]}")
    story = _stories(found, files[0].lower().endswith(".json")).select(own, F.col("method").alias("story_seg_method"), F.posexplode("segments").alias("story_idx", "text"))
    ratings = _ratings(docs("matches", files[2])).select(own, "*").drop("path")
    rated = ratings.select("story_name", "sub_id").distinct()
    recalls = _found(spark, f"{top}/*/recalls/{files[1]}")
    if any(x.getLen() > split_over for x in recalls):
        names = {r["story_name"] for r in listed.collect()}
        paths = [re.sub(r"([{}\[\]*?\\])", r"\\\1", str(x.getPath())) for x in recalls if x.getPath().getParent().getParent().getName() in names]
        rows = read_split_documents(spark, paths).select(own, "*").join(rated, ["story_name", "sub_id"], "left_semi")
        return {"story": story, "recall": rows.select("story_name", "sub_id", F.col("method").alias("recall_seg_method"), "recall_idx", "text"), "ratings": ratings}
    lists = _json_recalls(docs("recalls", files[1])).select(own, "*")
    empty = lists.where(F.coalesce(F.size("segments"), F.lit(-1)) <= 0).select("story_name", "sub_id").first()
    if empty is not None:
        raise ValueError(f"no segments for {empty['sub_id']} of {empty['story_name']}")
    recall = lists.join(rated, ["story_name", "sub_id"], "left_semi").select("story_name", "sub_id", F.col("method").alias("recall_seg_method"), F.posexplode("segments").alias("recall_idx", "text"))
    return {"story": story, "recall": recall, "ratings": ratings}


def read_benchmark_story(spark: SparkSession, root: str, testset: str, story: str, files: tuple[str, str, str]) -> dict[str, DataFrame]:
    """story, recall (only of rated subjects) and ratings; files: names of the transcript, recalls and matches."""
    top = f"{root}/{testset}/{story}"
    ratings = read_ratings(spark, f"{top}/matches/{files[2]}")
    recall = read_recalls(spark, f"{top}/recalls/{files[1]}").join(ratings.select("sub_id").distinct(), "sub_id", "left_semi")
    return {"story": read_story(spark, f"{top}/transcripts/{files[0]}"), "recall": recall, "ratings": ratings}


def read_csv(spark: SparkSession, path: str, schema: str = "segment int, events string, text string") -> DataFrame:
    """A CSV file with a header; codes stay text."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_excel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The named columns of spreadsheets, cast; see sheets.read_sheets for cells with their kinds."""
    from .sheets import read_sheets, sheet_columns

    return sheet_columns(read_sheets(spark, path), schema).drop("path", "sheet", "row")


def union_recalls(parts: list[DataFrame]) -> DataFrame:
    """All recalls; a subject in two parts is an error."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    seen = None
    for k, p in enumerate(parts):
        own = p.select("sub_id").distinct().withColumn("part", F.lit(k))
        seen = own if seen is None else seen.unionByName(own)
    twice = seen.groupBy("sub_id").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"Duplicate subject {twice['sub_id']}")
    return every
