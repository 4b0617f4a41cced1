"""JSON documents made by the executors: many at once, each of any size, whole or not there.

A document is a head, and a list of items or an object of lists of items. Its rows become lines of
text in the order of a window over the document, so that no row, group or document is ever held whole:
the task that writes a document streams its sorted rows. Writing has two phases. Spark's text writer
puts all documents under a hidden folder beside their places, and its committer drops what failed or
repeated tasks leave; then the driver renames each file to its name, which replaces an older
document at once. If anything fails before, the hidden folder goes and the old documents stay. Only names pass
the driver. Any file system of Hadoop's will do.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import _fs


def quoted(value: Column) -> Column:
    """A JSON string; null for a null."""
    inside = F.to_json(F.array(value.cast("string")))
    return F.substring(inside, F.lit(2), F.char_length(inside) - 2)


def json_list(values: Column) -> Column:
    """A JSON list of numbers."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]"))


def lines(rows: DataFrame, document: Column, head: dict[str, Column], body: str, item: Column, order: list[str], subject: str | None = None) -> DataFrame:
    """document, line: the documents' text. head values and items are JSON; with a subject, the body is an object of the subjects' lists."""
    keys = [subject] if subject else []
    made = rows.select(document.alias("document"), *(v.alias(f"_head{k}") for k, v in enumerate(head.values())), item.alias("_item"), *keys, *order)
    place = W.partitionBy("document").orderBy(*keys, *order)
    first = F.lag("document").over(place).isNull()
    last = F.lead("document").over(place).isNull()
    opening = F.concat(F.lit("{\n"), *(F.concat(F.lit(f'"{name}": '), F.coalesce(F.col(f"_head{k}"), F.lit("null")), F.lit(",\n")) for k, name in enumerate(head)), F.lit(f'"{body}": {"{" if subject else "["}\n'))
    if subject:
        again = F.lag(subject).over(place).eqNullSafe(F.col(subject)) & ~first
        between = F.when(again, ", ").otherwise(F.concat(F.when(first, "").otherwise("],\n"), quoted(F.col(subject)), F.lit(": [")))
    else:
        between = F.when(first, "").otherwise(", ")
    closing = F.lit("]\n}\n}" if subject else "\n]\n}")
    return made.select("document", F.concat(F.when(first, opening).otherwise(""), between, "_item", F.when(last, closing).otherwise("")).alias("line"))


def write_documents(made: DataFrame, root: str, replace: bool = False, keep: str = "README") -> list[str]:
    """Write documents (document, line; in order) below root; their names. With replace, whatever else is in root goes at the commit, but for names that begin with `keep`."""
    spark, top = made.sparkSession, str(root).rstrip("/")
    jvm = spark._jvm
    fs, folder = _fs(spark, top)
    held = jvm.org.apache.hadoop.fs.Path(f"{top}/_writing-{uuid.uuid4().hex}")
    try:
        made.select("document", "line").write.partitionBy("document").text(str(held))
        files = {}
        for d in fs.listStatus(held):
            name = d.getPath().getName()
            if not name.startswith("document="):
                continue
            parts = [f.getPath() for f in fs.listStatus(d.getPath()) if not f.getPath().getName().startswith(("_", "."))]
            if len(parts) != 1:
                raise ValueError(f"{len(parts)} parts of {name}")
            files[unquote(name.removeprefix("document="))] = parts[0]
        if replace:
            for old in fs.listStatus(folder):
                if not old.getPath().getName().startswith((keep, "_writing-")):
                    fs.delete(old.getPath(), True)
        _commit(spark, top, files)
    finally:
        fs.delete(held, True)
    return sorted(files)


def _commit(spark: SparkSession, top: str, files: dict) -> None:
    """Rename each file to its document's name; an older document is replaced at once."""
    path, rename = spark._jvm.org.apache.hadoop.fs.Path, getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs, folder = _fs(spark, top)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(folder).toUri(), spark._jsc.hadoopConfiguration())
    known = set()
    for name, file in sorted(files.items()):
        target = fs.makeQualified(path(f"{top}/{name}"))
        parent = str(target.getParent())
        if parent not in known:
            fs.mkdirs(target.getParent())
            known.add(parent)
        context.rename(fs.makeQualified(file), target, how)
        if fs.getScheme() == "file":  # no checksum beside it: a document may be edited by hand
            fs.getRawFileSystem().delete(path(target.getParent(), f".{target.getName()}.crc"), False)
