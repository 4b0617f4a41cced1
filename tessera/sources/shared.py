"""Intermediate tables in the folder that all executors share: written once, read as plain tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Stashes of the blocks of scratch() that are open, the innermost last.
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder where all executors can read and write: below spark.checkpoint.dir."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch():
    """Stashes that are made inside the block are deleted at its end: write what is made of them inside it, and keep() what goes on."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            drop_stash(df)


def keep(df: DataFrame) -> DataFrame:
    """A stash that outlives the blocks it is made in."""
    out = stash(df)
    if _scratch:
        _scratch[-1].pop()
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stash that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
