"""Texts of unknown encoding: found by the likelihood of their byte pairs under each encoding, and decoded.

Files that are valid UTF-8 say what they are, and teach what the rest is likely to hold: the pairs of neighbouring
characters, one of them beyond ASCII, are counted on the executors, and a bounded number of the most frequent
is kept. For each single-byte encoding these give a table of 65,536 log-likelihoods of byte pairs; the encoding
with the greatest sum over a file's pairs is its own. Marks of order, and zeros in every other byte, tell UTF-16.
"""

from __future__ import annotations

import codecs
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Single-byte encodings, by the names that their standard gives and Python's; the first where nothing speaks for another.
SINGLE = {"windows-1252": "cp1252", "macintosh": "mac_roman", "IBM850": "cp850", "windows-1250": "cp1250"}
MOST_PAIRS = 1 << 16
MOST_BYTES = 1 << 20
_UNSEEN = 1e-4


def _pairs(batches):
    """Counts of pairs of neighbours of which one is beyond ASCII, of the texts that are valid UTF-8; told when many are held."""
    held: Counter[int] = Counter()

    def told():
        rows = pa.record_batch([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["pair", "n"])
        held.clear()
        return rows

    for b in batches:
        for x in b.column(0):
            raw = x.as_py() or b""
            if raw.isascii():
                continue
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            a, z = codes[:-1], codes[1:]
            some = (a > 127) | (z > 127)
            pair, n = np.unique(a[some] << 32 | z[some], return_counts=True)
            held.update(dict(zip(pair.tolist(), n.tolist(), strict=True)))
            if len(held) > MOST_PAIRS:
                yield told()
    yield told()


def learn(files: DataFrame, content: str = "content", most: int = MOST_PAIRS) -> dict[str, np.ndarray]:
    """Log-likelihoods of byte pairs (first byte x 256 + second) for each single-byte encoding, from the files that are valid UTF-8."""
    counted = files.select(content).mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "pair").limit(most).toArrow()  # bounded
    seen = list(zip(top["pair"].to_pylist(), top["n"].to_pylist(), strict=True))
    total = sum(n for _, n in seen) + 1
    alone: Counter[int] = Counter()  # characters beyond ASCII, whatever their neighbours
    for pair, n in seen:
        for c in (pair >> 32, pair & 0xFFFFFFFF):
            alone[c] += n * (c > 127)
    every = sum(alone.values()) or 1
    out = {}
    for name, codec in SINGLE.items():
        to_byte = {}
        for k in range(256):
            try:
                to_byte[ord(bytes([k]).decode(codec))] = k
            except UnicodeDecodeError:
                continue
        table = np.full((256, 256), _UNSEEN)
        for c, n in alone.items():  # a pair that was not met is as likely as its characters are
            if c in to_byte:
                table[to_byte[c]] += n / every
                table[:, to_byte[c]] += n / every
        table = table.reshape(-1)
        for pair, n in seen:
            a, z = to_byte.get(pair >> 32), to_byte.get(pair & 0xFFFFFFFF)
            if a is not None and z is not None:
                table[a * 256 + z] += n
        table = np.log(table / total)
        known = np.zeros(256, bool)
        known[list(to_byte.values())] = True
        table.reshape(256, 256)[:, ~known] = -1e6  # no character of this encoding
        out[name] = table
    return out


def encoding_of(raw: bytes, model: dict[str, np.ndarray]) -> str:
    if raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "UTF-16"
    if len(raw) >= 4 and len(raw) % 2 == 0:
        zeros = np.frombuffer(raw[:MOST_BYTES], np.uint8) == 0
        for at, name in ((1, "UTF-16LE"), (0, "UTF-16BE")):
            if zeros[at::2].mean() > 0.6 and zeros[1 - at :: 2].mean() < 0.1:
                return name
    if raw.isascii():
        return "US-ASCII"
    try:
        raw.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    codes = np.frombuffer(raw, np.uint8).astype(np.int64)
    a, z = np.r_[32, codes], np.r_[codes, 32]  # ends count as spaces
    some = (a > 127) | (z > 127)
    pairs = np.bincount(a[some] * 256 + z[some], minlength=65_536)
    scores = {name: float(pairs @ table) for name, table in model.items()}
    return max(scores, key=scores.get)


def _python_name(name: str) -> str:
    return SINGLE.get(name, "utf-8-sig" if name == "UTF-8" else name)


def decoded(files: DataFrame, model: dict[str, np.ndarray], content: str = "content") -> DataFrame:
    """files with encoding and text instead of their bytes; null bytes have neither. What an encoding has no character for becomes U+FFFD."""
    shared = files.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("encoding", pa.string()), ("text", pa.string())])

    def run(values: pa.Array) -> pa.Array:
        out = []
        for x in values:
            raw = x.as_py()
            name = None if raw is None else encoding_of(raw, shared.value)
            out.append(None if name is None else {"encoding": name, "text": raw.decode(_python_name(name), "replace")})
        return pa.array(out, kind)

    found = F.arrow_udf(run, "struct<encoding:string,text:string>")
    rows = files.withColumn("_found", found(content))
    return rows.select(*(c for c in files.columns if c != content), F.col("_found.encoding").alias("encoding"), F.col("_found.text").alias("text"))


def read_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, encoding, text of files of unknown encodings: two scans."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return decoded(files, learn(files))
