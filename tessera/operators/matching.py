"""Matches between segments: token overlap through an inverted index, attempts, match lists and cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.functions import codes, text

#: Items of at most so many words in all are broadcast. Counts that a task holds at once.
MOST_WORDS, MOST_COUNTS = 1 << 19, 1 << 22


def _overlaps(shared, least: float, schema: pa.Schema):
    """Rows (doc key, words) to (doc key, item key, overlap, score), by the items' words in a broadcast index."""

    def run(batches):
        words, first, n, item, sizes, keys = shared.value
        for b in batches:
            lists = b.column(1)
            place = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy()
            doc = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            doc, place = doc[place >= 0], place[place >= 0]
            step = max(1, MOST_COUNTS // max(1, len(item)))
            for a in range(0, len(b), step):
                x, y = np.searchsorted(doc, (a, a + step))
                times = n[place[x:y]]
                at = np.repeat(first[place[x:y]] - np.r_[0, np.cumsum(times)[:-1]] if x < y else times, times)
                held = np.repeat(doc[x:y] - a, times) * len(sizes) + item[at + np.arange(len(at))]
                overlap = np.bincount(held)
                cell = np.flatnonzero(overlap)
                d, i = cell // len(sizes), cell % len(sizes)
                score = overlap[cell] / sizes[i]
                kept = score >= least
                yield pa.record_batch([b.column(0).take(pa.array(d[kept] + a)), keys.take(pa.array(i[kept])), pa.array(overlap[cell][kept], pa.int64()), pa.array(score[kept])], schema=schema)

    return run


def _by_broadcast(docs: DataFrame, item_words: DataFrame, doc_key: str, item_key: str, least: float, column: str) -> DataFrame:
    """lexical_matches for items that fit a broadcast: one pass over the documents, of which nothing is exchanged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    items = item_words.where(F.col(item_key).isNotNull()).toArrow().combine_chunks()  # MOST_WORDS words at most
    rows = docs.where(F.col(doc_key).isNotNull()).select(doc_key, text.tokens(column).alias("doc_words"))
    schema = StructType([StructField(doc_key, docs.schema[doc_key].dataType), StructField(item_key, item_words.schema[item_key].dataType), StructField("overlap", LongType()), StructField("score", DoubleType())])
    one = lambda c: c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
    keys, lists = one(items[item_key]), one(items["item_words"])
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    words = pc.unique(flat)
    place = pc.index_in(flat, value_set=words).to_numpy()
    n = np.bincount(place, minlength=len(words)).astype(np.int64)
    item = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(place, kind="stable")]
    shared = docs.sparkSession.sparkContext.broadcast((words, np.cumsum(n) - n, n, item, sizes, keys))
    return rows.mapInArrow(_overlaps(shared, least, to_arrow_schema(schema)), schema)


def lexical_matches(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, least: float = 0.8, column: str = "text") -> DataFrame:
    """doc_key, item_key, overlap, score: pairs whose shared distinct words are at least `least` of the item's.

    Items of few words in all (MOST_WORDS) are broadcast, and each document counts the words it shares with each of
    them. Of more items only the rarest words of an item are indexed, so many that a match cannot avoid them all:
    frequent words never meet. The candidate pairs are then counted exactly.
    """
    from tessera.sources.shared import stash

    item_words = items.select(item_key, text.tokens(column).alias("item_words")).where(F.size("item_words") > 0)
    if (item_words.agg(F.sum(F.size("item_words").cast("long")).alias("n")).first()["n"] or 0) <= MOST_WORDS:
        return _by_broadcast(docs, item_words, doc_key, item_key, least, column)
    doc_words = stash(docs.select(doc_key, text.tokens(column).alias("doc_words")))  # texts are split once
    used = item_words.select(item_key, F.explode("item_words").alias("word"))
    # how often documents use the items' words decides which are rare
    frequency = doc_words.select(F.explode("doc_words").alias("word")).join(used.select("word").distinct(), "word", "left_semi").groupBy("word").count()
    rated = used.join(frequency, "word", "left").groupBy(item_key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word"))).alias("ranked"))
    needed = F.ceil(F.lit(least) * F.size("ranked") - 1e-9)
    index = rated.select(item_key, F.explode(F.slice("ranked", F.lit(1), (F.size("ranked") - needed + 1).cast("int"))["word"]).alias("word"))
    pairs = doc_words.select(doc_key, F.explode("doc_words").alias("word")).join(index, "word").select(doc_key, item_key).distinct()
    joined = pairs.join(doc_words, doc_key).join(item_words, item_key)
    overlap = F.size(F.array_intersect("doc_words", "item_words"))
    counted = joined.select(doc_key, item_key, overlap.cast("long").alias("overlap"), (overlap / F.size("item_words")).alias("score"))
    return counted.where(F.col("score") >= least)


ANCHOR = 8


def _holders(units: DataFrame, wanted: DataFrame, doc_key: str, item_key: str) -> DataFrame | None:
    """doc_key, item_key where a unit (doc_key, word) of the document holds the item's piece.

    Pieces and the distinct units meet on the piece's anchor, its first characters (ANCHOR at most, so that a
    unit costs a short string a character, however long it or the pieces are); what meets is then searched for the whole piece.
    """
    anchored = wanted.withColumn("anchor", F.substring("piece", 1, ANCHOR))
    lengths = sorted(r[0] for r in anchored.select(F.length("anchor")).distinct().collect())  # ANCHOR + 1 numbers at most
    if not lengths:
        return None
    of = lambda n: F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit(""))
    distinct = units.select("word").distinct().withColumn("unit", F.xxhash64("word"))
    # a unit's anchors travel with its hash, not with the unit
    places = distinct.select("unit", F.explode(F.array_distinct(F.concat(*map(of, lengths)))).alias("anchor"))
    met = places.join(anchored.select(item_key, "anchor"), "anchor").select("unit", item_key).distinct()
    found = met.join(distinct, "unit").join(wanted, item_key).where(F.contains("word", "piece")).select(item_key, "word")
    return units.join(found, "word").select(doc_key, item_key)


def containment(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, column: str = "text") -> DataFrame:
    """doc_key, item_key where the document holds the item verbatim.

    An item's inner words are whole words of the document, so documents and items meet on the
    item's longest inner word. The words of an item of one or two may be parts of the
    document's: its longer one is looked for in the distinct words of the documents. An item
    of white space alone is looked for in their distinct gaps. All joins are on equal keys.
    """
    clean = items.where(F.col(column).isNotNull()).select(item_key, F.col(column).alias("item_text"), text.words(column).alias("_words"))
    inner = F.slice("_words", 2, F.greatest(F.size("_words") - 2, F.lit(0)))
    longest = lambda ws: F.get(F.array_sort(F.transform(ws, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("word")))), F.lit(0))["word"]
    words = docs.select(doc_key, F.explode(F.array_distinct(text.words(column))).alias("word"))
    gaps = docs.where(F.col(column).isNotNull()).select(doc_key, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), text.gaps(column)))).alias("word"))
    pairs = words.join(clean.where(F.size("_words") > 2).select(item_key, longest(inner).alias("word")), "word").select(doc_key, item_key)
    for units, wanted in (
        (words, clean.where(F.size("_words").isin(1, 2)).select(item_key, longest(F.col("_words")).alias("piece"))),
        (gaps, clean.where(F.size("_words") == 0).select(item_key, F.col("item_text").alias("piece"))),
    ):
        more = _holders(units, wanted, doc_key, item_key)
        pairs = pairs if more is None else pairs.unionByName(more)
    met = pairs.distinct().join(docs.select(doc_key, F.col(column).alias("doc_text")), doc_key).join(clean.drop("_words"), item_key)
    return met.where(F.contains("doc_text", "item_text")).select(doc_key, item_key)


def parse_attempts(attempts: DataFrame, n_story) -> DataFrame:
    """attempts with parsed (numbers or NULL) and valid."""
    return attempts.withColumn("parsed", codes.parse_response("response")).withColumn("valid", codes.in_bounds("parsed", n_story))


def first_valid(attempts: DataFrame, keys: list[str], max_retries: int = 10) -> DataFrame:
    """keys, story_idxs (0-based, in order; empty when no attempt was valid) and attempts used."""
    used = attempts.where(F.col("attempt") < max_retries)
    valid = F.when(F.col("valid"), F.col("attempt"))
    return used.groupBy(*keys).agg(
        F.coalesce(F.min_by(codes.zero_based("parsed"), valid), F.array().cast("array<bigint>")).alias("story_idxs"),
        F.coalesce(F.min(valid) + 1, F.count("*")).cast("long").alias("n_attempts"),
        F.max(F.col("valid").cast("int")).alias("any_valid"),
    )


def to_cells(matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per matched (keys, story_idx); repeats are one."""
    return matches.select(*keys, F.explode("story_idxs").alias("story_idx")).dropDuplicates([*keys, "story_idx"])


def to_matches(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_set("story_idx")).alias("story_idxs"))


def dense(cells: DataFrame, dims: DataFrame, keys: list[str], rows: str = "n_story", columns: str = "n_recall") -> DataFrame:
    """All cells of the grid as 0 or 1. Cells outside the grid are an error. Only for small grids: scores need cells alone."""
    grid = dims.select(*keys, F.explode(F.when(F.col(rows) > 0, F.sequence(F.lit(0), F.col(rows) - 1))).alias("story_idx"), columns)
    grid = grid.select(*keys, "story_idx", F.explode(F.when(F.col(columns) > 0, F.sequence(F.lit(0), F.col(columns) - 1))).alias("recall_idx"))
    hit = cells.select(*keys, "recall_idx", "story_idx", F.lit(1).alias("hit")).dropDuplicates([*keys, "recall_idx", "story_idx"])
    joined = grid.withColumn("inside", F.lit(1)).join(hit, [*keys, "recall_idx", "story_idx"], "full_outer")
    value = F.when(F.col("inside").isNull(), F.raise_error(F.lit("a match is outside the matrix"))).otherwise(F.coalesce("hit", F.lit(0)))
    return joined.select(*keys, "story_idx", "recall_idx", value.cast("int").alias("value"))
