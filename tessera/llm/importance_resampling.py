"""Resampling towards a target distribution by hashed n-gram importance, from a table of word positions.

Words are posexploded into a table of one row a position; lead() over the positions of a
document brings the following words beside each, so that a row holds the n-grams of every
order that start there. They are hashed to buckets and the table of buckets is written once.
Grouping it by bucket counts the documents' features; the same over the target's texts gives
the target's, and their log ratio is a bucket's gain. Joined back and summed, gains
weigh a document; Gumbel noise from a hash of its id turns weights into a draw without replacement.

Plain DataFrame operations throughout. The one exchange of texts is by (doc_id, hash of the text),
which the position window needs; the table's window and grouping stay inside its partitions.
The position table is bounded by the words of a partition and spills. Gains are one row a
bucket (a parameter), so they are broadcast. Ranks come from range partitions of the scores,
written with the number of their range, and the counts before each: no global window.

Defined cases: null, empty and wordless texts have no features and weight 0; texts beyond CHUNK
characters are cut between words first, so that no row holds an array of all their words; rows that share
a doc_id are documents of their own, and repeated rows are each returned, counted and drawn; rows without
doc_id are left out; other columns are ignored, whatever their names; null target texts count nothing;
without target texts all gains come from the documents alone; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ORDERS = 3
BUCKETS = 10_000
PERCENT = 5
MIN_WORDS = 20
SEED = 42
CHUNK = 1 << 20
PART_BYTES = 4 << 20
RANGE_ROWS = 1 << 17
_SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def positions(rows: DataFrame, parts: int, orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """id, h, copies and, for each position, the n-grams of each order that start there (n1, n2, .. or null), of rows (id, text).

    Every text has a row, that of its position 0 at least.
    """
    keyed = rows.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    once = keyed.repartition(parts, "id", "h").groupBy("id", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    pieces = F.when(F.length("text") > chunk, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk}}}[^{_SEPARATORS}]*+"), F.lit(0))).otherwise(F.array("text"))
    cut = once.select("id", "h", "copies", F.posexplode(pieces).alias("piece", "text"))
    words = cut.select("id", "h", "copies", "piece", F.posexplode(F.split(_folded(F.col("text")), f"[{_SEPARATORS}]+")).alias("pos", "w1"))
    words = words.where("w1 <> '' or (piece = 0 and pos = 0)")
    place = Window.partitionBy("id", "h").orderBy("piece", "pos")
    table = words.select("id", "h", "copies", F.when(F.col("w1") != "", F.col("w1")).alias("w1"), *(F.lead("w1", k).over(place).alias(f"w{k + 1}") for k in range(1, orders)))
    joined = lambda n: F.concat(*(x for k in range(1, n + 1) for x in (F.lit(" "), F.col(f"w{k}"))[k == 1 :]))
    return table.select("id", "h", "copies", *(joined(n).alias(f"n{n}") for n in range(1, orders + 1)))


def bucket_table(rows: DataFrame, parts: int, orders: int = ORDERS, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """id, h, copies and the buckets b1, b2, .. of the n-grams at each position."""
    grams = positions(rows, parts, orders, chunk)
    return grams.select("id", "h", "copies", *((F.crc32(F.col(f"n{n}").cast("binary")) % buckets).cast("int").alias(f"b{n}") for n in range(1, orders + 1)))


def _long(table: DataFrame, orders: int) -> DataFrame:
    return table.select("id", "h", "copies", F.explode(F.array(*(f"b{n}" for n in range(1, orders + 1)))).alias("bucket"))


def _counts(table: DataFrame, orders: int, name: str) -> DataFrame:
    return _long(table, orders).where("bucket is not null").groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(table: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket that a document has: floor(1000 ln of the smoothed target share over the smoothed share in the documents)."""
    own, wanted = C.stash(_counts(table, orders, "s")), C.stash(_counts(target, orders, "t"))  # `buckets` rows at most
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    s_all, t_all = total(own, "s"), total(wanted, "t")
    t = F.coalesce("t", F.lit(0))
    ratio = (t + 1).cast("double") * F.lit(float(s_all + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets)))
    return own.join(F.broadcast(wanted), "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, keys: list[str], most: int, count: int) -> DataFrame:
    """keys and rank of the `most` highest scores of `count` rows, ties by keys in their order."""
    order = [F.desc("score"), *keys]
    parts = max(1, -(-count // RANGE_ROWS))
    ranges = C.stash(rows.select("score", *keys).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    sizes = sorted((r["range"], r["n"]) for r in ranges.groupBy("range").agg(F.count("*").alias("n")).collect())  # one a range
    before, offsets = 0, {}
    for k, n in sizes:
        if before < most:
            offsets[k] = before
        before += n
    if not offsets:
        return rows.select(*keys, F.lit(0).cast("long").alias("rank")).limit(0)
    starts = rows.sparkSession.createDataFrame(list(offsets.items()), "range int, before long")
    numbered = ranges.join(F.broadcast(starts), "range").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return numbered.where(F.col("rank") <= most).select(*keys, F.col("rank").cast("long"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank (of the drawn) of every document; target has a column text."""
    ids = C.texts_of(docs).withColumnRenamed("doc_id", "id")
    table = C.stash(bucket_table(ids, C.parts_for(ids, PART_BYTES), orders, buckets, chunk))
    aim = target.select(F.lit(0).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    gain = gains(table, bucket_table(aim, C.parts_for(aim, PART_BYTES), orders, buckets, chunk), orders, buckets)
    summed = _long(table, orders).join(F.broadcast(gain), "bucket", "left").groupBy("id", "h").agg(F.max("copies").alias("copies"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = C.stash(summed.select(F.col("id").alias("doc_id"), "h", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")))
    enough = scored.where(F.col("n_features") >= least_features(min_words, orders))
    count = enough.count()
    ranks = ranked(enough, ["doc_id", "h", "copy"], percent * count // 100, count)
    return scored.join(ranks, ["doc_id", "h", "copy"], "left").select("doc_id", "n_features", "weight", "score", "rank")


def least_features(words: int, orders: int = ORDERS) -> int:
    """The features of a text of so many words: it has as many words exactly if it has as many features."""
    return sum(max(0, words - n + 1) for n in range(1, orders + 1))
