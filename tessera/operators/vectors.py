"""Matches between segments by their vectors: signatures of random hyperplanes in bands, then exact cosines; or all pairs, block by block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import stash

BITS = 12
MISS = 1e-3
MOST_BUCKET = 4096
BLOCK = 2048
SLICE = 256


def bands_for(least: float, bits: int = BITS, miss: float = MISS) -> int:
    """So many bands that a pair whose cosine is `least` shares none of them with a probability of at most `miss`."""
    if not (-1 < least <= 1 and bits in range(1, 32) and 0 < miss < 1):
        raise ValueError("least is a cosine above -1, bits are 1 to 31, miss is a probability")
    same = (1 - math.acos(least) / math.pi) ** bits  # all planes of a band have both vectors on one side
    return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))


def _buckets(bits: int, bands: int, seed: int):
    """A vector's bucket in each band: the sides of its planes as bits. Vectors of one length have the same planes in every task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        planes: dict[int, np.ndarray] = {}
        for vectors in batches:
            lengths = np.diff(np.asarray(vectors.offsets))
            flat, starts = np.asarray(vectors.values, dtype=np.float64), np.asarray(vectors.offsets)[:-1]
            out = np.zeros((len(vectors), bands), np.int32)
            for width in np.unique(lengths):
                if width not in planes:
                    planes[width] = np.random.default_rng([seed, int(width)]).standard_normal((int(width), bands * bits))
                at = np.flatnonzero(lengths == width)
                for some in np.array_split(at, -(-len(at) * bands * bits // 2**22)):  # 32 MB of products at most, but for one row
                    sides = flat[starts[some][:, None] + np.arange(width)] @ planes[width] > 0
                    out[some] = sides.reshape(len(some), bands, bits) @ (1 << np.arange(bits, dtype=np.int32))
            yield pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * bands, out.ravel())

    return F.arrow_udf(run, "array<int>")


def directed(df: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """keys, the vectors and norm. Vectors that have no direction go: null, empty or zero ones, and those with a null, NaN or infinite number."""
    norm = F.sqrt(F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))  # null if a number is
    known = df.select(*keys, F.col(column).alias("vector"), norm.alias("norm"))
    return known.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))  # NaN is above all numbers


def units(df: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """keys, unit: vectors with a direction at length 1, in doubles."""
    return directed(df, keys, column).select(*keys, F.transform(F.col("vector").cast("array<double>"), lambda x: x / F.col("norm")).alias("unit"))


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first number to the last, as SQL engines sum."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def _join_blocks(names: list[str], least: float):
    """All pairs of a block of the left and one of the right, a slice of rows at a time."""

    def matrices(side: pa.Table):
        vectors = side["_vector"].combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        starts = np.asarray(vectors.offsets)
        flat, lengths = np.asarray(vectors.values).astype(np.float64), np.diff(starts)
        return {int(n): (at, flat[starts[:-1][at][:, None] + np.arange(n)]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ours, theirs = (matrices(t) if len(t) else {} for t in (left, right))
        for width in ours.keys() & theirs.keys():
            (i, x), (j, y) = ours[width], theirs[width]
            xx, yy = _sums(x, x), _sums(y, y)
            unit = (y / np.sqrt(yy)[:, None]).T
            for a in range(0, len(x), SLICE):
                near = x[a : a + SLICE] / np.sqrt(xx[a : a + SLICE])[:, None] @ unit >= least - 1e-9  # wider than the product's rounding
                p, q = np.nonzero(near)
                for k in range(0, len(p), 1 << 16):
                    u, v = p[k : k + (1 << 16)] + a, q[k : k + (1 << 16)]
                    score = np.clip(_sums(x[u], y[v]) / np.sqrt(xx[u] * yy[v]), -1, 1)
                    keep = score >= least
                    found.append((i[u[keep]], j[v[keep]], score[keep]))
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        own = [left[n].take(pa.array(i)) for n in names[:-1]]
        return pa.table([*own, right[names[-1]].take(pa.array(j)), pa.array(score)], names=[*names, "score"])

    return run


def all_pairs(lefts: DataFrame, rights: DataFrame, by: list[str], left_key: str, right_key: str, least: float, block: int) -> DataFrame:
    """by, left_key, right_key, score of all pairs of lefts and rights (see directed) with a cosine of at least `least`: none is missed.

    Each side of a value of `by` is dealt to blocks of about `block` rows by a hash of the row; a task joins one block of
    each by a matrix product, and counts the cosines of what comes near the bound once more from the vectors themselves.
    """
    sizes = lambda df, n: df.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    n_left, n_right = sizes(lefts, "_lefts"), sizes(rights, "_rights")
    blocks = n_left.join(n_right, by) if by else n_left.crossJoin(n_right)
    blocks = stash(blocks.where("_lefts > 0 and _rights > 0"))
    meet = lambda df: df.join(blocks, by) if by else df.crossJoin(F.broadcast(blocks))
    own = lambda key, n: F.pmod(F.xxhash64(key, "vector"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = meet(lefts).select(*by, left_key, F.col("vector").alias("_vector"), own(left_key, F.col("_lefts")).alias("_i"), every("_rights").alias("_j"))
    b = meet(rights).select(*by, right_key, F.col("vector").alias("_vector"), every("_lefts").alias("_i"), own(right_key, F.col("_rights")).alias("_j"))
    place, names = [*by, "_i", "_j"], [*by, left_key, right_key]
    kinds = {**dict(lefts.dtypes), **dict(rights.dtypes)}
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in names] + ["score double"])
    return a.groupBy(*place).cogroup(b.groupBy(*place)).applyInArrow(_join_blocks(names, least), schema)


def vector_matches(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, column: str = "embedding", least: float = 0.8, by: tuple[str, ...] = (), bits: int = BITS, miss: float = MISS, most: int = MOST_BUCKET, seed: int = 0, block: int = BLOCK
) -> DataFrame:
    """by, left_key, right_key, score: pairs, equal in the columns `by`, whose cosine is at least `least`; each one is missed with a probability of at most `miss`.

    Pairs meet that share a bucket of a band. More bits make buckets smaller and bands more: about log2 of the
    rows is right. A bucket with more than `most` rows on the left is dealt to several keys, and the
    right's rows of it are sent to each: nothing is capped. Cosines are counted from the whole vectors.
    A `miss` of 0 compares all pairs instead, by blocks of `block` rows a side: the thing to do where so low a bound
    leaves most pairs in a bucket of some band.
    Vectors without a direction (see units), vectors of different lengths and rows with a null in `by` match nothing;
    of rows with equal keys the best score counts. No row on either side gives no row.
    """
    if left_key == right_key or {left_key, right_key} & set(by):
        raise ValueError("the keys of both sides and the columns they share have names of their own")
    if miss == 0:
        kept = lambda df, key: directed(df, [*by, key], column).drop("norm")
        return _best(all_pairs(kept(left, left_key), kept(right, right_key), list(by), left_key, right_key, least, block), by, left_key, right_key)
    sides = bands_for(least, bits, miss)
    lefts, rights = (stash(units(df, [*by, key], column)) for df, key in ((left, left_key), (right, right_key)))
    signed = lambda df, key: df.select(*by, key, F.posexplode(_buckets(bits, sides, seed)("unit")).alias("_band", "_bucket"))
    a, b, place = signed(lefts, left_key), signed(rights, right_key), [*by, "_band", "_bucket"]
    crowded = stash(a.groupBy(*place).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    a = a.join(crowded, place, "left").select(*place, left_key, F.pmod(F.xxhash64(left_key), parts).cast("int").alias("_part"))
    b = b.join(crowded, place, "left").select(*place, right_key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    pairs = a.join(b, [*place, "_part"]).select(*by, left_key, right_key).distinct()
    met = pairs.join(lefts, [*by, left_key]).join(rights.withColumnRenamed("unit", "_other"), [*by, right_key]).where(F.size("unit") == F.size("_other"))
    score = F.aggregate(F.zip_with("unit", "_other", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = met.select(*by, left_key, right_key, F.least(score, F.lit(1.0)).alias("score")).where(F.col("score") >= least)
    return _best(scored, by, left_key, right_key)


def _best(scored: DataFrame, by, left_key: str, right_key: str) -> DataFrame:
    return scored.groupBy(*by, left_key, right_key).agg(F.max("score").alias("score"))


def best_matches(matches: DataFrame, keys: list[str], right_key: str) -> DataFrame:
    """keys, right_key, score: the match with the highest score of each; of equal ones the least right_key."""
    return matches.groupBy(*keys).agg(F.min_by(F.struct(right_key, "score"), F.struct(-F.col("score"), F.col(right_key))).alias("best")).select(*keys, f"best.{right_key}", "best.score")
