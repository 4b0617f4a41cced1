"""K-d tree sharding by distributed weighted medians.

A node of the tree holds the rows of some number of shards. It is split along its widest
metadata dimension (extent relative to the whole table's) where the weight on the left
meets the left half's share of shards, until every leaf is one shard. Dimensions are
the text's size and the language (by default: columns that copies have in common); a
dimension's key is its value followed by the text's checksum. The value is that of one row
of a text (the least), so equal texts are one point and stay together whatever their metadata.

Medians are found by refining histograms: one aggregation counts the bytes of at most BINS
ranges per node, the range that holds the median is cut again, until a boundary is within
TOLERANCE of the share. The driver sees nodes x BINS sums and never a row. A point that is
so heavy that a cut beside it misses the share by POINT_TOLERANCE of a shard (one text with
a third of all bytes) is split by a hash of doc_id.

Slots are dealt by a count per (shard, bucket) and a row number inside small buckets, so no
task numbers a whole shard.

Defined cases: null text has size 8 and checksum 0; null metadata is a value of its own;
rows without doc_id are left out; repeated rows share a point and are split only by slot.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

BINS = 1024
TOLERANCE = 0.002
POINT_TOLERANCE = 0.01
BUCKET_ROWS = 4096
DIMENSIONS = ("size", "lang")


@dataclass
class Node:
    """Rows of `shards` shards from `first` on; split into two once `dim` is set: left is (key, tie) < (cut, tie_cut)."""

    first: int
    shards: int
    dim: str = ""
    cut: int = 0
    tie_cut: int | None = None
    sides: list = field(default_factory=list)

    def leaf(self) -> Column:
        """The first shard of the node that a row has come to."""
        if not self.sides:
            return F.lit(self.first)
        key = F.col(self.dim)
        left = key < self.cut
        if self.tie_cut is not None:
            left = left | ((key == self.cut) & (F.col("tie") < self.tie_cut))
        return F.when(left, self.sides[0].leaf()).otherwise(self.sides[1].leaf())


@dataclass
class Search:
    """Where a node's weighted median is still looked for."""

    node: Node
    column: str
    lo: int
    hi: int
    before: int
    share: float
    slack: float
    point: int | None = None

    @property
    def width(self) -> int:
        return -(-(self.hi - self.lo + 1) // BINS)


def metadata(docs: DataFrame, dimensions: tuple = DIMENSIONS) -> DataFrame:
    """One small row per document: identity, size, checksum, a key per dimension, and what splits ties."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    code = lambda c: F.shiftrightunsigned(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\0")).cast("binary")), 2)
    values = [code(c).alias(f"d{i}") for i, c in enumerate(dimensions) if c != "size"]
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"), *values)
    if values:
        base = C.stash(base)
        own = base.columns[3:]
        base = base.drop(*own).join(base.groupBy("bytes", "text_crc32").agg(*(F.min(c).alias(c) for c in own)), ["bytes", "text_crc32"])
    size = F.least(F.col("bytes"), F.lit((1 << 30) - 1))
    keys = [(F.shiftleft(size if c == "size" else F.col(f"d{i}"), 32) + F.col("text_crc32")).alias(f"d{i}") for i, c in enumerate(dimensions)]
    return base.select("doc_id", "bytes", "text_crc32", *keys, F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("tie"))


def _nodes(root: Node) -> list[Node]:
    return [root] if not root.sides else [x for s in root.sides for x in _nodes(s)]


def _start(meta: DataFrame, root: Node, extent: dict) -> list[Search]:
    """The nodes to split next, each along its widest dimension; extent keeps the whole table's."""
    dims = [c for c in meta.columns if re.fullmatch(r"d\d+", c)]
    stats = meta.groupBy(root.leaf().alias("at")).agg(F.sum("bytes").alias("weight"), *(f(c).alias(f"{n}_{c}") for c in dims for f, n in ((F.min, "lo"), (F.max, "hi"))))
    rows = {r["at"]: r for r in stats.collect()}  # a row per node
    out = []
    for node in _nodes(root):
        if node.shards < 2:
            continue
        r = rows.get(node.first)
        if r is None:  # no rows: any cut will do
            node.dim, node.cut = dims[0], 0
            _split(node)
            continue
        spread = {c: r[f"hi_{c}"] - r[f"lo_{c}"] + 1 for c in dims}
        if not extent:
            extent.update(spread)
        node.dim = max(dims, key=lambda c: (spread[c] / extent[c], -dims.index(c)))
        left = (node.shards + 1) // 2
        out.append(Search(node, node.dim, r[f"lo_{node.dim}"], r[f"hi_{node.dim}"], 0, r["weight"] * left / node.shards, TOLERANCE * r["weight"] / node.shards))
    return out


def _split(node: Node) -> None:
    left = (node.shards + 1) // 2
    node.sides = [Node(node.first, left), Node(node.first + left, node.shards - left)]


def _refine(meta: DataFrame, root: Node, searches: list[Search]) -> list[Search]:
    """One aggregation for all searches; those that go on. (Nodes are split once a level ends: rows are told apart by their node's first shard.)"""
    at = root.leaf()
    bins, inside = F.lit(None).cast("long"), F.lit(False)
    for s in searches:
        here = (at == s.node.first) & F.col(s.column).between(s.lo, s.hi)
        if s.point is not None:
            here = here & (F.col(s.node.dim) == s.point)
        bins = F.when(here, F.expr(f"({s.column} - {s.lo}L) div {s.width}L")).otherwise(bins)
        inside = inside | here
    sums: dict[int, list] = {}
    held = [F.sum("bytes").alias("bytes"), F.count("*").alias("rows")]
    for s in {s.column for s in searches}:
        held += [F.min(s).alias(f"lo_{s}"), F.max(s).alias(f"hi_{s}")]
    for r in meta.where(inside).groupBy(at.alias("at"), bins.alias("bin")).agg(*held).collect():  # BINS rows per node at most
        sums.setdefault(r["at"], []).append(r)
    left = []
    for s in searches:
        found = sorted(sums[s.node.first], key=lambda r: r["bin"])
        below, r = s.before, found[0]
        for r in found:
            if below + r["bytes"] >= s.share or r is found[-1]:
                break
            below += r["bytes"]
        lo, hi = r[f"lo_{s.column}"], r[f"hi_{s.column}"]
        off, off_after = abs(below - s.share), abs(below + r["bytes"] - s.share)
        near = s.slack * (POINT_TOLERANCE / TOLERANCE if TOLERANCE and lo == hi and s.point is None else 1)
        if min(off, off_after) <= near or r["rows"] == 1 or (lo == hi and s.point is not None):
            value = hi + 1 if off_after < off else lo
            s.node.cut, s.node.tie_cut = (value, None) if s.point is None else (s.point, value)
        elif lo == hi:  # one point is heavier than the tolerance
            left.append(Search(s.node, "tie", 0, (1 << 63) - 1, below, s.share, s.slack, point=lo))
        else:
            left.append(Search(s.node, s.column, lo, hi, below, s.share, s.slack, s.point))
    return left


def build(meta: DataFrame, shards: int) -> Node:
    root, extent = Node(0, shards), {}
    while any(n.shards > 1 for n in _nodes(root)):
        level = searches = _start(meta, root, extent)
        while searches:
            searches = _refine(meta, root, searches)
        for s in level:
            _split(s.node)
    return root


def kd_shards(docs: DataFrame, shards: int = 24, dimensions: tuple = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    meta = C.stash(metadata(docs, dimensions))
    placed = meta.select("doc_id", F.col("bytes").alias("size"), "text_crc32", build(meta, shards).leaf().cast("int").alias("shard"))
    buckets = max(1, -(-meta.count() // (shards * BUCKET_ROWS)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").count()
    offsets = counts.select("shard", "bucket", (F.sum("count").over(W.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("offset"))
    numbered = placed.withColumn("n", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")))
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
