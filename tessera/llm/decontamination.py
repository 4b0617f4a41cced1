"""Benchmark decontamination by winnowing.

A window is `span` (10) consecutive words of an item; an item of fewer words is one window.
Every run of k words is hashed and the minimum of each w = span - k + 1 neighbouring hashes
is a fingerprint, so two texts that share `span` words share a fingerprint. Training and
test fingerprints are joined, and each hit is extended by up to span - k words on either
side: the windows so reached are compared with the benchmark's distinct windows, word by
word (64-bit hashes). Items shorter than `span` words are one window each, met by the hash of
their whole word sequence. A window that many items share is compared once, and a frequent
one costs the same at each occurrence; which items hold it is looked up at the end.

A benchmark of at most BROADCAST_WORDS words is broadcast (a fixed bound), and the documents
are scanned once and never shuffled. A larger one stays distributed: its fingerprints are
broadcast as a bitmap of bounded size (at most MOST_BITS), the scan sends the windows around
the fingerprints that the bitmap has, and these meet the benchmark's windows in a join on two
independent 64-bit hashes. That is one scan too, whatever the benchmark's size.

Defined cases: null and wordless texts have no words and hit nothing; empty benchmarks flag
nothing; items without item_id are left out; equal items are all reported, an item_id once;
rows without doc_id are left out of the report, and judged where rows are filtered; repeated
rows are each returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 10
GRAM = 5
BROADCAST_WORDS = 2_000_000
MOST_BITS = 1 << 30
PAGE = 1 << 16
SEPARATORS = C.table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SECOND = C.U64(0xA24BAED4963EE407)
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(owner: np.ndarray, at: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the rightmost minimum of each `width` neighbouring hashes of one owner; of all, where an owner has fewer."""
    if not len(h):
        return np.zeros(0, np.int64)
    n = len(h)
    best = np.arange(n)
    for k in range(1, width):
        other = np.minimum(np.arange(n) + k, n - 1)
        other = np.where(owner[other] == owner, other, best)
        best = np.where(h[other] <= h[best], other, best)
    full = np.zeros(n, bool)
    full[: max(0, n - width + 1)] = owner[: max(0, n - width + 1)] == owner[width - 1 :]
    first = np.r_[True, owner[1:] != owner[:-1]]
    return np.unique(best[full | first])


def lexed(texts: list[bytes]) -> C.Lexed:
    return C.Lexed(texts, SEPARATORS, fold=True)


def fingerprints(lex: C.Lexed, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the winnowed runs of `gram` words."""
    at, h = lex.grams(gram)
    kept = winnow(lex.text[at], at, h, span - gram + 1)
    return at[kept], h[kept]


def item_windows(lex: C.Lexed, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of all windows of items."""
    size = np.diff(lex.first)
    n = np.maximum(size - span + 1, size > 0)
    return C.ranges(lex.first[:-1], n), np.repeat(np.minimum(size, span), n)


def around(lex: C.Lexed, at: np.ndarray, span: int, gram: int) -> np.ndarray:
    """First words of the windows that hold a run of `gram` words at `at`, inside its text."""
    start = np.unique((at[:, None] - np.arange(span - gram + 1)[None, :]).ravel())
    start = start[start >= 0]
    return start[(start + span <= len(lex.start)) & (lex.text[start] == lex.text[np.minimum(start + span, len(lex.start)) - 1])]


def position(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where h is in own, which is in order and distinct; -1 where it is not."""
    if not len(own):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    return np.where(own[at] == h, at, -1)


class Items:
    """A benchmark that fits into memory, ready to be joined."""

    def __init__(self, ids: list[str], texts: list[bytes], span: int, gram: int):
        lex = lexed(texts)
        self.ids, self.span, self.gram = ids, span, gram
        at, h = fingerprints(lex, span, gram)
        self.prints = np.unique(h[np.diff(lex.first)[lex.text[at]] >= span])
        start, size = item_windows(lex, span)
        sums = C.sequence_sums(lex.hash)
        self.windows = {}
        for m in np.unique(size).tolist():
            a = start[size == m]
            key, first, which = np.unique(C.sequence_hash(sums, a, a + m), return_index=True, return_inverse=True)
            words = lex.hash[a[first][:, None] + np.arange(m)]
            pair = np.unique(np.stack([which, lex.text[a]], 1), axis=0)  # window, item
            self.windows[m] = key, words, np.searchsorted(pair[:, 0], np.arange(len(key) + 1)), pair[:, 1]

    def find(self, texts: list[bytes]) -> tuple[C.Lexed, np.ndarray, np.ndarray, np.ndarray]:
        """The words of some documents, which of them are hit, and the (document, item) pairs found."""
        lex = lexed(texts)
        sums, edge, pairs = C.sequence_sums(lex.hash), np.zeros(len(lex.start) + 1, np.int64), []
        for m, (key, words, cut, items) in self.windows.items():
            if m == self.span:
                at, h = fingerprints(lex, self.span, self.gram)
                a = around(lex, at[position(self.prints, h) >= 0], self.span, self.gram)
                where = position(key, C.sequence_hash(sums, a, a + m))
            else:
                a, h = lex.grams(m)
                where = position(key, h)
            a, where = a[where >= 0], where[where >= 0]
            same = (lex.hash[a[:, None] + np.arange(m)] == words[where]).all(1)
            a, where = a[same], where[same]
            np.add.at(edge, a, 1)
            np.add.at(edge, a + m, -1)
            seen = np.unique(np.stack([lex.text[a], where], 1), axis=0)
            n = cut[seen[:, 1] + 1] - cut[seen[:, 1]]
            pairs.append(np.stack([np.repeat(seen[:, 0], n), items[C.ranges(cut[seen[:, 1]], n)]], 1))
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return lex, np.cumsum(edge[:-1]) > 0, found[:, 0], found[:, 1]


def _digest(names) -> tuple[int, str]:
    names = sorted(set(names))
    return len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def _scan(items):
    schema = C.arrow(_OUT)

    def run(batches):
        known = items.value
        for ids, texts in C.slices(batches):
            lex, hit, doc, item = known.find(texts)
            n_hit = np.bincount(lex.text[hit], minlength=len(texts))
            names = [[] for _ in texts]
            for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                names[d].append(known.ids[i])
            n_items, digest = zip(*map(_digest, names), strict=True)
            yield C.rows(schema, ids, np.diff(lex.first), n_hit, n_items, digest, n_hit > 0)

    return run


# A benchmark beyond one broadcast.


def _both(sums: tuple, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    return [C.sequence_hash(s, a, b).view(np.int64) for s in sums]


def _two_sums(lex: C.Lexed) -> tuple:
    return C.sequence_sums(lex.hash), C.sequence_sums(C.mix(lex.hash + _SECOND))


def _item_rows(span: int, gram: int):
    """Windows of items, and their fingerprints, with size 0."""
    schema = C.arrow("size int, h1 long, h2 long, item string")

    def run(batches):
        for b in batches:
            names, at = b.column(0).to_pylist(), 0
            number = pa.record_batch([pa.array(np.arange(len(names))), b.column(1)], ["id", "text"])
            for ids, texts in C.slices([number]):
                lex = lexed(texts)
                start, size = item_windows(lex, span)
                h1, h2 = _both(_two_sums(lex), start, start + size)
                own = [names[i] for i in ids[lex.text[start]].tolist()]
                yield C.rows(schema, size, h1, h2, own)
                at, h = fingerprints(lex, span, gram)
                h = h[np.diff(lex.first)[lex.text[at]] >= span].view(np.int64)
                yield C.rows(schema, np.zeros(len(h), int), h, h, [None] * len(h))

    return run


def _page(bits: int):
    def run(group):
        page = np.zeros(PAGE // 8, np.uint8)
        at = group["bit"].to_numpy() % PAGE
        np.bitwise_or.at(page, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"page": [group["page"][0].as_py()], "bits": [page.tobytes()]}, pa.schema([("page", pa.int64()), ("bits", pa.binary())]))

    return run


def _bitmap(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """Bits by hash, 16 for each distinct one at least, while most_bits allows: pages are made on the executors."""
    n = hashes.agg(F.approx_count_distinct("h1").alias("n")).first()["n"]
    bits = max(PAGE, min(most_bits, 1 << int(16 * n + 1).bit_length()))
    rows = hashes.select(F.expr(f"h1 & {bits - 1}L").alias("bit")).distinct().withColumn("page", F.expr(f"bit div {PAGE}L"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("page").applyInArrow(_page(bits), "page long, bits binary").toLocalIterator():  # bits / PAGE rows
        out[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & C.U64(8 * len(bitmap) - 1)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


_REACHED = "row long, doc_id long, n_words long, size int, start long, h1 long, h2 long"


def _reach(shared, sizes: list[int], span: int, gram: int):
    """A row for each document, and the windows that may be the benchmark's."""
    schema = C.arrow(_REACHED)

    def run(batches):
        prints, whole = shared.value
        for batch in batches:
            doc_ids, upto = batch.column(2), 0
            for rows, texts in C.slices([batch]):
                lex, n = lexed(texts), len(rows)
                ids = doc_ids.slice(upto, n)
                upto += n
                none = pa.nulls(n, pa.int64())
                yield pa.record_batch([pa.array(rows), ids, pa.array(np.diff(lex.first)), pa.nulls(n, pa.int32()), none, none, none], schema=schema)
                sums = _two_sums(lex)
                for m in sizes:
                    if m == span:
                        at, h = fingerprints(lex, span, gram)
                        a = around(lex, at[_has(prints, h)], span, gram)
                    else:
                        a, h = lex.grams(m)
                        a = a[_has(whole, h)]
                    h1, h2 = _both(sums, a, a + m)
                    own = lex.text[a]
                    yield pa.record_batch(
                        [pa.array(rows[own]), ids.take(pa.array(own)), pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), m, np.int32)), pa.array(a - lex.first[own]), pa.array(h1), pa.array(h2)], schema=schema
                    )

    return run


def _sum_up(batches):
    schema = C.arrow("row long, " + _OUT)
    for b in batches:
        out = [[] for _ in schema]
        for row, d, n, sizes, starts, items in zip(*(b.column(k).to_pylist() for k in ("row", "doc_id", "n_words", "sizes", "starts", "items")), strict=True):
            edge = np.zeros((n or 0) + 1, np.int64)
            np.add.at(edge, np.array(starts, np.int64), 1)
            np.add.at(edge, np.array(starts, np.int64) + np.array(sizes, np.int64), -1)
            n_hit = int((np.cumsum(edge[:-1]) > 0).sum())
            for col, v in zip(out, (row, d, n, n_hit, *_digest(x for some in items for x in some), n_hit > 0), strict=True):
                col.append(v)
        yield C.rows(schema, *out)


def _distributed(texts: DataFrame, items: DataFrame, span: int, gram: int, most_bits: int) -> DataFrame:
    """The report with the number of each row of texts (row, text, doc_id)."""
    spark = texts.sparkSession
    rows = C.stash(items.mapInArrow(_item_rows(span, gram), "size int, h1 long, h2 long, item string"))
    windows = rows.where("size > 0")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # `span` values at most
    bitmaps = [_bitmap(rows.where(x), most_bits) for x in ("size = 0", f"size between 1 and {span - 1}")]
    reached = C.stash(texts.mapInArrow(_reach(spark.sparkContext.broadcast(bitmaps), sizes, span, gram), _REACHED))
    held = windows.groupBy("size", "h1", "h2").agg(F.collect_set("item").alias("items"))
    hits = reached.where("size is not null").join(held, ["size", "h1", "h2"]).select("row", "size", "start", "items")
    by_row = hits.groupBy("row").agg(F.collect_list("size").alias("sizes"), F.collect_list("start").alias("starts"), F.collect_set("items").alias("items"))
    every = reached.where("size is null").select("row", "doc_id", "n_words").join(by_row, "row", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return every.select("row", "doc_id", "n_words", none("sizes", "array<int>"), none("starts", "array<long>"), none("items", "array<array<string>>")).mapInArrow(_sum_up, "row long, " + _OUT)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("id is not null")


def _small(items: DataFrame, broadcast_words: int, span: int, gram: int):
    """The broadcast benchmark, or None if it is larger than that."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0)).alias("n")).first()["n"]  # a word and what parts it are two bytes
    if size > broadcast_words:
        return None
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(Items([r["id"] for r in rows], [r["text"].encode() for r in rows], span, gram))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_words: int = BROADCAST_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    texts, items = C.texts_of(docs), _items(benchmark)
    small = _small(items, broadcast_words, span, gram)
    if small is not None:
        return texts.mapInArrow(_scan(small), _OUT)
    return _distributed(texts.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id"), items, span, gram, most_bits).drop("row")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_words: int = BROADCAST_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """docs without a hit, all columns; rows without doc_id are judged too."""
    items = _items(benchmark)
    small = _small(items, broadcast_words, span, gram)
    text = F.col("text").cast("string")
    if small is not None:
        return docs.where(~C.by_text("boolean", lambda texts: np.isin(np.arange(len(texts)), small.value.find(texts)[2]))(text))
    # a row goes if its text does: texts are told apart by 96 bits of hashes and their length
    identity: Column = F.struct(F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text))
    texts = docs.where("text is not null").select(F.xxhash64(text).alias("a"), F.crc32(text.cast("binary")).alias("b"), F.octet_length(text).alias("c"), text.alias("text"))
    numbered = C.stash(texts.select(F.monotonically_increasing_id().alias("row"), "text", F.lit(0).cast("long").alias("doc_id"), "a", "b", "c"))
    report = _distributed(numbered.select("row", "text", "doc_id"), items, span, gram, most_bits).where("contaminated").select("row")
    bad = numbered.join(report, "row").select(F.struct("a", "b", "c").alias("bad")).distinct()
    return docs.select(F.struct("*").alias("r"), F.when(text.isNotNull(), identity).alias("id")).join(bad, F.col("id") == F.col("bad"), "left_anti").select(*(F.col("r").getField(c).alias(c) for c in docs.columns))
