"""Ranked lexical search by sort-based accumulation, for a stated set of items against all documents.

The items' terms, met by 64-bit hash, are broadcast in blocks of a bounded number of (item, term)
pairs; items beyond one block are ranked block by block, each against all documents. One scan
writes the postings of a block's terms: for each slice of text its documents' lengths and the
terms they hold, packed. Counts of terms and documents are sums over these.

The packed slices are range-partitioned by document id, so that the work is spread evenly and
all of a document's impacts meet in one task. There the arrays (item, document, impact) of the
matched terms are concatenated, a bounded number at a time; keys packed of item and document are
ordered by a radix sort on 16-bit digits, np.add.reduceat sums the impacts of each key, and
a heap of k entries an item keeps the best. Its least entry is the bar for what comes after. Tasks hand on k rows
an item at most; a window over these gives the ranks.

Defined cases: null, empty and termless texts count in nothing and are never found; rows that share a doc_id are documents
of their own; equal scores come by doc_id; texts that share an item_id are one item, a repeated row of both counts once;
rows without doc_id or item_id are left out; items without terms have no rows; texts beyond a slice are lexed in
pieces cut between terms; other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TOP = 10
BLOCK_PAIRS = 1 << 19
EXPAND = 1 << 21
PART_BYTES = 4 << 20
SEPARATORS = C.table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_DIGIT = 16


def terms_of(texts: list[bytes], longest: int | None = None):
    """(text, hash) of all terms, in order of texts, a slice at a time: (index of the first text, of the texts, their numbers of terms, text of each term, hash).

    A term of more than `longest` bytes, which is a piece of its own, is counted without a hash.
    """
    a = 0
    while a < len(texts):
        z, size = a + 1, len(texts[a])
        while z < len(texts) and size + len(texts[z]) <= C.SLICE_BYTES:
            size += len(texts[z])
            z += 1
        counts, owners, hashes = np.zeros(z - a, np.int64), [], []
        for part in [texts[a:z]] if z > a + 1 else [[p] for p in C.pieces(texts[a], SEPARATORS)]:
            if longest is not None and len(part) == 1 and len(part[0]) > C.SLICE_BYTES + 1 and len(part[0]) > longest + 1:
                counts += 1  # one term
                continue
            lex = C.Lexed(part, SEPARATORS, fold=True)
            counts += np.bincount(lex.text, minlength=len(part)) if z > a + 1 else len(lex.text)
            owners.append(lex.text)
            hashes.append(lex.hash)
        yield a, counts, np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*hashes, np.zeros(0, C.U64)])
        a = z


def _item_terms(batches):
    """(row, term, times) of the items' texts."""
    for b in batches:
        for ids, texts in C.slices([b]):
            for a, _, owner, h in terms_of(texts):
                pair, times = np.unique(np.rec.fromarrays([owner, h], names="owner,h"), return_counts=True)
                yield C.rows(C.arrow("item long, term long, times long"), ids[a + pair.owner], pair.h.view(np.int64), times)


def _postings(vocabulary, longest: int):
    """For each slice its documents and terms, and packed: doc_id, terms, matched terms of the documents that hold one of the vocabulary; term and times of each match."""

    def run(batches):
        known = vocabulary.value
        for ids, texts in C.slices(batches):
            for a, counts, owner, h in terms_of(texts, longest):
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                key, tf = np.unique(owner[hit] << 32 | at[hit], return_counts=True)
                own, matched = np.unique(key >> 32, return_counts=True)
                blob = C.encode(ids[a + own].astype(np.int64).view(C.U64), counts[own], matched, key & 0xFFFFFFFF, tf) if len(own) else None
                yield C.rows(C.arrow("at long, docs long, terms long, blob binary"), [int(ids[a])], [int(np.count_nonzero(counts))], [int(counts.sum())], [blob])

    return run


def _frequencies(n_terms: int):
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for blob in C.blobs(b.column(0)):
                if blob is not None:
                    df += np.bincount(C.decode(blob)[3].astype(np.int64), minlength=n_terms)
        some = np.flatnonzero(df)
        yield C.rows(C.arrow("term long, df long"), some, df[some])

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, digit by digit from the lowest; digits that are in order already cost a look."""
    order = None
    top = int(keys.max()).bit_length() if len(keys) else 0
    for shift in range(0, top, _DIGIT):
        digit = (keys >> C.U64(shift)).astype(np.uint16)
        if order is not None:
            digit = digit[order]
        if np.all(digit[1:] >= digit[:-1]):
            continue
        step = np.argsort(digit, kind="stable")  # a radix sort for 16 bits
        order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


class Best:
    """The k best (score, document) of each item, equal scores by smaller document."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.bar = k, {}, np.ones(items, np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.bar[item]
        item, doc, score = item[keep], doc[keep], score[keep]
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        top = place < self.k
        for i, d, s in zip(item[top].tolist(), doc[top].tolist(), score[top].tolist(), strict=True):
            heap = self.heaps.setdefault(i, [])
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
            if len(heap) == self.k:
                self.bar[i] = heap[0][0]

    def rows(self):
        found = [(i, -d, s) for i, heap in self.heaps.items() for s, d in heap]
        return [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]


def accumulate(postings, lists, weights: np.ndarray, n_docs: int, n_terms: int, best: Best, expand: int = EXPAND) -> None:
    """Add the scores of the documents of one packed slice."""
    doc_id, n, matched, term, tf = (x.astype(np.int64) for x in postings)
    first, item, times = lists
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    doc = np.repeat(np.arange(len(doc_id)), matched)
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    size = first[term + 1] - first[term]
    ends = np.cumsum(np.bincount(doc, weights=size, minlength=len(doc_id)).astype(np.int64))
    d0 = done = 0
    last = np.cumsum(matched)
    while d0 < len(doc_id):
        d1 = min(max(d0 + 1, int(np.searchsorted(ends, done + expand, "right"))), d0 + (1 << _DIGIT))
        p = slice(last[d0 - 1] if d0 else 0, last[d1 - 1])
        at = C.ranges(first[term[p]], size[p])
        value = np.repeat(impact[p], size[p]) * times[at]
        key = item[at].astype(C.U64) << C.U64(_DIGIT) | np.repeat(doc[p] - d0, size[p]).astype(C.U64)
        order = radix_order(key)
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if len(start):
            key = key[start].astype(np.int64)
            best.add(key >> _DIGIT, doc_id[d0 + (key & 0xFFFF)], np.add.reduceat(value[order], start))
        done, d0 = int(ends[d1 - 1]), d1


def _ranking(shared, k: int):
    def run(batches):
        lists, weights, n_docs, n_terms, n_items = shared.value
        best = Best(n_items, k)
        for b in batches:
            for blob in C.blobs(b.column(0)):
                if blob is not None:
                    accumulate(C.decode(blob), lists, weights, n_docs, n_terms, best)
        yield C.rows(C.arrow("item long, doc_id long, score long"), *best.rows())

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_block(texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score: the best of each item of a block; pairs (item_id, term, times) are bounded."""
    spark = texts.sparkSession
    got = pairs.orderBy("item_id", "term").toArrow()
    ids = got["item_id"].combine_chunks().dictionary_encode()
    item = ids.indices.to_numpy().astype(np.int64)
    known, term = np.unique(got["term"].to_numpy().view(C.U64), return_inverse=True)
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(known) + 1))
    longest = int(got["longest"].to_numpy().max(initial=0))
    held = C.stash(texts.mapInArrow(_postings(spark.sparkContext.broadcast(known), longest), "at long, docs long, terms long, blob binary"))
    total = held.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("size")).first()
    df = np.zeros(len(known), np.int64)
    counted = held.select("blob").mapInArrow(_frequencies(len(known)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # the block's terms at most
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    weights = np.array([weight(total["docs"], int(x)) for x in df], np.int64)
    model = spark.sparkContext.broadcast(((first, item[order], got["times"].to_numpy()[order]), weights, total["docs"], max(1, total["terms"]), len(ids.dictionary)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["size"] // PART_BYTES)
    best = held.repartitionByRange(parts, "at").select("blob").mapInArrow(_ranking(model, k), "item long, doc_id long, score long")
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids.dictionary)), pa.int64()), "item_id": ids.dictionary}))
    return best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 for each item."""
    texts = C.texts_of(docs)
    asked = items.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    numbered = C.stash(asked.select("item_id", F.xxhash64("item_id", "text").alias("row"), "text"))
    found = numbered.select("row", "text").mapInArrow(_item_terms, "item long, term long, times long")
    sizes = numbered.select("item_id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).alias("longest"))
    pairs = C.stash(found.withColumnRenamed("item", "row").join(sizes, "row").groupBy("item_id", "term").agg(F.sum("times").alias("times"), F.max("longest").alias("longest")))
    blocks = max(1, -(-pairs.count() // block_pairs))
    out = None
    for n in range(blocks):
        part = _search_block(texts, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n), k)
        out = part if out is None else out.unionByName(part)
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
