"""Deleted interpolation of bigram, unigram and uniform estimates.

p(w | v) = L2 c(v w) / c(v) + L1 c(w) / N + L0 / (V + 1), with one set of weights L for each
bucket of the context's frequency c(v) (powers of two). A document's context starts as the
end token of the document before. Counts c, N and V come from all training documents; an
unseen context has no bigram estimate.

1. One scan counts words: distinct (word, count) per slice, then summed by word.
2. The most frequent words, at most HOT of them, are broadcast with their counts (a fixed
   bound). A second scan sends each slice's distinct bigrams once, with how often training documents
   of the slice have them: two hot words as a small number, any other two as a hash of 64 bits, packed in the
   order of these, to the part that has the range they are in; and its other words, to the part that counted them.
   Beside them goes the slice's table: its words, and its tokens as places among these.
3. A part adds up each bigram's occurrences, and answers each slice in the order in which it was asked, so
   that answers need no keys. Tables and answers meet by groups of slices: a row a slice in the shared
   folder, with the counts of its words and, for each token, of its bigram.
4. Expectation-maximisation on held-out counts: each training token is left out of the counts
   in turn (c(v w) - 1, c(v) - 1, c(w) - 1, N - 1). All training tokens are summed into cells of
   (bucket, size of the bigram estimate, size of the unigram estimate), at most a few ten
   thousand, on which the weights are fitted.
5. Each task adds log10 p of the tokens of its slices' documents. Nothing is exchanged any more.

What is exchanged grows with the tokens only: a bigram costs a record per slice that has it, however many
documents have it, and its answer a count.

Defined cases: null and empty texts are the end token alone; without training documents
N = V = 0 and p is the uniform's first weight; rows without doc_id are left out; repeated rows count and are returned
each time.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HOT = 1 << 18
FLUSH = 800_000
PART_BYTES = 4 << 20
RARE = C.U64(1 << 63)
END = C.U64(0x1D2C3B4A59687786)
BUCKETS = 40
CELLS = 96
COUNTS, TABLE, ASKED, ANSWER = range(4)
PAIR_BITS = 36
_ROUTED = "part int, kind int, blob binary"
_TOLD = "slices int, kind int, blob binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Encoded columns, compressed: counts, places and gaps of frequent things are short."""
    raw = C.encode(*columns)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", blob)
    return C.decode(pa.decompress(memoryview(blob)[8:], decompressed_size=size, codec="zstd", asbytes=True))


def _spread(parts: int, word: np.ndarray) -> np.ndarray:
    """The part that counts a word."""
    return C.part_of(word << C.U64(1), parts)


def _group(number: int, groups: int) -> int:
    """Slices are dealt by a hash: their numbers have a stride."""
    return int(C.part_of(C.mix(np.array([number], C.U64)), groups)[0])


def _scrambled(pair: np.ndarray) -> np.ndarray:
    """Numbers of PAIR_BITS bits, one to one, spread over their range."""
    half, mask = C.U64(PAIR_BITS // 2), C.U64((1 << PAIR_BITS) - 1)
    for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        pair = (pair * C.U64(odd)) & mask
        pair ^= pair >> half
    return pair


def _bigrams(code: np.ndarray, token: np.ndarray):
    """Of a slice's tokens, places in its words' codes: keys of the distinct bigrams, those of two hot words first, each kind in order; how many those are; each token's bigram."""
    before = np.r_[token[-1], token[:-1]]  # every document ends with the end token
    both, of = np.unique(before << 32 | token, return_inverse=True)
    a, b = code[both >> 32], code[both & 0xFFFFFFFF]
    rare = (a >= RARE) | (b >= RARE)
    key = np.where(rare, C.mix(C.mix(a) + b * C.U64(0x9E3779B97F4A7C15)), _scrambled(a << C.U64(PAIR_BITS // 2) | b))
    order = np.lexsort((key, rare))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return key[order], int((~rare).sum()), place[of]


class Slices:
    """Tokens of a scan slice: word hash (63 bits) and document, an end after each document's words."""

    def __init__(self):
        self.hash, self.doc, self.ids, self.train, self.n = [], [], [], [], 0

    def add(self, ids, train, texts):
        lex = C.Lexed(texts, fold=True)
        counts = np.diff(lex.first)
        at = np.insert(lex.hash >> C.U64(1), lex.first[1:], END)
        doc = np.repeat(np.arange(len(ids)) + sum(map(len, self.ids)), counts + 1)
        for x, y in zip((self.hash, self.doc, self.ids, self.train), (at, doc, ids, train), strict=True):
            x.append(y)
        self.n += len(at)

    def take(self):
        out = tuple(np.concatenate(x) for x in (self.hash, self.doc, self.ids, self.train))
        self.__init__()
        return out


def _slices(batches, size=FLUSH):
    some = Slices()
    for b in batches:
        train, at = b.column(2).to_numpy(zero_copy_only=False), 0
        for ids, texts in C.slices([b]):
            some.add(ids, train[at : at + len(ids)], texts)
            at += len(ids)
            if some.n >= size:
                yield some.take()
    if some.n:
        yield some.take()


def _count_words(parts: int):
    schema = C.arrow("part int, blob binary")

    def run(batches):
        for h, doc, _, train in _slices(batches):
            word, n = np.unique(h[train[doc]], return_counts=True)
            cut = np.searchsorted(_spread(parts, word), np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut))
            yield C.rows(schema, some, [_pack(C.deltas(word[cut[p] : cut[p + 1]]), n[cut[p] : cut[p + 1]]) for p in some])

    return run


def _add_words(part):
    words, n = zip(*((np.cumsum(w, dtype=C.U64), n.view(np.int64)) for w, n in map(_unpack, C.blobs(part["blob"]))), strict=True)
    word, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate(n)).astype(np.int64)
    levels = np.bincount(np.log2(total).astype(int), minlength=64)
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("levels", pa.list_(pa.int64())), ("blob", pa.binary())])
    return pa.table([[part["part"][0].as_py()], [int(total.sum())], [len(word)], [levels.tolist()], [_pack(C.deltas(word), total)]], schema=schema)


def _hot_words(least: int):
    schema = C.arrow("word long, n long")

    def run(batches):
        for b in batches:
            for blob in C.blobs(b.column(0)):
                w, n = _unpack(blob)
                some = n >= least
                yield C.rows(schema, np.cumsum(w, dtype=C.U64)[some].view(np.int64), n[some].view(np.int64))

    return run


def _scan(parts: int, hot):
    """Rows for the parts: what each slice asks them, and its table."""
    schema = C.arrow(_ROUTED)

    def run(batches):
        words, rank, _ = hot.value
        number = TaskContext.get().partitionId() << 24
        for h, doc, ids, train in _slices(batches):
            number += 1
            word, token = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(words, word), max(0, len(words) - 1))
            is_hot = words[at] == word if len(words) else np.zeros(len(word), bool)
            code = np.where(is_hot, rank[at], word | RARE) if len(words) else word | RARE
            order = np.argsort(code)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code, token = code[order], place[token]
            n_hot = int(is_hot.sum())
            rare = code[n_hot:] & ~RARE
            size = np.bincount(doc, minlength=len(ids))
            table = _pack(np.array([number]), ids.astype(np.int64).view(C.U64), size, train, C.deltas(code[:n_hot]), C.deltas(rare), token)
            put = [[_group(number, parts)], [TABLE], [table]]
            key, pairs, of = _bigrams(code, token)
            n = np.bincount(of, train[doc], len(key)).astype(np.int64)
            pair_part = (key[:pairs] * C.U64(parts) >> C.U64(PAIR_BITS)).astype(np.int64)
            of_pair, of_rare, of_word = (np.searchsorted(p, np.arange(parts + 1)) for p in (pair_part, C.part_of(key[pairs:], parts), _spread(parts, rare)))
            of_rare = of_rare + pairs
            for q in np.flatnonzero(np.diff(of_pair) + np.diff(of_rare) + np.diff(of_word)):
                p, r, w = (slice(c[q], c[q + 1]) for c in (of_pair, of_rare, of_word))
                put[0].append(int(q))
                put[1].append(ASKED)
                put[2].append(_pack(np.array([number]), C.deltas(key[p]), n[p], C.deltas(key[r]), n[r], C.deltas(rare[w])))
            yield C.rows(schema, *put)

    return run


def _lookup(words, counts, h):
    if not len(words):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, counts[at], 0)


def _answers(groups: int):
    """For each slice that asked a part: the slice, the part, training counts of the bigrams and of the words, in the order asked."""
    schema = C.arrow(_TOLD)

    def run(part):
        me, out, asked = part["part"][0].as_py(), [[], [], []], []
        own_words, own_counts = np.zeros(0, C.U64), np.zeros(0, np.int64)

        def put(number, kind, blob):
            for col, v in zip(out, (_group(number, groups), kind, blob), strict=True):
                col.append(v)

        for kind, blob in zip(part["kind"].to_pylist(), C.blobs(part["blob"]), strict=True):
            if kind == COUNTS:
                w, n = _unpack(blob)
                own_words, own_counts = np.cumsum(w, dtype=C.U64), n.view(np.int64)
            elif kind == TABLE:
                put(int(_unpack(blob)[0][0]), TABLE, bytes(blob))
            else:
                asked.append(_unpack(blob))
        totals = []
        for k in (1, 3) if asked else ():
            key, at = np.unique(np.concatenate([np.cumsum(b[k], dtype=C.U64) for b in asked]), return_inverse=True)
            n = np.bincount(at, np.concatenate([b[k + 1] for b in asked]), len(key)).astype(np.int64)
            totals.append(np.split(n[at], np.cumsum([len(b[k]) for b in asked])[:-1]))
        for b, pair, rare in zip(asked, *totals, strict=True) if asked else ():
            put(int(b[0][0]), ANSWER, _pack(np.array([b[0][0], me]), pair, rare, _lookup(own_words, own_counts, np.cumsum(b[5], dtype=C.U64))))
        return pa.Table.from_batches([C.rows(schema, *out)])

    return run


def _meet(hot):
    """A row a slice: its documents, their tokens as places among its words, the words' counts, and the count of each token's bigram."""
    schema = C.arrow("blob binary")

    def run(group):
        counts = hot.value[2]
        tables, answers, out = {}, {}, []
        for kind, blob in zip(group["kind"].to_pylist(), C.blobs(group["blob"]), strict=True):
            first, *more = _unpack(blob)
            if kind == TABLE:
                tables[int(first[0])] = more
            else:
                answers.setdefault(int(first[0]), []).append((int(first[1]), *more))
        for number in sorted(tables):
            ids, size, train, hot_words, rare, token = tables[number]
            hot_words, token = np.cumsum(hot_words, dtype=C.U64), token.view(np.int64)
            _, pair, other, word = zip(*sorted(answers.get(number, []), key=lambda x: x[0]), strict=True)
            n, word = np.concatenate([*pair, *other]), np.concatenate([counts[hot_words.astype(np.int64)].astype(C.U64), *word])
            key, _, of = _bigrams(np.r_[hot_words, np.cumsum(rare, dtype=C.U64) | RARE], token)
            if len(n) != len(key) or len(word) != len(hot_words) + len(rare):
                raise ValueError(f"slice {number}: answers for {len(n)} of {len(key)} bigrams, {len(word)} of {len(hot_words) + len(rare)} words")
            out.append(_pack(ids, size, train, token, word, n[of]))
        return pa.Table.from_batches([C.rows(schema, out)])

    return run


def _tokens(blob):
    """ids, size and training of a slice's documents; for each token its document, c(v w), c(v) and c(w)."""
    ids, size, train, token, word, n = (x.view(np.int64) for x in _unpack(blob))
    return ids, size, train > 0, np.repeat(np.arange(len(ids)), size), n, word[np.r_[token[-1], token[:-1]]], word[token]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _size_cell(p: np.ndarray) -> np.ndarray:
    """Half powers of two; the last cell is 0."""
    return np.where(p > 0, np.minimum((-2 * np.log2(np.maximum(p, 1e-300))).astype(np.int64), CELLS - 2), CELLS - 1)


def _held_out(total: int):
    schema = C.arrow("cell long, n double, p2 double, p1 double")

    def run(batches):
        size = BUCKETS * CELLS * CELLS
        sums = [np.zeros(size) for _ in range(3)]
        for b in batches:
            for blob in C.blobs(b.column(0)):
                _, _, train, doc, *counts = _tokens(blob)
                n, context, word = (x[train[doc]] - 1 for x in counts)
                p2 = np.where(context > 0, n / np.maximum(context, 1), 0.0)
                p1 = word / max(1, total - 1)
                cell = (bucket(context) * CELLS + _size_cell(p2)) * CELLS + _size_cell(p1)
                for s, w in zip(sums, (None, p2, p1), strict=True):
                    s += np.bincount(cell, w, size)
        some = np.flatnonzero(sums[0])
        yield C.rows(schema, some, *(s[some] for s in sums))

    return run


def fit_weights(cell, n, p2, p1, uniform: float, rounds: int = 100) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform by expectation-maximisation; p2, p1 are sums over n."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    if not len(n):
        return weights
    bins = cell // (CELLS * CELLS)
    p = np.stack([p2 / n, p1 / n, np.full(len(n), uniform)], 1)
    for _ in range(rounds):
        share = weights[bins] * p
        share *= (n / share.sum(1))[:, None]
        sums = np.stack([np.bincount(bins, share[:, k], BUCKETS) for k in range(3)], 1)
        # a little of the uniform keeps every probability above zero, whatever was held out
        sums += np.array([0.0, 0.005, 0.005]) * sums.sum(1, keepdims=True)
        seen = sums.sum(1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
    seen = np.flatnonzero(np.bincount(bins, minlength=BUCKETS))
    for b in range(1, BUCKETS):  # a bucket without held-out counts takes its neighbour's
        if len(seen) and b not in seen:
            weights[b] = weights[seen[np.argmin(abs(seen - b))]]
            if seen[np.argmin(abs(seen - b))] == 0:
                weights[b] = [0.1, 0.7, 0.2]
    return weights


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(weights: np.ndarray, total: int, distinct: int):
    schema = C.arrow(_SCORES)

    def run(batches):
        for b in batches:
            for blob in C.blobs(b.column(0)):
                ids, size, _, doc, n, context, word = _tokens(blob)
                w = weights[bucket(context)]
                p = w[:, 0] * n / np.maximum(context, 1) + w[:, 1] * word / max(1, total) + w[:, 2] / (distinct + 1)
                base = np.log10((word + 1) / (total + distinct + 1))
                sums = [np.bincount(doc, x, len(ids)) for x in (word > 0, base, np.log10(p))]
                yield C.rows(schema, ids, size, sums[0].astype(np.int64), *sums[1:])

    return run


def deleted_interpolation(docs: DataFrame, folds: int = 7, held_out: int = 2, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, parts = docs.sparkSession, C.parts_for(docs, PART_BYTES, C.MOST_TASKS)
    fold = C.fold_of(F.col("doc_id"), folds)
    texts = C.texts_of(docs).select("doc_id", "text", (fold != held_out).alias("train"))
    by_part = lambda df: df.repartition(parts, "part").groupBy("part")
    counted = C.stash(by_part(texts.mapInArrow(_count_words(parts), "part int, blob binary")).applyInArrow(_add_words, "part int, n long, v long, levels array<long>, blob binary"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"), *(F.sum(F.col("levels")[k]).alias(f"l{k}") for k in range(64))).first()
    total, distinct, have, least = sums["n"], sums["v"], 0, 1 << 62
    for k in reversed(range(63)):
        have += sums[f"l{k}"] or 0
        if have > min(hot, HOT):
            break
        least = 1 << k
    table = counted.select("blob").mapInArrow(_hot_words(least), "word long, n long").toArrow()  # at most `hot` rows
    words, n = table["word"].to_numpy().view(C.U64), table["n"].to_numpy()
    words, n = words[by_count := np.lexsort((words, -n))], n[by_count]
    order = np.argsort(words)
    shared = spark.sparkContext.broadcast((words[order], order.astype(C.U64), n))  # words, their ranks, counts by rank

    counts = counted.select("part", F.lit(COUNTS).alias("kind"), "blob")
    told = by_part(texts.mapInArrow(_scan(parts, shared), _ROUTED).unionByName(counts)).applyInArrow(_answers(parts), _TOLD)
    met = C.stash(told.repartition(parts, "slices").groupBy("slices").applyInArrow(_meet(shared), "blob binary"))

    cells = met.mapInArrow(_held_out(total), "cell long, n double, p2 double, p1 double")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("cell").toArrow()  # BUCKETS x CELLS x CELLS at most, a few thousand in use
    weights = fit_weights(*(cells[c].to_numpy() for c in ("cell", "n", "p2", "p1")), 1 / (distinct + 1))
    scores = met.mapInArrow(_score(weights, total, distinct), _SCORES)
    return scores.select("doc_id", (fold == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
