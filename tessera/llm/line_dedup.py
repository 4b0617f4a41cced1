"""Line dedup by a deletion-neighbourhood join.

Lines are what newlines divide; every line with a word is judged by its words. It is removed
when an earlier line (smaller doc_id, or the same document, earlier line) is within its
edit bound: one word inserted, deleted or replaced where both lines have NEAR_WORDS words or
more, none in shorter ones (one word in eight at most). All is judged on the input.

Two lines within one edit have their first or their last `half` words in common, so a
line's variants need to meet only other lines with the same half: a line travels twice, as
(half, the other words), 8 bytes a word; lines of fewer than NEAR_WORDS words travel once, as
two independent hashes of all their words. A part that finds two or more lines with a half
emits their deletion variants as hashed keys (the other words, and those without each one
word) and joins equal variants. Equal variants with the word deleted at the same position,
or a variant equal to a whole line, mean an edit distance of at most one; equal variants
deleted at different positions do not, and are told apart by the position. Each line so found
is compared with the one it was found by, half and words (64 bits each), at the position
of the edit; the earliest line of each verified group is kept.

Halves that very many different lines share would put them into one task. They are looked
for in a fixed share of the documents (this decides routes only, never results); for them,
the variants themselves travel, each to its own part, and a second independent hash of the
variant verifies them. Equal lines are settled inside a scan slice, so a line with a third of
all rows costs one record per slice.

Defined cases: null text has no lines; lines without words are kept; rows without doc_id are
left out; a document is a doc_id and a text: equal rows are one, rows that share a doc_id
and differ in text are documents of their own, in the order of their texts' checksums.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS = 1
NEAR_WORDS = 8
FLUSH_WORDS = 1_000_000
PART_BYTES = 4 << 20
AT_A_TIME = 200_000
SCOUT = 64
HOT_LINES = 24
MOST_HOT = 1 << 16
FULL = (1 << 32) - 1
HALVES, SHORT, VARIANTS, TOLD, LINES = range(5)
_ROUTED = "part int, kind int, blob binary"
_VERDICT = "doc_id long, text_crc32 long, n_lines long, removed binary"
_SECOND = C.U64(0xA24BAED4963EE407)


def halves(n: np.ndarray) -> np.ndarray:
    """Words at either end that lines of n words are met by: at most n // 2, in steps, so that few neighbours differ."""
    h = n // 2
    return np.where(h >= 8, h // 8 * 8, np.where(h >= 4, 4, 2))


class Docs:
    """Documents (doc_id, checksum of the text), by number; a larger number never stands for an earlier document."""

    def __init__(self, ids: np.ndarray, crc: np.ndarray):
        order = np.lexsort((crc, ids))
        new = np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(crc[order]) != 0)][: len(ids)]
        self.ids, self.crc = ids[order][new], crc[order][new]
        self.number = np.empty(len(ids), np.int64)
        self.number[order] = np.cumsum(new) - 1

    def part(self, parts: int) -> np.ndarray:
        return C.part_of_id(self.ids, parts)

    def pack(self, doc: np.ndarray, *columns) -> bytes:
        """Records of documents by number, with columns of their own."""
        some, at = np.unique(doc, return_inverse=True)
        return C.encode(C.deltas(self.ids[some]), self.crc[some], at, *columns)


def unpack(blobs: list) -> tuple[Docs, np.ndarray, list]:
    """(documents, number of each record's, the other columns); the column after the line number is one of differences."""
    ids, crc, at, rest, n = [], [], [], [], 0
    for b in blobs:
        i, c, k, line, *cols = C.decode(b)
        ids.append(np.cumsum(i).astype(np.int64))
        crc.append(c.astype(np.int64))
        at.append(k.astype(np.int64) + n)
        rest.append([line.astype(np.int64), *(np.cumsum(x, dtype=C.U64) for x in cols[:1]), *cols[1:]])
        n += len(i)
    docs = Docs(np.concatenate(ids), np.concatenate(crc))
    return docs, docs.number[np.concatenate(at)], [np.concatenate(x) for x in zip(*rest, strict=True)]


def _lines(lex: C.Lexed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, line number in its text) of all lines with a word."""
    newlines = np.flatnonzero(lex.buf == 10)
    at = np.searchsorted(newlines, lex.start)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (lex.text[1:] != lex.text[:-1])][: len(at)])
    base = np.searchsorted(newlines, lex.begin[:-1])
    return new, np.diff(np.r_[new, len(at)]), at[new] - base[lex.text[new]]


class Some:
    """Documents of a scan slice, and their judged lines: document, line, n words, and the words' hashes one after another."""

    def __init__(self, min_words: int):
        self.min_words = min_words
        self.docs, self.lines, self.words = [[], [], []], [[], [], [], []], 0

    def add(self, ids: np.ndarray, texts: list[bytes]) -> None:
        lex = C.Lexed(texts)
        first, n, line = _lines(lex)
        keep = n >= self.min_words
        own = lex.hash[np.repeat(keep, n)]
        counts = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
        before = sum(map(len, self.docs[0]))
        for x, y in zip((*self.docs, *self.lines), (ids, np.fromiter(map(zlib.crc32, texts), np.int64, len(texts)), counts, before + lex.text[first[keep]], line[keep], n[keep], own), strict=True):
            x.append(y)
        self.words += len(own)

    def take(self):
        """(documents, number of each row's, lines of each row), (document, line, n, words)."""
        ids, crc, counts = (np.concatenate(x) for x in self.docs)
        doc, line, n, words = (np.concatenate(x) for x in self.lines)
        docs = Docs(ids, crc)
        self.__init__(self.min_words)
        return (docs, docs.number, counts), (docs.number[doc], line.astype(np.int64), n.astype(np.int64), words)


def equal_but_one(words, a, n_a, cut_a, b, n_b, cut_b) -> np.ndarray:
    """Whether words[a:a + n_a] without the one at cut_a (FULL: whole) are words[b:b + n_b] without the one at cut_b, for each pair."""
    size, other = n_a - (cut_a != FULL), n_b - (cut_b != FULL)
    same = size == other
    k = C.ranges(np.zeros(len(size), np.int64), np.where(same, size, 0))
    pair = np.repeat(np.arange(len(size)), np.where(same, size, 0))
    x = words[a[pair] + k + (k >= cut_a[pair])]
    y = words[b[pair] + k + (k >= cut_b[pair])]
    same[pair[x != y]] = False
    return same


def distinct_lines(doc, line, n, words):
    """The first of equal lines, by place; and the places of later ones."""
    at = np.r_[0, np.cumsum(n)]
    full = C.sequence_hash(C.sequence_sums(words), at[:-1], at[1:])
    order = np.lexsort((line, doc, full))
    lead = np.r_[True, full[order][1:] != full[order][:-1]][: len(order)]
    leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    whole = np.full(len(order), FULL)
    same = np.ones(len(order), bool)
    again = ~lead
    x, y = order[again], leader[again]
    same[again] = equal_but_one(words, at[:-1][x], n[x], whole[again], at[:-1][y], n[y], whole[again])
    later = order[same & ((doc[order] != doc[leader]) | (line[order] != line[leader]))]
    keep = np.sort(order[lead | ~same])
    return (doc[keep], line[keep], n[keep], words[C.ranges(at[:-1][keep], n[keep])]), (doc[later], line[later])


def half_records(n: np.ndarray, words: np.ndarray, near: int):
    """(line, hash of half, first other word, other words) of each near line's records, twice or four times."""
    at = np.r_[0, np.cumsum(n)]
    sums = C.sequence_sums(words)
    out = [[], [], [], []]
    long = np.flatnonzero(n >= near)
    step = long[(halves(n[long]) != halves(n[long] - 1)) & (n[long] > near)]
    for which, m in ((long, halves(n[long])), (step, halves(n[step] - 1))):  # the second to meet lines of one word less
        a, b = at[which], at[which + 1]
        for k, (x, y, rest) in enumerate(((a, a + m, a + m), (b - m, b, a))):
            h = C.mix(C.sequence_hash(sums, x, y) + C.U64(k + 1) + (m.astype(C.U64) << C.U64(8)))
            for col, v in zip(out, (which, h, rest, n[which] - m), strict=True):
                col.append(v)
    return tuple(np.concatenate(x) for x in out)


def short_records(n: np.ndarray, words: np.ndarray, near: int):
    """(line, hash, second hash) of the lines that only equal ones meet."""
    at = np.r_[0, np.cumsum(n)]
    short = np.flatnonzero(n < near)
    out = [C.mix(C.sequence_hash(C.sequence_sums(w), at[short], at[short + 1]) + n[short].astype(C.U64)) for w in (words, C.mix(words + _SECOND))]
    return short, *out


def variants(half: np.ndarray, at: np.ndarray, n: np.ndarray, words: np.ndarray):
    """(record, key, position) of all variants of records (half, words[at:at + n]): whole, and without one word each."""
    flat = words[C.ranges(at, n)]
    start = np.r_[0, np.cumsum(n)][:-1]
    record = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(flat)) - start[record]
    _, down = C.powers(C._GRAM, len(flat) + 2)
    sums = C.sequence_sums(flat)
    # the words after the deleted one move up by one place: their sum is divided by the base
    a, i, b = start[record], np.arange(len(flat)), (start + n)[record]
    without = ((sums[i] - sums[a]) + (sums[b] - sums[i + 1]) * down[1]) * down[a]
    whole = (sums[start + n] - sums[start]) * down[start] if len(n) else np.zeros(0, C.U64)
    tag = C.mix(half)
    key = C.mix(np.r_[whole + tag, without + tag[record]])
    return np.r_[np.arange(len(n)), record], key, np.r_[np.full(len(n), FULL), pos]


def join_variants(key, pos, doc, line):
    """(variant, variant it is later than) of equal variants that mean one edit at most, with the earliest such."""
    none = np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    at = order[np.flatnonzero(np.r_[False, same] | np.r_[same, False])] if len(k) else order
    if not len(at):
        return none, none
    at = at[np.lexsort((line[at], doc[at], pos[at], key[at]))]
    k, p, d, x = key[at], pos[at], doc[at], line[at]
    group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
    sub = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
    lead = sub[np.searchsorted(sub, np.arange(len(at)), side="right") - 1]
    later = lambda i, j: (d[i] > d[j]) | ((d[i] == d[j]) & (x[i] > x[j]))
    one = np.flatnonzero(later(np.arange(len(at)), lead))
    # whole lines against lines that have one word more
    whole = p == FULL
    n = group[-1] + 1
    first_whole, first_other = np.full(n, -1), np.full(n, -1)
    w = sub[whole[sub]]
    first_whole[group[w]] = w
    o = sub[~whole[sub]]
    o = o[np.lexsort((x[o], d[o], group[o]))]
    new = np.r_[True, group[o][1:] != group[o][:-1]][: len(o)]
    first_other[group[o[new]]] = o[new]
    against = np.where(whole, first_other[group], first_whole[group])
    two = np.flatnonzero((against >= 0) & later(np.arange(len(at)), against))
    return at[np.r_[one, two]], at[np.r_[lead[one], against[two]]]


def _rows(out: list, kind: int, part: np.ndarray, parts: int, blob) -> None:
    """A row for each part, blob(r) of the records r that go there, in order."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        r = order[cut[p] : cut[p + 1]]
        for col, v in zip(out, (int(p), kind, blob(r)), strict=True):
            col.append(v)


def _put_short(out, parts, docs, doc, line, key, second):
    o = np.argsort(key, kind="stable")
    _rows(out, SHORT, C.part_of(key[o], parts), parts, lambda r: docs.pack(doc[o[r]], line[o[r]], C.deltas(key[o[r]]), second[o[r]]))


def _put_halves(out, parts, docs, doc, line, half, at, n, words):
    o = np.argsort(half, kind="stable")

    def blob(r):
        r = o[r]
        return docs.pack(doc[r], line[r], C.deltas(half[r]), n[r]) + C.encode(words[C.ranges(at[r], n[r])])

    _rows(out, HALVES, C.part_of(half[o], parts), parts, blob)


def _put_variants(out, parts, docs, doc, line, key, pos, second):
    o = np.argsort(key, kind="stable")
    _rows(out, VARIANTS, C.part_of(key[o], parts), parts, lambda r: docs.pack(doc[o[r]], line[o[r]], C.deltas(key[o[r]]), pos[o[r]], second[o[r]]))


def _repack(kind: int, blobs: list, parts: int):
    """The records of some blobs, packed for finer parts."""
    out = [[], [], []]
    docs, doc, (line, key, *rest) = unpack(blobs)
    if kind == HALVES:
        n, words = rest[0].astype(np.int64), rest[1]
        _put_halves(out, parts, docs, doc, line, key, np.cumsum(n) - n, n, words)
    else:
        (_put_short if kind == SHORT else _put_variants)(out, parts, docs, doc, line, key, *rest)
    for p, _, blob in zip(*out, strict=True):
        yield p, blob


def _scan(parts: int, min_words: int, near: int, hot):
    schema = C.arrow(_ROUTED)

    def flush(some: Some):
        out = [[], [], []]
        (docs, row, counts), lines = some.take()
        owner = docs.part(parts)

        def places(kind, doc, line):
            _rows(out, kind, owner[doc], parts, lambda r: docs.pack(doc[r], line[r]))

        places(LINES, row, counts)
        (doc, line, n, words), gone = distinct_lines(*lines)
        places(TOLD, *gone)
        which, h, second = short_records(n, words, near)
        _put_short(out, parts, docs, doc[which], line[which], h, second)
        which, half, at, size = half_records(n, words, near)
        is_hot = np.isin(half, hot.value)
        r = np.flatnonzero(~is_hot)
        _put_halves(out, parts, docs, doc[which[r]], line[which[r]], half[r], at[r], size[r], words)
        r = np.flatnonzero(is_hot)
        if len(r):
            record, key, pos = variants(half[r], at[r], size[r], words)
            _, second, _ = variants(C.mix(half[r] + _SECOND), at[r], size[r], C.mix(words + _SECOND))
            record = which[r][record]
            # of equal variants at one position the earliest speaks for all: the others are gone
            o = np.lexsort((line[record], doc[record], pos, second, key))
            lead = np.r_[True, (key[o][1:] != key[o][:-1]) | (second[o][1:] != second[o][:-1]) | (pos[o][1:] != pos[o][:-1])]
            lead_of = o[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            later = record[o[(doc[record[o]] != doc[record[lead_of]]) | (line[record[o]] != line[record[lead_of]])]]
            places(TOLD, doc[later], line[later])
            v = o[lead]
            _put_variants(out, parts, docs, doc[record[v]], line[record[v]], key[v], pos[v], second[v])
        return C.rows(schema, *out)

    def run(batches):
        some = Some(min_words)
        for ids, texts in C.slices(batches):
            some.add(ids, texts)
            if some.words >= FLUSH_WORDS:
                yield flush(some)
                C.release()
        if some.docs[0]:
            yield flush(some)

    return run


def _scout(min_words: int, near: int):
    schema = C.arrow("half long")

    def flush(some: Some):
        (_, _, n, words), _ = distinct_lines(*some.take()[1])
        return C.rows(schema, half_records(n, words, near)[1].view(np.int64))

    def run(batches):
        some = Some(min_words)
        for ids, texts in C.slices(batches):
            some.add(ids, texts)
            if some.words >= FLUSH_WORDS:
                yield flush(some)
        if some.words:
            yield flush(some)

    return run


def _gone_among_variants(blobs):
    docs, doc, (line, key, pos, second) = unpack(blobs)
    late, early = join_variants(key, pos.astype(np.int64), doc, line)
    sure = late[second[late] == second[early]]
    return docs, doc[sure], line[sure]


def _gone_among_short(blobs):
    docs, doc, (line, key, second) = unpack(blobs)
    order = np.lexsort((line, doc, second, key))
    k, s = key[order], second[order]
    lead = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
    first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    late = order[(doc[order] != doc[first]) | (line[order] != line[first])]
    return docs, doc[late], line[late]


def _some_at_a_time(half: np.ndarray, size: np.ndarray):
    """Slices of records in order of their half: about AT_A_TIME words each, a half's records together."""
    upto = np.cumsum(size + 1)
    new = np.flatnonzero(np.r_[True, half[1:] != half[:-1]][: len(half)])
    block = upto[new] // AT_A_TIME
    cut = new[np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(new)])]
    yield from map(slice, cut.tolist(), [*cut[1:].tolist(), len(half)])


def _gone_among_halves(blobs):
    docs, doc, (line, half, n, words) = unpack(blobs)
    n = n.astype(np.int64)
    at = np.cumsum(n) - n
    order = np.argsort(half, kind="stable")
    same = half[order][1:] == half[order][:-1]
    met = order[np.r_[False, same] | np.r_[same, False]]
    gone = [np.zeros(0, np.int64)]
    for part in _some_at_a_time(half[met], n[met]):
        r = met[part]
        record, key, pos = variants(half[r], at[r], n[r], words)
        r = r[record]
        late, early = join_variants(key, pos, doc[r], line[r])
        # equal lines meet at every variant: one proof of each pair is enough
        _, one = np.unique(r[late] * len(half) + r[early], return_index=True)
        late, early = late[one], early[one]
        x, y = r[late], r[early]
        sure = (half[x] == half[y]) & equal_but_one(words, at[x], n[x], pos[late], at[y], n[y], pos[early])
        gone.append(np.unique(x[sure]))
    gone = np.concatenate(gone)
    return docs, doc[gone], line[gone]


def _told(blobs):
    docs, doc, (line,) = unpack(blobs)
    return docs, doc, line


_GONE = {HALVES: _gone_among_halves, SHORT: _gone_among_short, VARIANTS: _gone_among_variants, TOLD: _told}


def _join(part):
    schema = C.arrow(_VERDICT)
    by_kind: dict[int, list] = {}
    for kind, blob in zip(part["kind"].to_pylist(), C.blobs(part["blob"]), strict=True):
        by_kind.setdefault(kind, []).append(blob)
    out = [[], [], [], []]
    for kind, blobs in by_kind.items():
        if kind == LINES:
            docs, doc, (n,) = unpack(blobs)
            cols = docs.ids[doc], docs.crc[doc], n, np.full(len(doc), None)
            for col, v in zip(out, cols, strict=True):
                col += v.tolist()
            continue
        docs, doc, line = _GONE[kind](blobs)
        for d, lines in C.by_owner(doc, line):
            for col, v in zip(out, (int(docs.ids[d]), int(docs.crc[d]), None, C.encode(np.unique(lines))), strict=True):
                col.append(v)
    C.release()
    return pa.Table.from_batches([C.rows(schema, *out)])


def _sum_up(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_crc32", pa.int64()), ("n_lines", pa.int64()), ("removed", pa.list_(pa.int32()))])
    for b in batches:
        removed = [np.unique(np.concatenate([C.decode(x)[0] for x in blobs] or [np.zeros(0, C.U64)])).astype(np.int32) for blobs in b.column(3).to_pylist()]
        yield pa.record_batch([*b.columns[:3], pa.array(removed, pa.list_(pa.int32()))], schema=schema)


def line_verdicts(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, scout: int = SCOUT, hot_lines: int = HOT_LINES) -> DataFrame:
    """doc_id, text_crc32, n_lines, removed: the numbers (from 0) of the lines that go, in order. One row per document."""
    spark, texts, parts = docs.sparkSession, C.texts_of(docs), C.parts_for(docs, PART_BYTES)
    seen = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(scout)) == 0).mapInArrow(_scout(min_words, near_words), "half long").groupBy("half").count()
    hot = seen.where(F.col("count") >= hot_lines).orderBy(F.desc("count"), "half").limit(MOST_HOT).toArrow()["half"].to_numpy().astype(np.int64)
    shared = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))
    told = C.exchange(lambda n: texts.mapInArrow(_scan(n, min_words, near_words, shared), _ROUTED), parts, _join, _ROUTED, _VERDICT, (HALVES, SHORT, VARIANTS), _repack)
    by_doc = told.groupBy("doc_id", "text_crc32").agg(F.max("n_lines").alias("n_lines"), F.collect_list("removed").alias("removed"))
    return by_doc.mapInArrow(_sum_up, "doc_id long, text_crc32 long, n_lines long, removed array<int>")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the removed lines; all columns stay, n_chars follows the text.

    Verdicts meet rows on doc_id and the text's checksum. A document all of whose words were in
    removed lines goes with them: earlier documents hold all of it. Others stay, those without
    words from the start too.
    """
    text = F.col("text").cast("string")
    key = F.struct(F.col("doc_id").cast("long").alias("d"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("c"))
    verdicts = line_verdicts(docs, **options).where(F.size("removed") > 0).select(F.struct(F.col("doc_id").alias("d"), F.col("text_crc32").alias("c")).alias("k"), F.col("removed").alias("lines"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    joined = rows.join(verdicts, F.when(F.col("key.d").isNotNull(), F.col("key")) == F.col("k"), "left")
    kept = F.array_join(F.filter(F.split(F.col("row.text").cast("string"), "\n", -1), lambda x, i: ~F.array_contains(F.col("lines"), i)), "\n")
    joined = joined.where(F.col("lines").isNull() | kept.rlike("[^ \\t-\\r]"))
    own = {c: F.col("row").getField(c) for c in docs.columns}
    new = {**own, "text": kept.cast(docs.schema["text"].dataType)}
    if "n_chars" in own:
        new["n_chars"] = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(F.when(F.col("lines").isNull(), own[c]).otherwise(new[c]).alias(c) if new[c] is not own[c] else own[c].alias(c) for c in docs.columns))
