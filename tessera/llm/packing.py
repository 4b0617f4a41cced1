"""Bounded-space online best-fit packing of tokenised documents.

Scan tasks tokenise and emit one small row per piece: texts and ids never move. Between white
space, which the vocabulary drops, a chunk's ids do not depend on its neighbours; so a slice's
distinct chunks are looked up by a 64-bit hash in a worker's memo, unknown ones are
encoded once, and the ids of all its texts are laid out by array operations. The memo keys
stems: letters A-Z folded, a comma or full stop after a letter cut off. Beyond MEMO stems
those that were not used for longest go.

The rows are dealt to packers by a hash of their identity, about PER_PACKER to each, and each
packer streams its rows past a fixed number of open bins. A bitset keyed by free space
answers "the tightest open bin that still fits" and "the fullest open bin" with one shift and
one lowest-set-bit; when all bins are open, the fullest closes first. A packer's order is
fixed by the hash, so a lost task repeats the same sequences.

Defined cases: a null or empty text is its end token alone; rows without doc_id are left
out; repeated rows are packed as often as they occur (their places differ).
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_counts import tokenizer

LIMIT = 2048
OPEN = 1024
PER_PACKER = 1 << 17
MEMO = 1_000_000
TEXT_BYTES = 2 << 20
TOGETHER = 256
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_OUT = _PIECES + ", sequence_id long, offset long"
_memos: dict[str, Memo] = {}


def stems(texts: list[bytes]) -> tuple[C.Lexed, np.ndarray]:
    """The chunks of texts, folded but where they could be special strings, and the mark (0 for none) after each stem."""
    lex = C.Lexed(texts, hashed=False)
    buf = C.FOLD[lex.buf]
    special = np.flatnonzero((lex.buf[:-1] == ord("<")) & (lex.buf[1:] == ord("|")))
    for i in np.unique(np.searchsorted(lex.start, special, side="right") - 1):
        buf[lex.start[i] : lex.end[i]] = lex.buf[lex.start[i] : lex.end[i]]
    last, before = buf[lex.end - 1], buf[lex.end - 2]
    marked = ((last == ord(",")) | (last == ord("."))) & (before >= ord("a")) & (before <= ord("z")) & (lex.end - lex.start > 1)
    lex.rehash(buf, lex.start, lex.end - marked)
    return lex, np.where(marked, last, 0)


class Memo:
    """Ids of stems, by their hashes: key i, in order, has flat[at[i] : at[i] + size[i]]."""

    def __init__(self, path: str, most: int = MEMO):
        self.t, self.most, self.turn = tokenizer(path), most, 0
        names = self.t.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for x, i in names.items() if x.endswith("</w>")]] = True
        self.marks = {ord(c): self.t.encode(c, add_special_tokens=False).ids for c in ",."}
        self.key, self.flat = np.zeros(0, C.U64), np.zeros(0, np.uint32)
        self.at, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def encode(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Words of letters go to the library many at a time: each ends with its only word-end token, which is checked."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        plain = [c.isalpha() if c.isascii() else unicodedata.normalize("NFC", c).lower().isalpha() for c in texts]
        together = [i for i, x in enumerate(plain) if x]
        groups = [together[a : a + TOGETHER] for a in range(0, len(together), TOGETHER)]
        out: list = [None] * len(texts)
        for group, e in zip(groups, self._batch([" ".join([texts[i] for i in g]) for g in groups]), strict=True):
            cut = np.flatnonzero(self.ends_word[e]) + 1
            if len(cut) == len(group) and cut[-1] == len(e):
                for i, a, b in zip(group, [0, *cut.tolist()], cut.tolist(), strict=False):
                    out[i] = e[a:b]
        alone = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(alone, self._batch([texts[i] for i in alone]), strict=True):
            out[i] = e
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def find(self, lex: C.Lexed) -> np.ndarray:
        """The place in the memo of each chunk of lex; unknown ones are learnt."""
        key, first, chunk = np.unique(lex.hash, return_index=True, return_inverse=True)
        self.turn += 1
        if len(self.key) + len(key) > self.most:
            self._forget()
        place = np.searchsorted(self.key, key)
        new = np.ones(len(key), bool) if not len(self.key) else self.key[np.minimum(place, len(self.key) - 1)] != key
        if new.any():
            ids = self.encode([lex.buf[a:b].tobytes() for a, b in zip(lex.start[first[new]].tolist(), lex.stop[first[new]].tolist(), strict=True)])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, *ids])
            where = place[new]
            self.key, self.at, self.size, self.used = (np.insert(a, where, b) for a, b in ((self.key, key[new]), (self.at, at), (self.size, size), (self.used, 0)))
            place = place + np.cumsum(new) - new
        self.used[place] = self.turn
        return place[chunk]

    def _forget(self) -> None:
        """Keep the half that was used last, and its ids."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        size = self.size[keep]
        self.flat = self.flat[C.ranges(self.at[keep], size)]
        self.key, self.size, self.used, self.at = self.key[keep], size, self.used[keep], np.cumsum(size) - size


def token_ids(texts: list[bytes], memo: Memo, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, each followed by end_id; where each begins, and the end)."""
    lex, mark = stems(texts)
    place = memo.find(lex)
    size, marked = memo.size[place], mark > 0
    extra = np.zeros(256, np.int64)
    for c, ids in memo.marks.items():
        extra[c] = len(ids)
    whole = size + extra[mark]
    # an end id after each text moves the words of later ones up by one
    begin = np.cumsum(whole) - whole + lex.text
    out = np.full(int(whole.sum()) + len(texts), end_id, np.uint32)
    out[C.ranges(begin, size)] = memo.flat[C.ranges(memo.at[place], size)]
    for c, ids in memo.marks.items():
        here = (begin + size)[marked & (mark == c)]
        for k, i in enumerate(ids):
            out[here + k] = i
    upto = np.r_[0, np.cumsum(whole)][lex.first] + np.arange(len(texts) + 1)
    return out.astype("<u4", copy=False), upto


def _cut(path: str, limit: int, end_id: int):
    schema = C.arrow(_PIECES)

    def run(batches):
        if path not in _memos:
            _memos[path] = Memo(path)
        for ids, texts in C.slices(batches, TEXT_BYTES):
            flat, upto = token_ids(texts, _memos[path], end_id)
            length = np.diff(upto)
            n = -(-length // limit)
            text = np.repeat(np.arange(len(texts)), n)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            a = upto[text] + piece * limit
            b = np.minimum(a + limit, upto[text + 1])
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield C.rows(schema, ids[text], piece, piece * limit, b - a, crc)

    return run


class OpenBins:
    """A fixed number of open bins by free space."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most, self.open = limit, most, 0
        self.bits, self.by_free = 0, [[] for _ in range(limit + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return b

    def place(self, length: int, fresh: int) -> tuple[int, int]:
        """(bin, offset in it); a new bin is called `fresh`."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.limit, fresh
            if length < self.limit:
                if self.open == self.most:  # the fullest closes
                    self._take((self.bits & -self.bits).bit_length() - 1)
                else:
                    self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
        elif free < self.limit:
            self.open -= 1
        return b, self.limit - free


def _pack(limit: int, most: int):
    schema = C.arrow(_OUT)

    def run(batches):
        now, bins, made = None, None, 0
        for b in batches:
            packer, length = b.column("packer").to_pylist(), b.column("length").to_pylist()
            sequence, offset = [], []
            for p, n in zip(packer, length, strict=True):
                if p != now:
                    now, bins, made = p, OpenBins(limit, most), 0
                k, at = bins.place(n, made)
                made += k == made
                sequence.append((p << 40) + k)
                offset.append(at)
            yield C.rows(schema, *(b.column(f.name) for f in list(schema)[:5]), sequence, offset)

    return run


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: what documents are cut into, without their ids."""
    return C.texts_of(docs).mapInArrow(_cut(path, limit, end_id), _PIECES)


def pack(pieces: DataFrame, limit: int = LIMIT, open_bins: int = OPEN, per_packer: int = PER_PACKER) -> DataFrame:
    """pieces with sequence_id and offset."""
    kept = C.stash(pieces)
    packers = max(1, -(-kept.count() // per_packer))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = kept.withColumn("packer", F.pmod(key, F.lit(packers))).withColumn("turn", F.xxhash64(key))
    ordered = dealt.repartition(packers, "packer").sortWithinPartitions("packer", "turn", "doc_id", "piece", "start", "length", "ids_crc32")
    return ordered.mapInArrow(_pack(limit, open_bins), _OUT)


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = 0, open_bins: int = OPEN) -> DataFrame:
    return pack(pieces(docs, path, limit, end_id), limit, open_bins)
