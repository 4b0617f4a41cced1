"""Substring dedup by repeated-phrase automata.

A window is 20 consecutive words of one document. Every word covered by a window
whose word sequence also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed; windows are judged on the input.

1. Confirm recurring passages. Each scan task hashes its windows, settles equal ones
   among its own and sends one record per distinct window to the window's part. A part
   finds the globally first start of each window that occurs twice or more.
2. Compile. Documents are dealt to shards by a hash of doc_id. A shard gets, per recurring window,
   a representative inside the shard and, if it lies there, the globally first start.
   Runs of consecutive windows in a representative are passages; their blocks of six
   words, fifteen apart, so that each window contains one, go into one automaton a shard.
3. Stream the shard's documents through its automaton; each hit is extended word by
   word against the passage (an exact check of the hashes), and each 20-word window it
   proves is removed unless it is the globally first.

A window that many documents share costs a record per scan slice and a representative
per shard, never a record per pair of documents.

Defined cases: null or empty text has no words (sha256 of the empty string); documents
of fewer than 20 words lose nothing; rows without doc_id are left out; rows that repeat
doc_id and text are one document, each returned; rows that share a doc_id and differ in text
are documents of their own, in the order of a hash of the text: a start carries the number of its text
among those of its id (0 nearly always, so it takes no room). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW = 20
FLUSH = 2_500_000
BLOCK = 6
#: A start is the number of the document's text among those of its id, above these bits, and a word's number.
PLACE_BITS = 40
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ROUTED = "part int, shard int, blob binary"
_TOLD = "shard int, first boolean, blob binary"
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _starts_blob(ids: np.ndarray, starts: np.ndarray) -> bytes:
    order = np.lexsort((starts, ids))
    return C.encode(C.deltas(ids[order]), starts[order])


def _read_starts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, starts = C.decode(blob)
    return np.cumsum(ids).astype(np.int64), starts.astype(np.int64)


def _scan(window: int, parts: int, shards: int):
    schema = C.arrow(_ROUTED)

    def flush(hashes, ids, starts):
        h, doc, start = (np.concatenate(x) for x in (hashes, ids, starts))
        for x in (hashes, ids, starts):
            x.clear()  # copied: the slices' own need not stay
        order = np.argsort(h, kind="stable")
        h, doc, start = h[order], doc[order], start[order]
        new = np.r_[True, h[1:] != h[:-1]]
        again = ~new
        twice = again | np.r_[again[1:], False]
        at = np.flatnonzero(twice)
        sub = np.lexsort((start[at], doc[at], h[at]))
        at = at[sub]
        lead = np.r_[True, h[at][1:] != h[at][:-1]] if len(at) else np.zeros(0, bool)
        out = [[], [], []]
        rest = at[~lead]
        if len(rest):  # settled here: an earlier start is in this slice
            shard = C.part_of_id(doc[rest], shards)
            o = np.lexsort((shard, h[rest]))
            rest, shard = rest[o], shard[o]
            one = np.r_[True, (h[rest][1:] != h[rest][:-1]) | (shard[1:] != shard[:-1])]
            rest, shard = rest[one], shard[one]
            for s, d, x in C.by_owner(shard, doc[rest], start[rest]):
                out[0].append(int(s) % parts)
                out[1].append(int(s))
                out[2].append(_starts_blob(d, x))
        keep = np.sort(np.concatenate([np.flatnonzero(~twice), at[lead]]))
        # lexsort has reordered equal hashes only, so h stays sorted when leads are read through at
        lead_of = np.zeros(len(h), bool)
        lead_of[at[lead]] = True
        h, doc, start, dup = h[keep], doc[keep], start[keep], lead_of[keep]
        for p, blob in C.pack_by_part(h, doc, start * 2 + dup, parts):
            for col, v in zip(out, (p, -1, blob), strict=True):
                col.append(v)
        return C.rows(schema, *out)

    def run(batches):
        held, n = ([], [], []), 0
        for b in batches:
            turns, done = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), 0
            for ids, texts in C.slices([b]):
                lex = C.Lexed(texts)
                at, h = lex.grams(window)
                owner = lex.text[at]
                for x, y in zip(held, (h, ids[owner], turns[done + owner] << PLACE_BITS | at - lex.first[owner]), strict=True):
                    x.append(y)
                done += len(ids)
                n += len(at)
                if n >= FLUSH:
                    yield flush(*held)
                    held, n = ([], [], []), 0
        if n:
            yield flush(*held)

    return run


def _confirm(shards: int):
    schema = C.arrow(_TOLD)

    def run(part):
        out = [[], [], []]
        packed = []
        for shard, blob in zip(part["shard"].to_pylist(), part["blob"].to_pylist(), strict=True):
            if shard >= 0:
                for x, y in zip(out, (shard, False, blob), strict=True):
                    x.append(y)
            else:
                packed.append(blob)
        if packed:
            h, doc, start = C.unpack(packed)
            order = np.argsort(h, kind="stable")
            h = h[order]
            same = h[1:] == h[:-1]
            at = np.flatnonzero(np.r_[False, same] | np.r_[same, False] | (start[order] & 1 > 0))
            h, doc, start = h[at], doc[order[at]], start[order[at]] >> 1
            order = np.lexsort((start, doc, h))
            h, doc, start = h[order], doc[order], start[order]
            lead = np.r_[True, h[1:] != h[:-1]][: len(h)]
            for first, sel in ((True, lead), (False, ~lead)):
                d, x = doc[sel], start[sel]
                for s, dd, xx in C.by_owner(C.part_of_id(d, shards), d, x):
                    for col, y in zip(out, (int(s), first, _starts_blob(dd, xx)), strict=True):
                        col.append(y)
        import pyarrow as pa

        return pa.Table.from_batches([C.rows(schema, *out)])

    return run


def _resolve(window: int, with_text: bool):
    schema = C.arrow(_OUT)
    stride = window - BLOCK + 1

    def starts_by_doc(blobs):
        out = {}
        if blobs:
            ids, starts = (np.concatenate(x) for x in zip(*map(_read_starts, blobs), strict=True))
            for d, x in C.by_owner(ids, starts):
                for turn, at in C.by_owner(x >> PLACE_BITS, x & (1 << PLACE_BITS) - 1):
                    out[int(d), int(turn)] = np.unique(at)
        return out

    def passages(firsts, texts):
        """(words, from, to) of each run, and the automaton of their blocks."""
        runs, blocks = [], {}
        for d, starts in firsts.items():
            words = WORD.findall(texts[d])
            cut = np.flatnonzero(np.diff(starts) > 1) + 1
            for a, b in zip(starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]] + window, strict=True):
                for o in range(int(a), int(b) - BLOCK + 1, stride):
                    blocks.setdefault(f" {' '.join(words[o : o + BLOCK])} ", []).append((len(runs), o))
                runs.append((words, int(a), int(b)))
        automaton = ahocorasick.Automaton()
        for k, v in blocks.items():
            automaton.add_word(k, (len(k), v))
        if blocks:
            automaton.make_automaton()
        return runs, automaton if blocks else None

    def locate(words, line, runs, automaton):
        """Starts of the windows that a passage holds too."""
        ends, found, done = None, set(), {}
        for e, (size, places) in automaton.iter(line):
            if ends is None:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            i = int(np.searchsorted(ends, e - size + 2))
            for r, o in places:
                shift = (r, i - o)
                if done.get(shift, -1) >= i + stride:
                    continue
                other, a, b = runs[r]
                lo, hi = 0, BLOCK
                while i - lo > 0 and o - lo > a and words[i - lo - 1] == other[o - lo - 1]:
                    lo += 1
                most = min(len(words) - i, b - o)
                while hi < most and words[i + hi] == other[o + hi]:
                    hi += 1
                done[shift] = i + hi
                found.update(range(i - lo, i + hi - window + 1))
        return found

    def run(shard):
        kind = np.array(shard["kind"].to_pylist())
        blobs = shard["blob"].to_pylist()
        origin = starts_by_doc([blobs[i] for i in np.flatnonzero(kind == 1)])
        recurring = starts_by_doc([blobs[i] for i in np.flatnonzero(kind == 2)])
        ids, texts, turns = shard["doc_id"].to_pylist(), shard["text"].to_pylist(), shard["turn"].to_pylist()
        rows = np.flatnonzero(kind == 0)
        holders = {(ids[i], turns[i]): texts[i] or "" for i in rows if (ids[i], turns[i]) in recurring}
        runs, automaton = passages(recurring, holders)
        out = [[] for _ in schema]
        for i in rows:
            words = WORD.findall(texts[i] or "")
            line = f" {' '.join(words)} "
            n = len(words)
            if automaton is not None and n >= window and (found := locate(words, line, runs, automaton)):
                found.difference_update(origin.get((ids[i], turns[i]), np.zeros(0, np.int64)).tolist())
                edge = np.zeros(n + 1, np.int32)
                at = np.fromiter(found, np.int64, len(found))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                words = [w for w, c in zip(words, np.cumsum(edge[:-1]), strict=True) if not c]
                line = f" {' '.join(words)} "
            for col, y in zip(out, (ids[i], n, n - len(words), hashlib.sha256(line[1:-1].encode()).hexdigest(), line[1:-1] if with_text else None), strict=True):
                col.append(y)
        import pyarrow as pa

        return pa.Table.from_batches([C.rows(schema, *out)])

    return run


def _numbered(texts: DataFrame) -> DataFrame:
    """texts with turn: the number of the text among the different texts of its doc_id, 0 nearly always."""
    h = F.xxhash64("text")
    several = texts.groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("not a <=> b").select("doc_id")
    rows = texts.select("doc_id", h.alias("h")).join(several, "doc_id", "left_semi").distinct()
    later = C.stash(rows.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1).where("turn > 0"))
    if later.isEmpty():  # every id has one text: no join
        return texts.withColumn("turn", F.lit(0))
    return texts.withColumn("h", h).join(later, ["doc_id", "h"], "left").select("doc_id", "text", F.coalesce("turn", F.lit(0)).alias("turn"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, the kept words joined by spaces as kept_text."""
    texts = _numbered(C.texts_of(docs))
    parts = C.parts_for(docs)
    shards = min(parts, C.MOST_TASKS) | 1
    told = C.exchange(lambda n: texts.mapInArrow(_scan(window, n, shards), _ROUTED), parts, _confirm(shards), _ROUTED, _TOLD, (-1,))
    none = F.lit(None)
    rows = told.select("shard", F.when(F.col("first"), 1).otherwise(2).alias("kind"), none.cast("long").alias("doc_id"), none.cast("string").alias("text"), none.cast("int").alias("turn"), "blob").unionByName(
        texts.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "doc_id", "text", "turn", none.cast("binary").alias("blob"))
    )
    out = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(_resolve(window, with_text), _OUT)
    return out if with_text else out.drop("kept_text")
