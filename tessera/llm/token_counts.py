"""Token counts by pre-token: pieces are counted once per distinct pre-token.

1. All scan tasks report their distinct pre-tokens; each globally distinct one is encoded
   once, and (pre-token, pieces, slices that have it) is kept in the shared folder.
2. The pre-tokens in most slices, at most HOT of them, are broadcast: a documented bound
   on memory, whatever the corpus. They cover nearly all occurrences.
3. A second scan sums frequency x pieces of those in place, and sends the other
   (document, pre-token, frequency) rows to an equi-join with the table of step 1.

Defined cases: null and empty texts have no tokens; special strings inside a text count as
one token, as the library's default has it; rows without doc_id are left out; repeated rows
are returned as often as they occur.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HOT = 1 << 18
MEMO = 300_000
# Unicode white space, and the pattern by which the byte-level vocabulary splits text.
_S = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"""
#: The same split, without a cut inside what has no white space: such a chunk splits alike anywhere.
CHUNK = rf" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_ROWS = "row long, doc_id long, n_bytes long, base long, pre_token string, freq long"
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once in each worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def _texts(batches):
    for ids, texts in C.slices(batches):
        yield ids, [t.decode("utf-8", "replace") for t in texts]


def _pieces_of(text: str, special) -> list[str]:
    return special.split(text) if special and special.search(text) else [text]


def _splitter(specials: list[str]):
    return re.compile("|".join(map(re.escape, specials))) if specials else None


def _distinct(path: str):
    schema = C.arrow("pre_token string, slices long")

    def run(batches):
        special, chunk, pre = _splitter(special_strings(path)), re.compile(CHUNK), regex.compile(PRE_TOKEN)
        seen: set[str] = set()
        size = 0

        def flush():
            found: set[str] = set()
            for c in seen:
                found.update(pre.findall(c))
            out = sorted(found)
            return C.rows(schema, out, [1] * len(out))

        for _, texts in _texts(batches):
            for t in texts:
                for x in _pieces_of(t, special):
                    seen.update(chunk.findall(x))
                size += len(t)
            if size > 4 * C.SLICE_BYTES:
                yield flush()
                seen, size = set(), 0
        if seen:
            yield flush()

    return run


def _encode(path: str):
    schema = C.arrow("pre_token string, slices long, pieces long")

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            words = b.column(0).to_pylist()
            yield C.rows(schema, words, b.column(1).to_pylist(), [len(e.ids) for e in t.encode_batch_fast(words, add_special_tokens=False)])

    return run


def _frequencies(path: str, hot):
    schema = C.arrow(_ROWS)

    def run(batches):
        pieces = hot.value
        special, chunk, pre = _splitter(special_strings(path)), re.compile(CHUNK), regex.compile(PRE_TOKEN)
        memo: dict[str, tuple[int, tuple[str, ...]]] = {}

        def cost(c):
            p = pre.findall(c)
            out = sum(pieces.get(x, 0) for x in p), tuple(x for x in p if x not in pieces)
            if len(memo) < MEMO:
                memo[c] = out
            return out

        row = TaskContext.get().partitionId() << 40
        for ids, texts in _texts(batches):
            out: list[list] = [[] for _ in schema]
            for d, t in zip(ids.tolist(), texts, strict=True):
                row += 1
                base, rare, chunks = 0, Counter(), Counter()
                for k, x in enumerate(_pieces_of(t, special)):
                    base += k > 0
                    chunks.update(chunk.findall(x))
                for c, f in chunks.items():
                    n, other = memo.get(c) or cost(c)
                    base += n * f
                    for x in other:
                        rare[x] += f
                # a document's first row carries what is known of it; a key no pre-token has keeps it off any hot spot
                for col, v in zip(out, (row, d, len(t.encode()), base, f"\0{row}", 0), strict=True):
                    col.append(v)
                for x, f in rare.items():
                    for col, v in zip(out, (row, d, 0, 0, x, f), strict=True):
                        col.append(v)
            yield C.rows(schema, *out)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; path: a byte-level BPE vocabulary for the library tokenizers."""
    spark, texts = docs.sparkSession, C.texts_of(docs)
    known = C.stash(
        texts.mapInArrow(_distinct(path), "pre_token string, slices long").groupBy("pre_token").agg(F.sum("slices").alias("slices")).mapInArrow(_encode(path), "pre_token string, slices long, pieces long")
    )
    levels = known.groupBy(F.log2("slices").cast("int").alias("level")).count().orderBy(F.desc("level")).collect()  # 64 rows at most
    total, least = 0, 1 << 62
    for r in levels:
        total += r["count"]
        if total > hot:
            break
        least = 1 << r["level"]
    table = known.where(F.col("slices") >= least).select("pre_token", "pieces").toArrow()  # at most `hot` rows
    shared = spark.sparkContext.broadcast(dict(zip(table["pre_token"].to_pylist(), table["pieces"].to_pylist(), strict=True)))
    rows = texts.mapInArrow(_frequencies(path, shared), _ROWS)
    rest = known.where(F.col("slices") < least).select("pre_token", "pieces")
    joined = rows.join(rest, "pre_token", "left")
    out = joined.groupBy("doc_id", "row").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("base") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
