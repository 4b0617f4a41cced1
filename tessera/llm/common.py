"""What the corpus operators share: reading, words and hashes, packed exchanges, shared storage.

Words and word n-grams are hashed with numpy over whole slices of text, so that a
task holds a few MB of text at a time and no Python object per word. Exchanges of
many small records (hash, document, position) travel as byte-plane packed blobs:
one row for each slice and target, a third of the bytes of plain rows.

Every operator takes doc_id as a long. Rows without doc_id have no identity to
report on and are left out.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import drop_stash, shared_dir, stash  # noqa: F401

SPACES = (0x20, *range(0x09, 0x0E))
SLICE_BYTES = 1 << 20
BATCH_BYTES = "4m"
MOST_PARTITIONS = 1 << 16
SPLIT_BYTES = 16 << 20
MOST_TASKS = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(codes) -> np.ndarray:
    """A byte table that is true at the given codes."""
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


IS_SPACE = table(SPACES)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(n, b, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 16 << 20:
            return tuple(made)
        _powers[base] = have = tuple(made)
    return have


class Lexed:
    """The words of some texts: hash, index of its text, byte range in buf; first[i]:first[i+1] are text i's words, begin[i] its first byte."""

    def __init__(self, texts: list[bytes], seps: np.ndarray = IS_SPACE, fold: bool = False, hashed: bool = True):
        buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        if fold:
            buf = FOLD[buf]
        gap = seps[buf]
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        self.begin = begin
        self.first = np.searchsorted(self.start, begin)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.buf = buf
        if hashed:
            self.rehash(buf, self.start, self.end)

    def rehash(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Hash the words as they stand in buf, up to `stop`."""
        up, self._down = powers(_BASE, len(buf))
        self.buf, self.stop, self._sums = buf, stop, np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=self._sums[1:])
        self.hash = self.span(start, stop)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self._sums[b] - self._sums[a]) * self._down[a])

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of all runs of k words inside one text."""
        return grams(self.hash, self.text, k)


def grams(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sums = sequence_sums(hashes)
    _, down = powers(_GRAM, len(hashes) + 1)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return at, mix((sums[at + k] - sums[at]) * down[at])


def sequence_sums(hashes: np.ndarray) -> np.ndarray:
    up, _ = powers(_GRAM, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum((hashes | U64(1)) * up[: len(hashes)], out=sums[1:])
    return sums


def sequence_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of word ranges, given sequence_sums."""
    _, down = powers(_GRAM, len(sums))
    return mix((sums[b] - sums[a]) * down[a])


def slices(batches, limit: int = SLICE_BYTES):
    """(ids, UTF-8 texts) of at most limit bytes, one text at least; a null text is empty."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        a = size = 0
        for i, t in enumerate(texts):
            if i > a and size + len(t) > limit:
                yield ids[a:i], texts[a:i]
                a, size = i, 0
            size += len(t)
        if a < len(texts):
            yield ids[a:], texts[a:]
    release()


def pieces(text: bytes, seps: np.ndarray, limit: int = SLICE_BYTES) -> list[bytes]:
    """A text cut before separators into pieces of at most limit bytes; only a word that is longer makes a longer piece, of its own."""
    if len(text) <= limit:
        return [text]
    gap = np.flatnonzero(seps[np.frombuffer(text, np.uint8)])
    out, a = [], 0
    while len(text) - a > limit:
        k = np.searchsorted(gap, a + limit, "right") - 1
        if k < 0 or gap[k] <= a:  # a word that begins here and goes on beyond the limit
            k += 1
        if k >= len(gap):
            break
        out.append(text[a : gap[k]])
        a = int(gap[k])
    return [*out, text[a:]]


def ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indexes at[0]..at[0]+n[0]-1, at[1].., one after another."""
    out = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n)
    return out + np.arange(len(out))


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds little."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_text(kind: str, f):
    """A column function of a text column: f takes a list of UTF-8 texts (a null is empty) and returns an array."""
    out = getattr(pa, {"double": "float64", "boolean": "bool_"}[kind])()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = pa.record_batch([pa.array(np.zeros(len(b), np.int8)), b], ["id", "text"])
            parts = [pa.array(f(texts), out) for _, texts in slices([rows])]
            yield pa.concat_arrays(parts) if parts else pa.array([], out)

    return F.arrow_udf(run, kind)


def encode(*columns: np.ndarray) -> bytes:
    """Unsigned columns as byte planes, without the high planes that are all zero."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c, U64)
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        parts.append(struct.pack("<BI", width, len(c)))
        parts.append(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return b"".join(parts)


def decode(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        width, n = struct.unpack_from("<BI", blob, at)
        at += 5
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(blob, np.uint8, width * n, at).reshape(width, n).T
        out.append(c.view(U64).reshape(-1))
        at += width * n
    return out


def blobs(column):
    """The values of a binary Arrow column, one at a time and without copies."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for x in chunk:
            yield memoryview(x.as_buffer()) if x.is_valid else None


def deltas(a: np.ndarray) -> np.ndarray:
    """Differences, modulo 2**64; cumsum undoes them."""
    a = np.asarray(a).astype(U64)
    return np.diff(a, prepend=U64(0))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so that an order by hash is one by part."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def xxhash64(ids: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of longs (the public XXH64 of their eight bytes, little-endian)."""
    # fixed values: the primes of XXH64
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    rotate = lambda x, k: (x << U64(k)) | (x >> U64(64 - k))
    h = U64(seed + p5 + 8) ^ rotate(ids.astype(np.int64).view(U64) * U64(p2), 31) * U64(p1)
    h = rotate(h, 27) * U64(p1) + U64(p4)
    h = (h ^ (h >> U64(33))) * U64(p2)
    h = (h ^ (h >> U64(29))) * U64(p3)
    return (h ^ (h >> U64(32))).view(np.int64)


def part_of_id(ids: np.ndarray, parts: int) -> np.ndarray:
    """pmod(xxhash64(id), parts): ids are hashed first, as they may have a stride."""
    return np.mod(xxhash64(ids), parts)


def by_owner(owner: np.ndarray, *columns: np.ndarray):
    """(owner, its values of each column, in order) for each distinct owner."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    cut = np.flatnonzero(np.diff(owner)) + 1
    cols = [c[order] for c in columns]
    for a, b in zip([0, *cut], [*cut, len(owner)], strict=True):
        if b > a:
            yield owner[a], *(c[a:b] for c in cols)


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow(spec: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text and more of the documents that have a doc_id, in Arrow batches of a few MB.

    The batch size is a setting of the session that Spark reads when the plan runs, after
    this returns; so it is set for the session, unless the session has one of its own.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, BATCH_BYTES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).where("doc_id is not null")


def fold_of(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, from the sizes of files; no job. 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parts_for(df: DataFrame, bytes_each: int = 8 << 20, most: int = 1 << 30) -> int:
    """How many parts an exchange of a table's words gets; at least as many as Spark's shuffles. Where Catalyst knows no size the texts are measured."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    if not size and "text" in df.columns:
        size = df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]
    return max(1, min(most, max(conf, size // bytes_each)))


def pack_by_part(h: np.ndarray, doc: np.ndarray, extra: np.ndarray, parts: int):
    """(part, blob) of records with a hash, in its order, a document and a number."""
    cut = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        a, b = cut[p], cut[p + 1]
        docs, idx = np.unique(doc[a:b], return_inverse=True)
        yield int(p), encode(deltas(h[a:b]), deltas(docs), idx, extra[a:b])


def unpack(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, number) of the records of packed blobs."""
    h, doc, extra = [], [], []
    for b in blobs:
        x, docs, idx, e = decode(b)
        h.append(np.cumsum(x, dtype=U64))
        doc.append(np.cumsum(docs).astype(np.int64)[idx.astype(np.int64)])
        extra.append(e.astype(np.int64))
    return tuple(np.concatenate(x) for x in (h, doc, extra))


def repack(kind: int, blobs: list, parts: int):
    """The records of some blobs, packed for finer parts."""
    h, doc, extra = unpack(blobs)
    order = np.argsort(h, kind="stable")
    yield from pack_by_part(h[order], doc[order], extra[order], parts)


def _split(schema: pa.Schema, packed: tuple, merge, fine: int, inner: int, most_bytes: int):
    """Rows of a partition for its finer parts: records of packed kinds are dealt anew, a bounded number of bytes at a time."""

    def run(batches):
        held, size, turn = {}, 0, 0

        def flush():
            out = [[], [], []]
            for kind, blobs in held.items():
                for p, blob in merge(kind, blobs, fine):
                    for col, v in zip(out, (p, kind, blob), strict=True):
                        col.append(v)
            return rows(schema, *out)

        for b in batches:
            through = [[], [], []]
            for part, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind in packed:
                    held.setdefault(kind, []).append(blob)
                    size += len(blob)
                else:  # these meet in no part, any will do
                    turn += 1
                    for col, v in zip(through, (part * inner + turn % inner, kind, blob), strict=True):
                        col.append(v)
            yield rows(schema, *through)
            if size >= most_bytes:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _by_part(f):
    """f over the rows of each part, where rows come in the order of parts."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            part = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, z in zip(cut, cut[1:], strict=False):
                if held and z > a and held[0].column(0)[0].as_py() != part[a]:
                    yield from f(pa.Table.from_batches(held)).to_batches()
                    held = []
                if z > a:
                    held.append(b.slice(a, z - a))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return run


def exchange(routed, parts: int, f, schema: str, out: str, packed: tuple, merge=repack) -> DataFrame:
    """f over the rows (part, kind, blob) of each part, one shuffle whatever the number of parts.

    routed(n) gives the rows for n parts. A scan flush makes a blob for each part, so parts that
    grow with the input would leave blobs of a record or two. Spark gets MOST_PARTITIONS at most;
    beyond that a partition's records are dealt to its own finer parts after the shuffle, and
    sorted by part by Spark, which spills.
    """
    coarse = min(parts, MOST_PARTITIONS)
    inner = -(-parts // coarse)
    dealt = routed(coarse).repartition(coarse, "part")
    if inner == 1:
        return dealt.groupBy("part").applyInArrow(f, out)
    return dealt.mapInArrow(_split(arrow(schema), packed, merge, coarse * inner, inner, SPLIT_BYTES), schema).sortWithinPartitions("part").mapInArrow(_by_part(f), out)
