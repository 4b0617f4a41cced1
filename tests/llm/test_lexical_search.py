import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import common as C
from tessera.llm import lexical_search as L

from .fixtures import SCHEMA, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text); a statement of the contract in plain Python."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in set(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in want.items() if t in c)
            if s > 0:
                found.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


ITEMS = [(1, "tok1 tok2 TOK3 tok1 the"), (2, None), (3, "the über niño cat's"), (4, "unheard"), (5, ""), (6, "42 x.y 日本語 é"), (6, "Dog"), (3, "the über niño cat's"), (7, "the " * 300)]


@pytest.mark.parametrize("block, expand, parts", [(1 << 19, 1 << 21, 3), (4, 7, 1), (2, 1, 5)])
def test_equals_the_contract(spark, monkeypatch, block, expand, parts):
    monkeypatch.setattr(L.accumulate, "__defaults__", (expand,))
    rows = odd_documents(80) + [(900, "tok1 alone", "en", "s"), (900, "tok2 tok2", "en", "s"), (901, "the the", "en", "s"), (901, "the the", "en", "s")]
    docs = spark.createDataFrame([*rows, (None, "tok1 tok1", None, None)], SCHEMA).repartition(parts)
    items = spark.createDataFrame([*ITEMS, (None, "tok1")], "item_id long, text string")
    got = L.lexical_search(docs, items, block_pairs=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute([r[:2] for r in rows], ITEMS)


def test_named_items_and_empty_tables(spark):
    docs = spark.createDataFrame(odd_documents(20), SCHEMA)
    items = spark.createDataFrame([("a", "tok1 the"), ("b", "of and")], "item_id string, text string")
    assert sorted(map(tuple, L.lexical_search(docs, items).collect())) == brute([r[:2] for r in odd_documents(20)], [tuple(r) for r in items.collect()])
    assert L.lexical_search(docs.limit(0), items).count() == 0
    assert L.lexical_search(docs, items.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    monkeypatch.setattr(C.pieces, "__defaults__", (64,))
    texts = ["ab cd, " * 50, "x" * 500, "é" * 100 + " ab", " " * 300 + "cd", "y" * 70]
    for longest in (None, 80, 600):
        n, pairs = {}, Counter()
        for a, counts, owner, h in L.terms_of([t.encode() for t in texts], longest):
            n.update({a + i: int(c) for i, c in enumerate(counts)})
            pairs.update(zip((a + owner).tolist(), h.tolist(), strict=True))
        assert n == {i: len(terms(t)) for i, t in enumerate(texts)}
        hashed = [[w for w in terms(t) if longest is None or len(w.encode()) <= max(longest, 64)] for t in texts]
        assert sum(pairs.values()) == sum(map(len, hashed)) and len(pairs) == sum(len(set(w)) for w in hashed)


@pytest.mark.parametrize("limit", [1, 5, 64])
def test_pieces(limit):
    r = np.random.default_rng(1)
    for _ in range(200):
        t = bytes(r.choice(list(b"ab ,"), r.integers(0, 60)).tolist())
        got = C.pieces(t, L.SEPARATORS, limit)
        assert b"".join(got) == t
        assert [w for p in got for w in re.findall(rb"[ab]+", p)] == re.findall(rb"[ab]+", t)
        assert all(len(p) <= limit or re.fullmatch(rb"[ ,]?[ab]+", p) for p in got)


def test_radix_order():
    r = np.random.default_rng(2)
    for bits in (3, 16, 20, 40, 64):
        keys = r.integers(0, 2**bits, 500, dtype=np.uint64, endpoint=False)
        assert np.array_equal(L.radix_order(keys), np.argsort(keys, kind="stable"))
    assert len(L.radix_order(np.zeros(0, np.uint64))) == 0
