import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import ngram_join as N
from tessera.llm.components import components

from .fixtures import ODD_TEXTS, WORD

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(set size, component, links) by document."""
    sets = {d: shingles(t) for d, t in rows if d is not None}
    ids = sorted(sets)
    parent, links = {d: d for d in ids}, dict.fromkeys(ids, 0)

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
                links[a] += 1
                links[b] += 1
    return {d: (len(sets[d]), root(d), links[d]) for d in ids}


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[r.choice(vocab) for _ in range(r.choice([20, 60]))] for _ in range(6)]
    rows = []
    for _ in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([3, 5, 6, 12, 40, 150]))]
        if r.random() < 0.5:
            w += r.choice(passages)
        for _ in range(r.randint(1, 4)):
            v = list(w)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                i = r.randint(0, len(v) - 1)
                v[i : i + r.choice([0, 1])] = [r.choice(vocab)]
            rows.append((r.randint(0, 10**6), " ".join(v)))
    chain = [r.choice(vocab) for _ in range(100)]
    for i in range(40):  # each links with the next, the ends do not
        chain[i * 2] = f"z{i}"
        rows.append((2 * 10**6 + i, " ".join(chain)))
    rows = list({d: (d, t) for d, t in rows}.values())
    return [*rows, *((3 * 10**6 + i, t) for i, t in enumerate(ODD_TEXTS))]


def got(df, **options):
    out = N.ngram_join(df, count_links=True, **options).collect()
    assert len({r.doc_id for r in out}) == len(out)
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in out}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(4)


def test_equals_brute_force(spark):
    rows = corpus(1)
    want = brute(rows)
    assert got(frame(spark, rows)) == want
    assert len({c for _, c, _ in want.values()}) < len(want) - 50
    plain = {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_join(frame(spark, rows)).collect()}
    assert plain == {d: x[:2] for d, x in want.items()}


@pytest.mark.parametrize("options", [{"block_bytes": 4000}, {"block_sets": 3}])
def test_sub_blocks(spark, options):
    rows = corpus(2, 30)
    assert got(frame(spark, rows), **options) == brute(rows)


def test_tasks_of_one_block_are_spread(spark, monkeypatch):
    """80 sets of one block in 10 sub-blocks: 55 tasks, in more than one partition."""
    from pyspark import TaskContext

    def where(*_):
        def run(block):
            n = block.num_rows
            return pa.table({"node": [TaskContext.get().partitionId()], "to": [0], "links": [n]}, pa.schema([("node", pa.int64()), ("to", pa.int64()), ("links", pa.int64())]))

        return run

    stashed = []
    stash = C.stash
    monkeypatch.setattr(C, "stash", lambda df: stashed.append(stash(df)) or stashed[-1])
    monkeypatch.setattr(N, "_join_block", where)
    monkeypatch.setattr(N, "_blocks", lambda sets, *_: sets.select("node", F.lit(7).cast("long").alias("block")))
    sets = spark.createDataFrame([(i, 1, 1, bytearray(b"x" * 400)) for i in range(80)], "node long, n long, copies long, hashes binary")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        N.linked_classes(sets, block_sets=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = next(x for x in stashed if x.columns == ["node", "to", "links"]).collect()
    by = {}
    for r in told:
        by[r.node] = by.get(r.node, 0) + r.links
    assert len(told) == 55 and sum(by.values()) == 800 and len(by) == 8 and max(by.values()) < 300


def test_edge_cases(spark):
    assert got(frame(spark, [])) == {}
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (4, "A  b"), (5, "a b c"), (None, "a b")]
    assert got(frame(spark, rows)) == {1: (0, 1, 0), 2: (0, 2, 0), 3: (1, 3, 1), 4: (1, 3, 1), 5: (1, 5, 0)}


def test_rows_that_share_an_id_are_judged_apart(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, "x y z"), (1, "x y z"), (2, text), (2, "of its own"), (3, "x  y z"), (None, text)]
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in N.ngram_join(frame(spark, rows), count_links=True).collect())
    assert out == [(1, 1, 1, 1), (1, 6, 1, 1), (2, 1, 2, 0), (2, 6, 1, 1), (3, 1, 1, 1)]
    kept = sorted(((r.doc_id or 0, r.text) for r in N.one_of_each(frame(spark, rows)).collect()))
    assert kept == sorted([(0, text), (1, text), (1, "x y z"), (2, "of its own")])


def test_columns_that_clash(spark):
    df = frame(spark, [(1, "a b"), (2, "a b"), (2, "a b"), (3, "c")])
    for c in "__id row key gone node n fp1 crc".split():
        df = df.selectExpr("*", f"'x' `{c}`")
    out = N.one_of_each(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text, r.key) for r in out.collect()) == [(1, "a b", "x"), (3, "c", "x")]


def test_tree_against_all_pairs():
    r = np.random.default_rng(3)
    for size in (1, 2, 17, 300):
        base = [np.unique(r.integers(0, 1 << 62, r.choice([1, 2, 8, 50, 60]), dtype=np.uint64)) for _ in range(max(1, size // 5))]
        sets = []
        for _ in range(size):
            x = base[r.integers(len(base))]
            x = x[r.random(len(x)) > r.choice([0, 0.03, 0.1])]
            sets.append(np.unique(np.r_[x, r.integers(0, 1 << 62, r.integers(1, 4), dtype=np.uint64)]))
        parent = list(range(size))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(size):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        copies = r.integers(1, 4, size)
        want = [sum(int(copies[j]) for j in range(size) if j != i and 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)) for i in range(size)]
        tree = N.SignatureTree(sets, 80, copies).join(count=True)
        assert tree[1].tolist() == want
        got = N.SignatureTree(sets, 80).join()[0]
        assert all((got[i] == got[j]) == (tree[0][i] == tree[0][j]) for i in range(size) for j in range(i))
        for i in range(size):
            for j in range(i):
                assert (got[i] == got[j]) == (root(i) == root(j))


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + r.randint(0, 50), 1000 + r.randint(0, 50)) for _ in range(40)] + [(5000, 5000 + i) for i in range(100)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: c for x, c in parent.items() if x in touched}


def test_ids_beyond_the_integers_of_doubles(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(2**60 + 3 * i, " ".join([*words[:i], "new", *words[i + 1 :]])) for i in range(0, 60, 7)]
    rows += [(2**60 + 1 + 3 * i, " ".join(words)) for i in range(3)]
    assert got(frame(spark, rows)) == brute(rows)


def test_more_parts_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_PARTITIONS", 3)
    monkeypatch.setattr(C, "SPLIT_BYTES", 2000)
    rows = corpus(6, 30)
    assert got(frame(spark, rows)) == brute(rows)
