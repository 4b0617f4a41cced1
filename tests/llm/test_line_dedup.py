import random
import zlib

import numpy as np

from tessera.llm import common as C
from tessera.llm import line_dedup as L
from tessera.llm import queries

from .fixtures import ODD_TEXTS, WORD

SCHEMA = "doc_id long, text string, n_chars long, removed string"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def brute(rows, min_words=1, near=8):
    lines = sorted((d, k, WORD.findall(x)) for d, t in rows if d is not None for k, x in enumerate((t or "").split("\n")))
    lines = [x for x in lines if len(x[2]) >= min_words]
    out = {d: set() for d, _ in rows if d is not None}
    for i, (d, k, w) in enumerate(lines):
        for d2, k2, w2 in lines[:i]:
            if (d2, k2) < (d, k) and (w == w2 or (min(len(w), len(w2)) >= near and within_one(w, w2))):
                out[d].add(k)
                break
    return {d: sorted(x) for d, x in out.items()}


def corpus(seed, n=80):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(40)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40]))] for _ in range(25)]
    base += [["a"] * 9, ["a"] * 10, ["a", "b"] * 6]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                i, kind = r.randint(0, len(w) - 1), r.randint(0, 2)
                w[i : i + (kind != 1)] = [] if kind == 0 else [r.choice(vocab)]
            lines.append(" ".join(w) + r.choice(["", " "]))
            if r.random() < 0.2:
                lines.append("")
        rows.append((d * 7 % 1000, "\n".join(lines)))
    return [*rows, *((2000 + i, t) for i, t in enumerate(ODD_TEXTS))]


def got(df, **options):
    return {r.doc_id: r.removed for r in L.line_verdicts(df, **options).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in rows], SCHEMA).repartition(4)


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(frame(spark, rows)) == brute(rows)


def test_hot_halves_travel_as_variants(spark):
    rows = corpus(3)
    assert got(frame(spark, rows), scout=1, hot_lines=1) == brute(rows)
    assert got(frame(spark, rows), scout=1, hot_lines=3) == brute(rows)


def test_text_and_columns(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\n\nshort line"), (2, f"start of it\n{line} ten\nshort line\n"), (None, line), (3, None), (3, None), (4, f" \n{line}\n\t\u00a0"), (5, "\n"), (6, f"{line}\n \r")]
    out = sorted(L.dedup_lines(frame(spark, rows)).collect(), key=str)
    assert len(out) == 7 and {r.doc_id for r in out} == {None, 1, 2, 3, 4, 5}  # nothing is left of 6 and out[0].asDict().keys() == {"doc_id", "text", "n_chars", "removed"}
    by = {r.doc_id: r for r in out}
    assert by[1].text == rows[0][1]
    assert by[2].text == "start of it\n" and by[2].n_chars == len(by[2].text)
    assert by[3].text is None and by[None].text == line
    assert L.line_verdicts(frame(spark, [])).count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = corpus(4) + [(3000 + d, "All rights reserved.\nHome\n\nnext page\n" + ("Home " if d % 2 else "home")) for d in range(40)]
    want = brute(rows)
    assert got(frame(spark, rows), scout=1, hot_lines=1) == want
    assert got(frame(spark, rows), min_words=5) == brute(rows, min_words=5)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op9_line_dedup(spark, str(tmp_path))
    columns = ["doc_id", "n_lines", "n_removed", "removed_lines"]
    out = sorted(tuple(r) for r in out.select(columns).collect())
    assert {d: x for d, _, _, x in out} == {d: ",".join(map(str, x)) for d, x in want.items()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()['op9_line_dedup']})").fetchall()
    assert sorted(sql) == out


def colliding_words():
    """Pairs of words whose hashes agree in the low 32 bits."""
    words = [f"w{i}" for i in range(400_000)]
    low = C.Lexed([" ".join(words).encode()]).hash & C.U64((1 << 32) - 1)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])
    return [(words[i], words[j]) for i, j in zip(order[at], order[at + 1], strict=True)]


def test_words_are_told_apart_by_more_than_32_bits(spark):
    pairs = colliding_words()
    assert pairs
    rows = []
    for k, (a, b) in enumerate(pairs):
        for d, w in ((2 * k, a), (2 * k + 1, b)):
            rows.append((d, f"{w}\n{w} b c d e\n" + " ".join([w] * 8) + f"\n{k} {w} c d e f {w} h i j k"))
    assert not any(got(frame(spark, rows)).values())
    assert not any(got(frame(spark, rows), scout=1, hot_lines=1).values())


def test_distance_is_verified():
    words = np.array([1, 2, 3, 4, 1, 9, 3, 4, 1, 3, 4], C.U64)
    one = lambda *x: L.equal_but_one(words, *(np.array([v]) for v in x))[0]
    assert one(0, 4, 1, 4, 4, 1) and not one(0, 4, 2, 4, 4, 2) and one(8, 3, L.FULL, 0, 4, 1) and not one(8, 3, L.FULL, 0, 4, 2)
    assert not one(0, 4, 1, 8, 3, 1)
    doc, line, n = np.array([5, 6, 7]), np.zeros(3, int), np.array([4, 4, 3])
    (kept, *_), (gone, _) = L.distinct_lines(doc, line, np.array([2, 2, 2]), np.array([1, 2, 1, 2, 1, 3], C.U64))
    assert kept.tolist() == [5, 7] and gone.tolist() == [6] and len(n) == 3


def test_rows_that_share_an_id_are_judged_apart(spark):
    line, other = "one two three four five six seven eight nine", "this other row holds a wholly different line of words"
    rows = [(0, line), (1, line), (1, other), (1, other), (2, f"{other}\nnew")]
    out = sorted((r.doc_id, r.text) for r in L.dedup_lines(frame(spark, rows)).collect())
    assert out == [(0, line), (1, other), (1, other), (2, "new")]  # the copy of 0 is gone whole
    verdicts = {(r.doc_id, r.text_crc32): list(r.removed) for r in L.line_verdicts(frame(spark, rows)).collect()}
    crc = lambda t: zlib.crc32(t.encode())
    assert verdicts == {(0, crc(line)): [], (1, crc(line)): [0], (1, crc(other)): [], (2, crc(f"{other}\nnew")): [0]}


def test_columns_that_clash(spark):
    df = frame(spark, [(1, "a b"), (2, "a b\nc")])
    for c in "__id __removed row key lines k d c doc text_crc32 n_lines".split():
        df = df.selectExpr("*", f"'x' `{c}`")
    out = L.dedup_lines(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text, r.n_chars, r.key) for r in out.collect()) == [(1, "a b", 3, "x"), (2, "c", 1, "x")]


def test_strided_ids_use_all_parts():
    docs = L.Docs(np.arange(0, 5000, 5), np.zeros(1000, int))
    assert np.bincount(docs.part(5), minlength=5).min() > 150


def test_more_parts_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_PARTITIONS", 3)
    rows = corpus(5)
    assert got(frame(spark, rows)) == brute(rows)
    monkeypatch.setattr(C, "SPLIT_BYTES", 2000)
    assert got(frame(spark, rows), scout=1, hot_lines=2) == brute(rows)
