"""Attempts, matrices, scores, reliability and segments against plain Python."""

import itertools
import random
from statistics import mean

import pytest
from pyspark.sql import functions as F

from tessera.operators import matching, scoring, segments


def test_first_valid_attempt(spark):
    runs = [["bad", "bad", "<1>"], ["bad", "bad", "bad"], ["<999>", "<1>", "x"], ["<3, 1>", "x", "x"], ["<NONE>", "<1>", "x"], ["a", "b", "c", "<1>"]]
    rows = spark.createDataFrame([(i, k, x) for i, r in enumerate(runs) for k, x in enumerate(r)], "recall_idx int, attempt int, response string")
    got = {x.recall_idx: (x.story_idxs, x.n_attempts) for x in matching.first_valid(matching.parse_attempts(rows, 3), ["recall_idx"], 3).collect()}
    assert got == {0: ([0], 3), 1: ([], 3), 2: ([0], 2), 3: ([0, 2], 1), 4: ([], 1), 5: ([], 3)}


def test_matrix(spark):
    matches = spark.createDataFrame([("s", 0, [0, 1, 1]), ("s", 1, [2]), ("s", 2, [])], "k string, recall_idx int, story_idxs array<bigint>")
    cells = matching.to_cells(matches, ["k", "recall_idx"])
    dims = spark.createDataFrame([("s", 3, 3), ("none", 5, 0)], "k string, n_story int, n_recall int")
    grid = matching.dense(cells, dims, ["k"]).collect()
    assert len(grid) == 9 and {(x.story_idx, x.recall_idx) for x in grid if x.value} == {(0, 0), (1, 0), (2, 1)}
    assert {(x.recall_idx, tuple(x.story_idxs)) for x in matching.to_matches(cells, ["k", "recall_idx"]).collect()} == {(0, (0, 1)), (1, (2,))}
    outside = spark.createDataFrame([("s", 0, [9])], matches.schema)
    with pytest.raises(Exception, match="outside"):
        matching.dense(matching.to_cells(outside, ["k", "recall_idx"]), dims, ["k"]).collect()


def test_lexical_and_containment(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(d, " ".join(r.choice(vocab) for _ in range(r.randint(0, 25)))) for d in range(60)] + [(99, None)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 6)))) for i in range(40)] + [(50, docs[3][1][2:30]), (51, docs[4][1])]
    d, b = spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "i int, text string")
    words = lambda t: set((t or "").lower().split())
    for least in (0.5, 0.8):
        want = {(x, i) for x, t in docs for i, s in items if words(s) and len(words(s) & words(t)) / len(words(s)) >= least}
        assert {(x.d, x.i) for x in matching.lexical_matches(d, b, "d", "i", least).collect()} == want
    assert {tuple(x) for x in matching.containment(d, b, "d", "i").collect()} == {(x, i) for x, t in docs for i, s in items if t is not None and s in t}


def repeats(seed, m=4, n=30, recalls=3):
    r = random.Random(seed)
    return {q: [[int(r.random() < 0.3 + 0.1 * k) for _ in range(n)] for k in range(m)] for q in range(recalls)}


def frames(spark, data):
    cells = [(q, k, u) for q, rows in data.items() for k, row in enumerate(rows) for u, v in enumerate(row) if v]
    ids = [(q, k) for q, rows in data.items() for k in range(len(rows))]
    return spark.createDataFrame(cells, "q int, k int, u int"), spark.createDataFrame(ids, "q int, k int")


def plain_f1(a, b):
    both = sum(x & y for x, y in zip(a, b, strict=True))
    return 2 * both / (sum(a) + sum(b)) if sum(a) + sum(b) else 0.0


def test_pairwise_f1(spark):
    data = repeats(5)
    data[9] = [[0] * 30, [0] * 30]
    cells, ids = frames(spark, data)
    pairs = scoring.repeat_pairs(cells, "q", "k", ["u"], ids)
    want = mean(mean(plain_f1(a, b) for a, b in itertools.combinations(rows, 2)) for rows in data.values())
    assert scoring.pairwise_f1(pairs, "q").first()[0] == pytest.approx(want)
    assert scoring.pairwise_f1(pairs.limit(0), "q").first()[0] == 0


def coincidence_alpha(data):
    """From the coincidence matrix."""
    o = [[0.0, 0.0], [0.0, 0.0]]
    for rows in data.values():
        for unit in zip(*rows, strict=True):
            for a, b in itertools.permutations(unit, 2):
                o[a][b] += 1 / (len(unit) - 1)
    n0, n1 = sum(o[0]), sum(o[1])
    return 1 - (n0 + n1 - 1) * o[0][1] / (n0 * n1)


def test_krippendorff(spark):
    for seed in (6, 7):
        data = repeats(seed)
        cells, _ = frames(spark, data)
        assert scoring.krippendorff_alpha(cells, ["q", "u"], 4, 90).first()[0] == pytest.approx(coincidence_alpha(data))
    assert scoring.krippendorff_alpha(cells.limit(0), ["q", "u"], 4, 90).first()[0] is None


def test_scores_macro_and_zero_rules(spark):
    model = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("b", 1, 1)], "r string, i int, j int")
    human = spark.createDataFrame([("a", 0, 0), ("c", 0, 0), ("b", 1, 1)], "r string, i int, j int")
    dims = spark.createDataFrame([(x, 6) for x in "abcd"], "r string, n_cells long")
    counts = scoring.confusion_counts(model, human, dims, ["r"], ["i", "j"])
    scored = {x.r: x for x in scoring.score(counts).collect()}
    assert (scored["a"].tp, scored["a"].fp, scored["a"].fn, scored["a"].tn) == (1, 1, 0, 4)
    assert (scored["c"].precision, scored["c"].accuracy, scored["c"].pearson) == (0, 0, 0)
    macro = scoring.macro(scoring.score(scoring.rated_only(counts))).first()
    assert macro.n_recalls == 3 and macro.precision == pytest.approx(0.5) and macro.recall == pytest.approx(2 / 3)
    assert macro.f1 == pytest.approx(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3))
    with pytest.raises(Exception, match="no human"):
        scoring.require_rated(counts).collect()
    with pytest.raises(Exception, match="no recall"):
        scoring.macro(scoring.score(counts.limit(0))).collect()
    assert {x.r for x in scoring.plot_exclusions(counts).collect()} == {"a", "b"}
    assert {tuple(x) for x in scoring.overlay(model, human, ["r", "i", "j"]).collect()} == {("a", 0, 0, 3), ("a", 0, 1, 2), ("b", 1, 1, 3), ("c", 0, 0, 1)}


def test_sem_and_closest(spark):
    rows = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("x", 2, 3.0), ("y", 0, 5.0), ("z", 0, 1.0), ("z", 1, 3.0)], "g string, i int, v double")
    got = {x.g: x for x in scoring.mean_and_sem(rows, ["g"], "v").collect()}
    assert got["x"].sem == pytest.approx(1 / 3**0.5) and got["y"].sem == 0
    assert {x.g: x.i for x in scoring.closest_to_mean(rows, ["g"], "i", "v").collect()} == {"x": 1, "y": 0, "z": 0}


def test_usage(spark):
    log = spark.createDataFrame([("a", 1_000_000, 500_000), ("b", 5, 5)], "model string, in_tokens long, out_tokens long")
    prices = spark.createDataFrame([("a", 2.0, 4.0)], "model string, price_in double, price_out double")
    assert {x.model: x.cost for x in scoring.usage_totals(log, prices, ["model"]).collect()} == {"a": 4.0, "b": 0.0}


def test_windows(spark):
    rows = spark.createDataFrame([("s", i, f" t{i} ") for i in range(5)], "s string, i int, text string")
    got = {x.i: x.window for x in segments.context_windows(rows, ["s"], "i", 1, "[", "]").collect()}
    assert got[2] == "t1\n[t2]\nt3" and got[0] == "[t0]\nt1" and got[4] == "t3\n[t4]"
    assert {x.i: x.window for x in segments.context_windows(rows, ["s"], "i", 0).collect()}[2] == "<target> t2 </target>"


def spans(sentences, most, at=0, inside=False):
    """Spans of quotations, by the rule's words."""
    if at == len(sentences):
        return []
    text = lambda j: " ".join(sentences[at : j + 1])
    if (sentences[at].count('"') + inside) % 2 == 0:
        return [[at, at], *spans(sentences, most, at + 1)]
    ends = [j for j in range(at, len(sentences)) if text(j).count('"') % 2 == 0 or len(text(j)) >= most]
    last = ends[0] if ends else len(sentences) - 1
    if len(text(last)) >= most:
        return [[at, at], *spans(sentences, most, at + 1, True)]
    return [[at, last], *spans(sentences, most, last + 1)]


def test_quotes_and_sentences(spark):
    long = 'x "' + "y" * 250
    cases = [(['He said "a.', 'b." Then left.', "Next."], ['He said "a. b." Then left.', "Next."]), ([long, "b.", 'c" d.', "e."], [long, "b.", 'c" d. e.']), ([], [])]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "s array<string>").select(segments.quotes_kept_whole(F.col("s"))).collect()
    assert [r[0] for r in rows] == [w for _, w in cases]
    r = random.Random(3)
    some = [[r.choice(["a.", '"b.', 'c".', '"d".', "e" * 8]) for _ in range(r.randint(0, 9))] for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in some], "s array<string>").select("s", segments.quoted_spans(F.col("s"), 14).alias("p")).collect()
    assert all(x.p == spans(x.s, 14) for x in rows)
    rows = spark.createDataFrame([(1, 'Short. A longer sentence here! He said "one thing. And another." Right then?'), (2, None), (3, " ")], "k int, text string")
    assert [x.text for x in segments.sentence_segments(rows, ["k"]).orderBy("seg_idx").collect()] == ["A longer sentence here!", 'He said "one thing. And another." Right then?']


def test_cover_recovery(spark):
    cases = [
        ("a b c d e", ["a", "x", "y", "d", "e"], {1: "missing", 2: "skipped"}),
        ("a b c", ["a", "x", "y"], {1: "missing", 2: "unreachable"}),
        ("a  b\nc", ["a b", "c"], {}),
        ("a b c d e f", ["a", "x", "d", "y", "f", "z"], {1: "missing", 3: "missing", 5: "missing"}),
        ("a b c d", ["x", "b", "q", "r", "a"], {0: "missing", 2: "missing", 3: "unreachable", 4: "unreachable"}),
        ("", ["x"], {0: "missing"}),
        ("a", ["", "a", ""], {}),
    ]
    rows = spark.createDataFrame([(t, s) for t, s, _ in cases], "t string, s array<string>")
    assert [r[0] for r in rows.select(segments.cover_failures("t", F.col("s"))).collect()] == [w for *_, w in cases]
    rows = spark.createDataFrame([("a b c", ["a", "q"]), ("a b", ["a", "b"])], "text string, segments array<string>")
    got = segments.validated(rows).collect()
    assert [(x.valid, x.fail_idx, x.failures) for x in got] == [(False, 1, {1: "missing"}), (True, -1, {})]


def test_importers(spark):
    rows = spark.createDataFrame([("A ", " hello"), ("b", "12.5"), ("a", None), ("B", "2020-01-02 00:00:00"), ("c", "  ")], "m string, text string")
    assert [r.text for r in segments.text_cells(rows).collect()] == ["hello", "12.5", "2020-01-02 00:00:00"]
    typed = spark.createDataFrame([(("text", "2020"),), (("number", "2020"),), (("date", "2019-05-01 00:00:00"),), (("text", " a b "),), (("text", "2019-05-01"),), (None,), (("text", " "),)], "text struct<kind:string,text:string>")
    assert [r.text for r in segments.text_cells(typed).collect()] == ["2020", "a b", "2019-05-01"]
    assert segments.labelled(rows, "m", ["a", " B"]).count() == 4
    recalls = spark.createDataFrame([("a", "s1", "x"), ("a", "s2", "y"), ("z", "s1", "w")], "m string, sub string, text string")
    files = spark.createDataFrame([("a", "s1", "f1"), ("a", "s1", "f1"), ("a", "s2", "f2")], "m string, sub string, file string")
    assert sorted((r.sub, r.file) for r in segments.recalls_of_groups(recalls, files, "m", "sub").collect()) == [("s1", "f1"), ("s2", "f2")]


def test_segment_replies(spark):
    cases = [('["a", "b"]', ["a", "b"]), ('```json\n["a"]\n```', ["a"]), ('```\n["x"]\n```\nmore', ["x"]), ("no", None), ('{"a": 1}', None)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "r string").select(segments.parse_segment_reply("r")).collect()
    assert [x[0] for x in rows] == [w for _, w in cases]


def test_fill_count_offset(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 2, None, 2), (2, 3, "b", 1), (2, 4, None, 2)], "run int, o int, v string, n int")
    assert [x.v for x in segments.forward_fill(rows, ["run"], "o", ["v"]).orderBy("o").collect()] == ["a", "a", "b", "b"]
    assert [x.c for x in segments.count_within(rows, ["run"], "o", "c").orderBy("o").collect()] == [1, 2, 1, 2]
    assert [x.n for x in segments.continue_run(rows, "run", "n").orderBy("o").collect()] == [1, 2, 3, 4]
    made = segments.by_subject(spark.createDataFrame([("g", "s2", 1, "b"), ("g", "s2", 0, "a"), ("g", "s1", 0, "c")], "g string, s string, i int, text string"), ["g"], "s", "i")
    assert {r.s: r.segments for r in made.collect()} == {"s1": ["c"], "s2": ["a", "b"]}
    assert rows.select(F.count("*")).first()[0] == 4


def test_containment_of_very_long_words(spark):
    """A word of 120,000 characters and a piece of 60,000: a short string a character, not all pieces of that length."""
    import time

    from tessera.operators import matching

    r = random.Random(5)
    word = "".join(r.choice("abcdef\U0001f600é") for _ in range(120_000))
    docs = spark.createDataFrame([(1, f"x {word} y"), (2, word[:70_000]), (3, "short")], "d int, text string")
    items = spark.createDataFrame([(1, word[30_000:90_000]), (2, word[5:60_005]), (3, word[100:103]), (4, "hort"), (5, word[:9] + "#" + word[10:40])], "i int, text string")
    began = time.perf_counter()
    got = {(x.d, x.i) for x in matching.containment(docs, items, "d", "i").collect()}
    assert time.perf_counter() - began < 30
    assert got == {(d.d, i.i) for d in docs.collect() for i in items.collect() if i.text in d.text} and {(1, 1), (1, 2), (2, 2), (3, 4)} <= got


def test_containment_equals_a_plain_search(spark):
    from tessera.operators import matching

    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["ab", "abc", "cab", "b", "xabx", "é", "c\tab"]) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(99, None)]
    items = [(i, x) for i, x in enumerate(["ab", "b c", "ab ab", "abc b cab", " ab", "é ", "c\tab b", "", " ", "zz", None, "a", "ab abc b xabx"])]
    got = matching.containment(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "i int, text string"), "d", "i")
    assert sorted(map(tuple, got.collect())) == sorted((d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lexical_matches_of_few_items_exchange_nothing(spark, monkeypatch):
    """Few items are broadcast and counted in the documents' tasks; more go by their rarest words. Both are the same rows."""
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(["w", "Ü", "x y", "é"]) + str(r.randint(0, 9)) for _ in range(r.randint(0, n)))
    docs = spark.createDataFrame([(i, text(30)) for i in range(80)] + [(900, None), (None, "w1 w2"), (901, "")], "d int, text string").repartition(3)
    items = spark.createDataFrame([(f"i{i}", text(6)) for i in range(30)] + [(None, "w1"), ("n", None), ("e", " ")], "i string, text string")
    got = matching.lexical_matches(docs, items, "d", "i", 0.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Join" not in plan  # at most the repartition above
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(matching, "MOST_COUNTS", 1)
    assert rows == sorted(map(tuple, matching.lexical_matches(docs, items, "d", "i", 0.5).collect()))
    monkeypatch.setattr(matching, "MOST_WORDS", -1)
    assert len(rows) > 20 and rows == sorted(map(tuple, matching.lexical_matches(docs, items, "d", "i", 0.5).collect()))
    assert matching.lexical_matches(docs, items.limit(0), "d", "i").count() == 0
    monkeypatch.undo()
    assert matching.lexical_matches(docs, items.limit(0), "d", "i").count() == 0
