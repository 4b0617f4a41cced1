"""Prompts, backends, retries, evaluation, streaming and the command line."""

import json

import pytest
from pyspark.sql import functions as F

import tessera
from tessera import cli
from tessera.plans import backends, evaluation, matching, prompts
from tessera.streaming import progress

STORY = [("scenes", 0, "The fox ran home "), ("scenes", 1, "A storm broke"), ("scenes", 2, "They all slept well")]
RECALL = [("scenes", "sub01", 0, "then a storm broke out"), ("scenes", "sub01", 1, "and the fox ran home"), ("scenes", "sub01", 2, "nothing else")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(STORY, "story_name string, story_idx int, text string"), spark.createDataFrame(RECALL, "story_name string, sub_id string, recall_idx int, text string")


def replay(spark, replies, **kw):
    rows = [("scenes", "sub01", i, k, x) for i, r in enumerate(replies) for k, x in enumerate(r)]
    return backends.Replay(spark.createDataFrame(rows, "story_name string, sub_id string, recall_idx int, attempt int, response string"), ["story_name", "sub_id", "recall_idx"], **kw)


def result(matches):
    return {r.recall_idx: list(r.story_idxs) for r in matches.collect()}


def test_prompts(tables):
    for name, t in prompts.TEMPLATES.items():
        rows = {r.recall_idx: r for r in prompts.match_prompts(*tables, window=1, name=name).collect()}
        p = rows[1].prompt
        assert "1. The fox ran home\n2. A storm broke\n3. They all slept well" in p
        assert ("The fox ran home A storm broke They all slept well" in p) == t.story
        assert f"then a storm broke out\n{t.start}and the fox ran home{t.end}\nnothing else" in p
        assert ("say briefly" in p) == t.reasons and "<NONE>" in p and rows[0].n_story == 3
    assert prompts.template(None) is prompts.TEMPLATES["primary"]
    with pytest.raises(ValueError, match="unknown prompt"):
        prompts.template("other")


def test_retries(spark, tables):
    backend = replay(spark, [["bad", "bad", "<1>"], ["<999>", "<3, 1>", "x"], ["bad", "bad", "bad"]], max_retries=3)
    matches, log = matching.match(*tables, backend)
    assert result(matches) == {0: [0], 1: [0, 2], 2: []}
    assert {(r.recall_idx, r["count"]) for r in log.groupBy("recall_idx").count().collect()} == {(0, 3), (1, 2), (2, 3)}
    assert set(log.columns) >= {"prompt", "response", "parsed", "valid", "attempt"} and log.where("prompt is null").count() == 0
    never = replay(spark, [["<1>"]] * 3, max_retries=0)  # asks nothing
    matches, log = matching.match(*tables, never)
    assert result(matches) == {0: [], 1: [], 2: []} and log.count() == 0
    none, log = matching.match(tables[0], tables[1].limit(0), backend)
    assert none.count() == 0 and log.count() == 0


def test_lexical_backend(tables):
    for name in prompts.TEMPLATES:
        assert result(matching.match(*tables, tessera.get_backend("lexical", prompt=name))[0]) == {0: [1], 1: [0], 2: []}


def test_adapter_is_called_in_batches(tables):
    def make(options):
        def ask(texts):
            assert len(texts) <= 2
            return ["<2>" if options["attempt"] else "?" for _ in texts]

        return ask

    matches, log = matching.match(*tables, backends.Model(make=make, batch=2))
    assert result(matches) == {0: [1], 1: [1], 2: [1]} and log.count() == 6


CLIENTS = {
    "anthropic": """
class _R:
    def __init__(self, t): self.content = [type("B", (), {"text": t})()]; self.usage = type("U", (), {"input_tokens": 7, "output_tokens": 2})()
class Anthropic:
    def __init__(self, api_key): assert api_key == "k"; self.messages = self
    def create(self, model, max_tokens, messages): assert model == "m" and messages[0]["role"] == "user"; return _R("<2>")
""",
    "openai": """
class OpenAI:
    def __init__(self, api_key): assert api_key == "k"; self.responses = self
    def create(self, model, input): return type("R", (), {"output_text": "<1>", "usage": type("U", (), {"input_tokens": 5, "output_tokens": 1})()})()
""",
    "vllm": """
class SamplingParams:
    def __init__(self, **kw): assert kw["temperature"] == 0.0
class LLM:
    def __init__(self, model): assert model == "m"
    def chat(self, messages, how, use_tqdm): return [type("O", (), {"outputs": [type("T", (), {"text": "<3>", "token_ids": [1, 2]})()], "prompt_token_ids": [1, 2, 3]})() for _ in messages]
""",
    "transformers": """
class _P:
    tokenizer = type("T", (), {"encode": staticmethod(lambda x: x.split())})()
    def __call__(self, chats, **kw): assert kw["batch_size"] == len(chats); return [[{"generated_text": "<2, 3>"}] for _ in chats]
def pipeline(task, model, token, device_map): assert task == "text-generation"; return _P()
""",
    "mlx_lm": """
def load(name): return None, type("T", (), {"encode": staticmethod(lambda x: x.split()), "apply_chat_template": staticmethod(lambda c, add_generation_prompt: [1, 2])})()
def generate(model, tokenizer, prompt, max_tokens): return "<1>"
""",
}


def test_clients(spark, tables, tmp_path, monkeypatch):
    """Each client is imported on the workers and asked as its interface has it; usage comes back with the replies."""
    import sys

    for name, code in CLIENTS.items():
        (tmp_path / f"{name}.py").write_text(code)
    where = str(tmp_path)
    want = {"anthropic": [1], "openai": [0], "cuda": [2], "huggingface": [1, 2], "mac": [0]}
    for name, story in want.items():
        backend = tessera.get_backend(name, model="m", **({"api_key": "k"} if name in ("anthropic", "openai", "huggingface") else {}))
        real = backend.make

        def make(options, real=real):
            sys.path.insert(0, where)
            return real(options)

        backend.make = make
        matches, log = matching.match(*tables, backend)
        assert result(matches) == {0: story, 1: story, 2: story}
        assert log.where("in_tokens > 0 and out_tokens > 0 and seconds >= 0").count() == 3
    spent = matching.usage(log, "example-small")
    assert spent["in_tokens"] == 6 and spent["out_tokens"] == 3 and spent["tokens_per_second"] > 0 and spent["cost"] == pytest.approx((6 * 0.5 + 3 * 2.0) / 1e6)


def test_registry_and_keys(monkeypatch):
    with pytest.raises(ValueError, match="lexical"):
        tessera.get_backend("nobody")
    for name, key in (("anthropic", "ANTHROPIC_API_KEY"), ("openai", "OPENAI_API_KEY"), ("huggingface", "HF_TOKEN")):
        monkeypatch.delenv(key, raising=False)
        with pytest.raises(ValueError, match=key):
            tessera.get_backend(name, model="m")
        assert tessera.get_backend(name, model="m", api_key="given").api_key == "given"
        monkeypatch.setenv(key, "env")
        assert tessera.get_backend(name, model="m").api_key == "env"
        assert tessera.get_backend(name, model="m", max_retries=0).max_retries == 0
        with pytest.raises(ValueError, match="needs a model"):
            tessera.get_backend(name)
    assert tessera.get_backend("cuda", model="m", max_retries=0).max_retries == 10


def test_dry_run_asks_nothing(tables):
    class Never(backends.Backend):
        def replies(self, rows, attempt):
            raise AssertionError

    row = matching.estimate(*tables, Never()).first()
    assert row.n_prompts == 3 and row.est_in_tokens > 100


def test_evaluate(spark, tables):
    ratings = spark.createDataFrame([("scenes", "sub01", 0, [1]), ("scenes", "sub01", 1, [0]), ("scenes", "sub01", 2, [2])], "story_name string, sub_id string, recall_idx int, story_idxs array<bigint>")
    runs = [replay(spark, [["<2>"], ["<1>"], ["<NONE>"]]), replay(spark, [["<2>"], ["<3>"], ["<3>"]])]
    out = evaluation.evaluate(*tables, ratings, runs)
    first, second = out["scored"].orderBy("repeat_idx").collect()
    assert (first.tp, first.fp, first.fn, first.tn) == (2, 0, 1, 6) and (second.tp, second.fp, second.fn, second.tn) == (2, 1, 1, 5)
    assert out["macro"].first().precision == pytest.approx((1 + 2 / 3) / 2)
    assert out["pairwise_f1"].first()[0] == pytest.approx(2 * 1 / 5)
    assert out["alpha"].first()[0] is not None and out["overall"].first().recall == pytest.approx(2 / 3)
    marked = evaluation.correct(out["attempts"].where("repeat_idx = 0"), ratings, ["story_name", "sub_id", "recall_idx"])
    assert {r.recall_idx: r.correct for r in marked.collect()} == {0: True, 1: True, 2: False}
    unrated = ratings.withColumn("story_idxs", F.array().cast("array<bigint>"))
    with pytest.raises(Exception, match="no recall"):
        evaluation.evaluate(*tables, unrated, runs[:1])["macro"].collect()
    with pytest.raises(Exception, match="no human"):
        evaluation.evaluate(*tables, unrated, runs[:1], strict=True)["macro"].collect()


def benchmark(spark, tables, tmp_path, matches):
    """A test set of one story on disk."""
    from tessera.sources import sinks

    ratings = spark.createDataFrame([("sub01", i, x) for i, x in enumerate(matches)], "sub_id string, recall_idx int, story_idxs array<bigint>")
    sinks.write_benchmark(*tables, ratings, f"{tmp_path}/alice", "scenes", "events")
    top = tmp_path / "alice"
    (top / "dataset.json").write_text('{"stories": ["scenes"]}')
    for part, name in zip(("transcripts", "recalls", "matches"), evaluation.TESTSETS["alice"], strict=True):
        (top / "scenes" / part / "events.json").rename(top / "scenes" / part / name)


class Counting(backends.Lexical):
    asked = 0

    def replies(self, prompts, attempt):
        Counting.asked += 1
        return super().replies(prompts, attempt)


def test_run_evaluation_writes_its_folder(spark, tables, tmp_path):
    benchmark(spark, tables, tmp_path, [[1], [0], [2]])
    run = lambda **kw: evaluation.run_evaluation(spark, str(tmp_path), "alice", lambda: Counting(), output=f"{tmp_path}/out", **kw)
    dry = run(dry_run=True)
    assert dry["n_prompts"] == 3 and Counting.asked == 0 and not (tmp_path / "out").exists()
    done = run()
    doc = json.loads(open(f"{done['folder']}/results.json").read())
    assert doc["testset"] == "alice" and {"matcher_name", "f1_macro", "precision_macro", "recall_macro", "accuracy_macro", "pearsonr_macro"} <= set(doc)
    assert doc["precision_macro"] == 1 and doc["recall_macro"] == pytest.approx(2 / 3) and doc["f1_macro"] == pytest.approx(0.8)
    check = json.loads(open(f"{done['folder']}/checkpoint.json").read())
    assert check["checkpoint"] is True and check["progress"]["last_completed_repeat_index"] == 0 and check["precisions"] == {"scenes_sub01": [1.0]}
    assert spark.read.parquet(f"{done['folder']}/cells").count() == 2 and spark.read.parquet(f"{done['folder']}/human_cells").count() == 3
    assert sorted((r.recall_idx, r.correct) for r in spark.read.parquet(f"{done['folder']}/attempts").collect()) == [(0, True), (1, True), (2, False)]
    done = run(repeat_mode=True, repeats=2)
    doc = json.loads(open(f"{done['folder']}/results.json").read())
    assert doc["n_repeats"] == 2 and doc["f1s"] == {"scenes_sub01": [pytest.approx(0.8)] * 2} and doc["mean_pairwise_f1"] == 1 and doc["krippendorff_alpha"] == 1
    with pytest.raises(ValueError, match="Invalid testset"):
        evaluation.run_evaluation(spark, str(tmp_path), "other", Counting)


def test_unrated_recalls_are_not_asked(spark, tables, tmp_path):
    benchmark(spark, tables, tmp_path, [[], [], []])
    before = Counting.asked
    for mode in (False, True):
        with pytest.raises(ValueError, match="no recall|no human"):
            evaluation.run_evaluation(spark, str(tmp_path), "alice", lambda: Counting(), output=f"{tmp_path}/out", repeat_mode=mode)
    assert Counting.asked == before and not list(tmp_path.rglob("results.json"))


def test_segmentation_by_a_model(spark, tmp_path):
    from tessera.plans.segmentation import segment_strictly, segment_texts

    rows = spark.createDataFrame([("a", "One. Two."), ("b", "One. Two."), ("c", "x"), ("d", None)], "stem string, text string")
    replies = spark.createDataFrame([("a", 0, '```json\n["One.", "Two."]\n```'), ("b", 0, '["Two.", "One."]'), ("c", 0, "no"), ("d", 0, "[]")], "stem string, attempt int, response string")
    backend = backends.Replay(replies, ["stem"])
    got = {r.stem: (list(r.segments), r.status, r.fail_idx, r.failures) for r in segment_texts(rows, ["stem"], backend).collect()}
    assert got == {"a": (["One.", "Two."], "ok", -1, {}), "b": (["Two.", "One."], "invalid", 0, {0: "missing"}), "c": ([], "unparsed", -1, {}), "d": ([], "ok", -1, {})}
    assert segment_strictly(rows.where("stem = 'a'"), ["stem"], backend).first().segments == ["One.", "Two."]
    with pytest.raises(Exception, match="segmentation of b is invalid"):
        segment_strictly(rows.where("stem = 'b'"), ["stem"], backend).collect()


def test_interrupt_leaves_a_checkpoint(spark, tmp_path, monkeypatch):
    (tmp_path / "story.txt").write_text("\n".join(x[2] for x in STORY))
    (tmp_path / "sub01.txt").write_text("\n".join(x[3] for x in RECALL))
    args = cli.parser().parse_args(["match", str(tmp_path / "story.txt"), str(tmp_path / "sub01.txt")])

    def stop(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(matching, "match", stop)
        with pytest.raises(KeyboardInterrupt):
            cli.run(args, spark)
    doc = json.loads((tmp_path / "lexical-lines-lines.checkpoint.json").read_text())
    assert doc["checkpoint"] is True and doc["progress"]["reason"] == "KeyboardInterrupt" and doc["progress"]["subjects_total"] == 1
    named = cli.parser().parse_args(["match", str(tmp_path / "story.txt"), str(tmp_path / "sub01.txt"), "--story-name", "own", "--story-segmentation", "scenes", "--recall-segmentation", "clauses", "--model", "m"])
    doc = json.loads(open(cli.run(named, spark).removeprefix("file:")).read())
    assert (doc["story_name"], doc["story_segmentation"], doc["recall_segmentation"], doc["model_name"]) == ("own", "scenes", "clauses", "m")
    cli.run(args, spark)
    assert not list(tmp_path.glob("*.checkpoint.json"))


def test_stream_resumes(spark, tables, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "s1.txt").write_text("a storm broke\n\nthe fox ran home")
    where = (str(folder), tessera.get_backend("lexical"), str(tmp_path / "out"), str(tmp_path / "check"))
    progress.match_stream(spark, tables[0], *where).awaitTermination()
    (folder / "s2.txt").write_text("they all slept well")
    progress.match_stream(spark, tables[0], *where).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.sub_id, r.recall_idx, tuple(r.story_idxs), r.batch) for r in rows) == [("s1", 0, (1,), 0), ("s1", 1, (0,), 0), ("s2", 0, (2,), 1)]
    done = progress.progress(spark, str(tmp_path / "out"), 3).first()
    assert (done.subjects_total, done.subjects_done, list(done.subject_ids_done)) == (3, 2, ["s1", "s2"])


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "story.txt").write_text("\n".join(x[2] for x in STORY))
    (tmp_path / "in" / "sub01.txt").write_text("\n".join(x[3] for x in RECALL))
    args = cli.parser().parse_args(["match", str(tmp_path / "story.txt"), str(tmp_path / "in")])
    path = cli.run(args, spark)
    assert path.endswith(f"{tmp_path}/lexical-lines-lines.json")
    doc = json.loads((tmp_path / "lexical-lines-lines.json").read_text())
    assert doc["matches"] == {"sub01": [[0, [1]], [1, [0]], [2, []]]}
    with pytest.raises(FileExistsError):
        cli.run(args, spark)
    dry = cli.parser().parse_args(["match", str(tmp_path / "story.txt"), str(tmp_path / "in"), "--dry-run"])
    assert cli.run(dry, spark)["n_prompts"] == 3
    cli.run(cli.parser().parse_args(["segment", str(tmp_path / "in"), str(tmp_path / "seg"), "--by", "lines"]), spark)
    assert spark.read.csv(str(tmp_path / "seg"), header=True).count() == 3
