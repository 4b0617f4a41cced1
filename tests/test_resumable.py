"""Runs that are stopped and started again."""

import json
import os
import signal
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.plans import backends, resumable


class Counted(backends.Lexical):
    """Counts what it is asked, and stops the run at its nth batch."""

    asked: list[str] = []
    stop_at = None

    def replies(self, prompts, attempt):
        Counted.asked += [r.sub_id for r in prompts.select("sub_id").collect()]
        if Counted.stop_at is not None:
            Counted.stop_at -= 1
            if Counted.stop_at == 0:
                os.kill(os.getpid(), signal.SIGTERM)
                time.sleep(5)
        return super().replies(prompts, attempt)


@pytest.fixture
def tables(spark):
    story = spark.createDataFrame([("s", i, t) for i, t in enumerate(["a storm broke", "the fox ran home", "they slept"])], "story_name string, story_idx int, text string")
    recall = spark.createDataFrame([("s", f"sub{k:02}", i, t) for k in range(12) for i, t in enumerate(["the storm broke over them", "a fox ran home"][: 1 + k % 2])], "story_name string, sub_id string, recall_idx int, text string")
    return story, recall


def test_a_stopped_run_goes_on(spark, tables, tmp_path):
    story, recall = tables
    ledger = str(tmp_path / "ledger")
    Counted.asked, Counted.stop_at = [], 3
    with pytest.raises(KeyboardInterrupt), resumable.interruptible(spark):
        resumable.match_in_batches(story, recall, Counted(max_retries=1), ledger, batch_subjects=3)
    done = {r.sub_id for r in resumable.finished(spark, ledger).select("sub_id").distinct().collect()}
    assert 0 < len(done) < 12
    Counted.asked, Counted.stop_at = [], None
    got = resumable.match_in_batches(story, recall, Counted(max_retries=1), ledger, batch_subjects=3)
    assert not done & set(Counted.asked) and done | set(Counted.asked) == {f"sub{k:02}" for k in range(12)}
    whole = resumable.match_in_batches(story, recall, Counted(max_retries=1), str(tmp_path / "other"))
    key = lambda df: sorted((r.sub_id, r.recall_idx, tuple(r.story_idxs)) for r in df.collect())
    assert key(got) == key(whole) and len(key(got)) == 18
    Counted.asked = []
    changed = recall.withColumn("text", F.when(F.col("sub_id") == "sub03", F.lit("they slept")).otherwise(F.col("text")))
    again = resumable.match_in_batches(story, changed, Counted(max_retries=1), ledger)
    assert set(Counted.asked) == {"sub03"} and {tuple(r.story_idxs) for r in again.where("sub_id = 'sub03'").collect()} == {(2,)}
    assert len(key(again)) == 18
    Counted.asked = []
    resumable.match_in_batches(story, recall, Counted(max_retries=1, window=2), ledger)
    assert len(set(Counted.asked)) == 12  # another setting is another run


def test_a_signal_cancels_running_jobs(spark):
    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    began = time.perf_counter()
    threading.Timer(3, os.kill, (os.getpid(), signal.SIGTERM)).start()
    before = signal.getsignal(signal.SIGTERM)
    with pytest.raises(KeyboardInterrupt), resumable.interruptible(spark):
        spark.range(8).mapInArrow(slow, "id long").count()
    assert time.perf_counter() - began < 15 and signal.getsignal(signal.SIGTERM) is before
    assert spark.range(5).count() == 5


def test_command_line_keeps_what_is_finished(spark, tmp_path, monkeypatch):
    (tmp_path / "story.txt").write_text("a storm broke\nthe fox ran home")
    (tmp_path / "recalls").mkdir()
    for k in range(6):
        (tmp_path / "recalls" / f"s{k}.txt").write_text("the fox ran home")
    args = cli.parser().parse_args(["match", str(tmp_path / "story.txt"), str(tmp_path / "recalls"), "--batch", "2", "--output", str(tmp_path)])
    calls, match = [], resumable.matching.match

    def some(*a, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return match(*a, **kw)

    with monkeypatch.context() as m:
        m.setattr(resumable.matching, "match", some)
        with pytest.raises(KeyboardInterrupt):
            cli.run(args, spark)
    doc = json.loads((tmp_path / "lexical-lines-lines.checkpoint.json").read_text())
    assert doc["progress"]["subject_ids_done"] == sorted(doc["matches"]) and 0 < doc["progress"]["subjects_done"] < 6 == doc["progress"]["subjects_total"]
    assert all(v == [[0, [1]]] for v in doc["matches"].values())
    cli.run(args, spark)
    whole = json.loads((tmp_path / "lexical-lines-lines.json").read_text())
    assert whole["matches"] == {f"s{k}": [[0, [1]]] for k in range(6)}
    assert not list(tmp_path.glob("*.checkpoint.json")) and not list(tmp_path.glob("*.ledger"))
