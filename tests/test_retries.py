"""First valid attempts as a stateful stream, against the same figures of the whole table."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators.matching import first_valid, parse_attempts
from tessera.streaming import retries

KEYS = ["story_name", "recall_idx"]
SCHEMA = "story_name string, recall_idx int, attempt int, response string"


def replies(seed=5):
    r = random.Random(seed)
    some = ["<2>", "<NONE>", "<9>", "no idea", "<1, 3>", "", None]
    return [(s, i, k, r.choice(some)) for s in ("a", "b") for i in range(30) for k in range(r.randint(1, 5))]


def result(df):
    return sorted((r.story_name, r.recall_idx, tuple(r.story_idxs), r.n_attempts, r.any_valid) for r in df.collect())


def stream(spark, folder, **kw):
    attempts = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return retries.first_valid_stream(attempts, KEYS, F.lit(4), **kw)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_equals_the_batch_result_after_a_restart(spark, tmp_path):
    rows = replies()
    want = first_valid(parse_attempts(spark.createDataFrame(rows, SCHEMA), F.lit(4)), KEYS, 4)
    random.Random(1).shuffle(rows)  # attempts come in any order
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    third = len(rows) // 3
    add(spark, folder, rows[:third])
    retries.write_verdicts(stream(spark, folder, max_retries=4), out, check).awaitTermination()
    early = spark.read.parquet(out).count()
    add(spark, folder, rows[third : 2 * third])
    add(spark, folder, rows[2 * third :] + rows[:third])  # some are delivered again
    retries.write_verdicts(stream(spark, folder, max_retries=4), out, check).awaitTermination()
    made = spark.read.parquet(out)
    assert 0 < early < made.count()
    assert made.groupBy(*KEYS, "turn").count().where("count > 1").isEmpty()
    assert result(retries.latest(made, KEYS)) == result(want)
    # a run without news adds nothing
    n = made.count()
    retries.write_verdicts(stream(spark, folder, max_retries=4), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == n


def test_status_and_attempts_left(spark, tmp_path):
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    add(spark, folder, [("a", 0, 0, "<2>"), ("a", 1, 1, "<1>"), ("a", 2, 0, "?"), ("a", 2, 1, "?"), ("a", 2, 2, "?"), ("a", 3, 0, "?"), ("a", 3, 7, "<1>"), (None, 4, 0, "<1>"), ("a", 5, None, "<1>")])
    retries.write_verdicts(stream(spark, folder, max_retries=3), out, check).awaitTermination()
    got = {(r.story_name, r.recall_idx): (r.status, r.attempts_left, list(r.story_idxs)) for r in retries.latest(spark.read.parquet(out), KEYS).collect()}
    # attempt 1 alone is no answer yet: attempt 0 may still come; attempt 7 is beyond the limit
    assert got == {("a", 0): ("answered", 0, [1]), ("a", 1): ("open", 2, [0]), ("a", 2): ("exhausted", 0, []), ("a", 3): ("open", 2, []), (None, 4): ("answered", 0, [0])}
    for n in (0, 63):
        with pytest.raises(ValueError, match="max_retries"):
            stream(spark, folder, max_retries=n)


def test_open_segments_are_given_up(spark, tmp_path):
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    add(spark, folder, [("a", 0, 0, "?"), ("a", 1, 0, "<1>")])
    q = retries.write_verdicts(stream(spark, folder, max_retries=3, patience=1), out, check, processingTime="500 milliseconds")
    try:
        end = time.time() + 40
        while time.time() < end:
            time.sleep(1)
            assert q.isActive, q.exception()
            made = spark.read.schema(q_schema(spark)).parquet(out)
            if made.where("status = 'given_up'").count():
                break
    finally:
        q.stop()
    last = {r.recall_idx: r.status for r in retries.latest(made, KEYS).collect()}
    assert last == {0: "given_up", 1: "answered"}


def q_schema(spark):
    return "story_name string, recall_idx int, turn int, status string, story_idxs array<bigint>, n_attempts bigint, attempts_left int, any_valid int"


def test_verdicts_of_many_segments_need_no_python_state(spark, tmp_path):
    """Without patience the state is an aggregation of Spark's: no worker reads the segments one by one."""
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    add(spark, folder, [("a", 0, 1, "<2>")])
    assert "TransformWithState" not in stream(spark, folder, max_retries=3)._jdf.queryExecution().logical().toString()
    retries.write_verdicts(stream(spark, folder, max_retries=3), out, check).awaitTermination()
    add(spark, folder, [("a", 0, 1, "<2>"), ("a", 0, 0, "<3>")])
    retries.write_verdicts(stream(spark, folder, max_retries=3), out, check).awaitTermination()
    rows = spark.read.schema(q_schema(spark)).parquet(out).orderBy("turn").collect()
    assert [(r.status, list(r.story_idxs), r.n_attempts, r.attempts_left) for r in rows] == [("open", [1], 2, 2), ("answered", [2], 1, 0)]
    assert rows[0].turn < rows[1].turn
