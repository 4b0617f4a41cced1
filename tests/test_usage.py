"""Usage observed while attempts are written, against stand-ins whose use is known."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import backends, matching
from tessera.plans.usage import Meter, peak_mb

STORY = [("s", i, x) for i, x in enumerate(["a fox", "a storm", "they slept"])]
RECALL = [("s", "sub", i, f"part {i}") for i in range(20)]
LOG = "valid boolean, in_tokens long, out_tokens long, seconds double, peak_mb double"


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(STORY, "story_name string, story_idx int, text string"), spark.createDataFrame(RECALL, "story_name string, sub_id string, recall_idx int, text string")


def make(options):
    def ask(texts):
        held = bytearray(60 << 20)  # noqa: F841
        held[::4096] = b"x" * len(held[::4096])
        return [("<2>" if options["attempt"] else "?", 7, 2) for _ in texts]

    return ask


def test_totals_of_a_run_with_a_retry(tables):
    meter = Meter()
    matches, log = matching.match(*tables, backends.Model(make=make), meter=meter)
    got, again = meter.totals(0.5, 2.0), matching.usage(log)
    assert [got[c] for c in ("n_attempts", "n_valid", "n_metered", "in_tokens", "out_tokens")] == [40, 20, 40, 280, 80]
    assert got["cost"] == pytest.approx((280 * 0.5 + 80 * 2.0) / 1e6) and got["tokens_per_second"] == pytest.approx(again["tokens_per_second"])
    assert got["peak_mb"] > 60 and got["peak_mb"] == log.agg(F.max("peak_mb")).first()[0]
    assert len(meter.rounds) == 2 and matches.count() == 20


def test_without_usage_and_without_rows(spark, tables):
    meter = Meter()
    assert meter.totals()["n_attempts"] == 0 and meter.totals()["peak_mb"] is None
    matching.match(*tables, backends.get_backend("lexical"), meter=meter)
    got = meter.totals()
    assert got["n_attempts"] == 20 and got["n_metered"] == got["in_tokens"] == got["seconds"] == 0 and got["tokens_per_second"] is None
    meter.written(spark.createDataFrame([], LOG))
    meter.written(spark.createDataFrame([(None, None, 5, 1.0, None)], LOG))  # no tokens in: its other figures are not metered
    assert {**meter.totals(), "n_attempts": 20} == got and meter.totals()["n_attempts"] == 21


def test_peak_memory_is_told():
    assert peak_mb() > 10
