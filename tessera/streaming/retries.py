"""Attempts as they arrive: a stream that keeps, for each segment, which attempts were made and the first valid reply."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.functions import codes
from tessera.operators.matching import parse_attempts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "seen bigint, first int, story_idxs array<bigint>, turn int"
_VERDICT = "turn int, status string, story_idxs array<bigint>, n_attempts bigint, attempts_left int, any_valid int"
#: Attempts are bits of one long.
MOST_RETRIES = 62


class Retries(StatefulProcessor):
    """The state of a segment: attempts seen (a bit each), the first valid one with its reply, and how often a verdict was given.

    An attempt that is delivered again changes nothing; attempts may arrive in any order. A
    segment gives a verdict in each batch that changes it, and one more, `given_up`, if it is
    still open when `patience` seconds pass without a new attempt.
    """

    def __init__(self, keys: list[str], max_retries: int, patience: float | None):
        self.keys, self.max_retries, self.patience = keys, max_retries, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("attempts", _STATE)

    def _held(self):
        held = self.state.get() if self.state.exists() else None
        return (0, -1, [], 0) if held is None else (held[0], held[1], list(held[2]), held[3])

    def _status(self, seen: int, first: int) -> str:
        if first >= 0 and seen & ((1 << first) - 1) == (1 << first) - 1:
            return "answered"
        if seen == (1 << self.max_retries) - 1:
            return "exhausted"
        return "open"

    def _verdict(self, key, seen, first, story_idxs, turn, status) -> Row:
        n = first + 1 if first >= 0 else seen.bit_count()
        left = 0 if status != "open" else self.max_retries - seen.bit_count()
        given = {"turn": turn, "status": status, "story_idxs": story_idxs, "n_attempts": n, "attempts_left": left, "any_valid": int(first >= 0)}
        return Row(**dict(zip(self.keys, key, strict=True)), **given)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = seen, first, story_idxs, turn = self._held()
        for r in rows:
            if seen >> r.attempt & 1:
                continue
            seen |= 1 << r.attempt
            if r.valid and (first < 0 or r.attempt < first):
                first, story_idxs = r.attempt, list(r.story_idxs)
        if seen == before[0]:
            return
        status = self._status(seen, first)
        self.state.update((seen, first, story_idxs, turn + 1))
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if status == "open":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.patience * 1000))
        yield self._verdict(key, seen, first, story_idxs, turn + 1, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen, first, story_idxs, turn = self._held()
        self.state.update((seen, first, story_idxs, turn + 1))
        yield self._verdict(key, seen, first, story_idxs, turn + 1, "given_up")

    def close(self) -> None:
        pass


def first_valid_stream(attempts: DataFrame, keys: list[str], n_story, max_retries: int = 10, patience: float | None = None) -> DataFrame:
    """A stream of (keys, attempt, response) to one of verdicts: keys, turn, status (open, answered, exhausted, given_up), story_idxs, n_attempts, attempts_left, any_valid.

    Replies are parsed before the exchange, so a row that is shuffled holds numbers only. Without patience the
    state is an aggregation (attempts seen as bits, the least valid one with its reply), and a
    turn is the batch that gave the verdict. With it there are timers: a segment's rows are read one by one, and a
    segment with very many deliveries costs time in its task, not memory.
    """
    if not 0 < max_retries <= MOST_RETRIES:
        raise ValueError(f"max_retries must be 1 to {MOST_RETRIES}")
    parsed = parse_attempts(attempts.where(F.col("attempt").between(0, max_retries - 1)), n_story)
    valid = F.coalesce("valid", F.lit(False))
    rows = parsed.select(*keys, F.col("attempt").cast("int").alias("attempt"), valid.alias("valid"), F.when(valid, codes.zero_based("parsed")).alias("story_idxs"))
    if patience is None:
        return _aggregated(rows, keys, max_retries)
    out = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(_VERDICT).fields)
    return rows.groupBy(*keys).transformWithState(Retries(keys, max_retries, patience), out, "Append", "ProcessingTime")


def _aggregated(rows: DataFrame, keys: list[str], max_retries: int) -> DataFrame:
    """Verdicts of all attempts so far, for the segments of each batch; an attempt that is delivered again changes nothing."""
    one = F.lit(1).cast("long")
    bit = F.expr("shiftleft(1L, attempt)")
    first = F.min(F.when(F.col("valid"), F.struct("attempt", "story_idxs")))
    held = rows.groupBy(*keys).agg(F.bit_or(bit).alias("_seen"), first.alias("_first"))
    seen, at = F.col("_seen"), F.col("_first")["attempt"]
    before = F.expr("shiftleft(1L, _first.attempt)") - one
    status = F.when(seen.bitwiseAND(before) == before, "answered").when(seen == (1 << max_retries) - 1, "exhausted").otherwise("open")
    n_seen = F.bit_count(seen)
    told = held.select(
        *keys,
        F.lit(0).alias("turn"),
        status.alias("status"),
        F.coalesce(F.col("_first")["story_idxs"], F.array().cast("array<bigint>")).alias("story_idxs"),
        F.coalesce(at + 1, n_seen).cast("long").alias("n_attempts"),
        F.when(status == "open", F.lit(max_retries) - n_seen).otherwise(0).cast("int").alias("attempts_left"),
        at.isNotNull().cast("int").alias("any_valid"),
    )
    told._by_batch = True
    return told


def write_verdicts(verdicts: DataFrame, output: str, checkpoint: str, **trigger):
    """A query that appends verdicts to a folder of Parquet; started again with its checkpoint it goes on where it was, state included. Ends with what is there unless a trigger is given."""

    def batch(rows: DataFrame, number: int) -> None:
        # a folder of its own, so a batch that is repeated after a failure replaces itself
        rows.drop("turn").write.mode("overwrite").parquet(f"{output}/turn={number}")

    conf, name = verdicts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)  # read when the query starts
    try:
        writer = verdicts.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        if getattr(verdicts, "_by_batch", False):
            return writer.outputMode("update").foreachBatch(batch).start()
        return writer.format("parquet").start(output)
    finally:
        conf.set(name, before)


def latest(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The last verdict of each segment, from the table that write_verdicts() makes."""
    rest = [c for c in verdicts.columns if c not in keys and c != "turn"]
    return verdicts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "turn").alias("last")).select(*keys, "last.*")
