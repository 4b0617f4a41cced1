"""What a run uses, observed while its attempts are written: no second scan of them."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.sources.shared import stash

_SUMS = ("n_attempts", "n_valid", "n_metered", "in_tokens", "out_tokens", "metered_seconds")


def peak_mb() -> float | None:
    """The most memory this process has held, in MB; None where the system does not tell."""
    try:
        import resource
    except ImportError:
        return None
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (2**20 if sys.platform == "darwin" else 2**10)


class Meter:
    """Totals over all attempts that were written through it, one observation a write.

    n_attempts, n_valid: all attempts, those with a valid reply. n_metered, in_tokens, out_tokens: of attempts whose
    backend reports tokens. tokens_per_second: their tokens out for each second of a worker's
    waiting; None if no time was told. peak_mb: of the worker that held most; None where none told. Nothing written: counts of 0.
    A task that is run again counts once, as the observation is of the write's own tasks.
    """

    def __init__(self):
        self.rounds: list[dict] = []

    def written(self, attempts: DataFrame) -> DataFrame:
        """attempts (valid, in_tokens, out_tokens, seconds, peak_mb), in the shared folder."""
        metered, seen = F.col("in_tokens").isNotNull(), Observation()
        out = stash(
            attempts.observe(
                seen,
                F.count(F.lit(1)).alias("n_attempts"),
                F.count_if("valid").alias("n_valid"),
                F.count_if(metered).alias("n_metered"),
                F.sum("in_tokens").alias("in_tokens"),
                F.sum(F.when(metered, F.col("out_tokens"))).alias("out_tokens"),
                F.sum(F.when(metered, F.col("seconds"))).alias("metered_seconds"),
                F.max("peak_mb").alias("peak_mb"),
            )
        )
        self.rounds.append(seen.get)
        return out

    def totals(self, price_in: float = 0.0, price_out: float = 0.0) -> dict:
        """The totals as one record; prices are per million tokens."""
        out = {c: sum(r.get(c) or 0 for r in self.rounds) for c in _SUMS}
        seconds, peaks = out.pop("metered_seconds"), [r["peak_mb"] for r in self.rounds if r.get("peak_mb") is not None]
        cost = (out["in_tokens"] * price_in + out["out_tokens"] * price_out) / 1e6
        return {**out, "seconds": float(seconds), "tokens_per_second": out["out_tokens"] / seconds if seconds else None, "peak_mb": max(peaks, default=None), "cost": cost}
