"""Ordered-segment alignment and scoring on Spark DataFrames."""

from tessera.plans.backends import BACKENDS, Backend, get_backend
from tessera.plans.evaluation import evaluate
from tessera.plans.matching import estimate, match

__all__ = ["BACKENDS", "Backend", "estimate", "evaluate", "get_backend", "match"]
