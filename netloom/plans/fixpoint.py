"""Iteration to a fixpoint over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.session import discard, materialize


def iterate(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: str = "changed", limit: int = 10_000) -> DataFrame:
    """Apply ``step`` until no row of its result is ``changed``; each round is written and read again, so lineage stays short."""
    state = materialize(start)
    for k in range(1, limit + 1):
        before, state = state, materialize(step(state, k))
        discard(before)
        if not state.where(F.col(changed)).limit(1).count():
            return state.drop(changed)
    raise RuntimeError(f"no fixpoint after {limit} rounds")
