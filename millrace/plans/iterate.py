"""Loops over DataFrames with bounded lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.runtime import cut


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], times: int, checkpoint_every: int = 5) -> DataFrame:
    """step(state, k) for k = 0, 1, ...; each checkpoint_every-th state is computed and stored in the shared folder."""
    for k in range(times):
        state = step(state, k)
        if checkpoint_every and (k + 1) % checkpoint_every == 0 and k + 1 < times:
            state = cut(state)
    return state
