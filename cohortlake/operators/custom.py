"""Calculations and transformations supplied by the user."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame


def calculate(df: DataFrame, aggregates: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """A user aggregate given as column expressions."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def calculate_with_state(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    update: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    state_schema: str,
    finish: Callable[[pd.DataFrame], pd.DataFrame],
    result_schema: str,
) -> DataFrame:
    """A user aggregate in Python as accumulator and finish.

    ``update`` turns a batch of rows into one state row per key, ``merge`` turns state rows into
    one per key, ``finish`` turns a merged state into the result. Each task merges its own states
    as it goes, so only one state per key and task is shuffled, never the rows of a key.
    """

    def states(batches):
        held = None
        for pdf in batches:
            if len(pdf):
                new = update(pdf)
                held = new if held is None else merge(pd.concat([held, new], ignore_index=True))
        if held is not None:
            yield held

    return (
        df.select(*keys, *columns)
        .mapInPandas(states, state_schema)
        .groupBy(*keys)
        .applyInPandas(lambda pdf: finish(merge(pdf)), result_schema)
    )


def apply_steps(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A chain of user transformations, each from table to table."""
    for step in steps:
        df = df.transform(step)
    return df
