"""Sorted streams of grouped rows inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from runframe.functions.runtime import order_columns


def map_sorted(df: DataFrame, group: Sequence[str], order: Sequence[str],
               fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType) -> DataFrame:
    """Run ``fn`` over the rows of each partition, sorted by ``group`` and then ``order``.

    All rows of a group are in one partition and follow one another, so small groups share Arrow
    batches and a large group passes through as a stream. The partition count is fixed, and above the
    usual one, because the work per byte is high: small inputs must not be merged into one task and a few
    busy groups should not meet in one.
    """
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(n, *group).sortWithinPartitions(*group, *order_columns(order))
    return placed.mapInPandas(fn, schema)


def starts(batch: pd.DataFrame, columns: Sequence[str], previous: tuple | None) -> np.ndarray:
    """True where a row begins a new run of equal ``columns``; ``previous`` is the row before the batch."""
    fresh = np.zeros(len(batch), bool)
    for position, name in enumerate(columns):
        values = batch[name].to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
        fresh[0] |= previous is None or values[0] != previous[position]
    return fresh


def whole_runs(batches: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut so that no run of equal ``columns`` is split, with the first row number of each run."""
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        begins = np.flatnonzero(starts(rows, columns, None))
        last = begins[-1]
        held = rows.iloc[last:].reset_index(drop=True)
        if last:
            yield rows.iloc[:last], begins[:-1]
    if held is not None:
        yield held, np.array([0])
