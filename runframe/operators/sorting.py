"""Orderings of runs, repetitions and cells, and top values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import names
from runframe.operators.windows import top_k


def sort_runs(df: DataFrame, key: str, desc: bool = False, ties: str = "run_id") -> DataFrame:
    """Sort by ``key`` counting a missing value as infinite: last ascending, first descending."""
    column = F.col(key)
    return df.orderBy(column.desc_nulls_first() if desc else column.asc_nulls_last(), ties)


def natural_rep(col: str) -> list[Column]:
    """Sort keys that put numeric labels first by number, then the text labels."""
    number = F.when(F.col(col).rlike(r"^\d+$"), F.col(col).try_cast("bigint"))
    return [number.isNull(), number, F.col(col)]


def cell_sort_key(col: str) -> list[Column]:
    """Sort keys of a cell name such as ``n4-d60-jpg``: cameras, duration, jpg before png."""
    def number(pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(F.col(col), pattern, 1), F.lit("")).try_cast("int"), F.lit(0))

    return [number(r"(?:^|-)n(\d+)"), number(r"(?:^|-)d(\d+)"), F.col(col).contains("png").cast("int"), F.col(col)]


def top_values(df: DataFrame, col: str, k: int = 5, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` largest values, numbered."""
    return top_k(df.where(F.col(col).isNotNull()), None, k, [f"-{col}", *ties]).select("rank", col, *names(ties))


def by_created(df: DataFrame, desc: bool = False, n: int | None = None, ties: str = "run_id") -> DataFrame:
    column, tie = F.col("created_at"), F.col(ties)
    out = df.orderBy(column.desc() if desc else column.asc(), tie.desc() if desc else tie.asc())
    return out if n is None else out.limit(n)
