"""Plans over run timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runframe.operators.aggregates import run_rollup
from runframe.operators.windows import busy_time, max_overlap


def rebase(df: DataFrame, origin: DataFrame | None = None, run: str = "run", start: str = "start", end: str = "end",
           as_of: float | None = None) -> DataFrame:
    """Times relative to each run's earliest start; an open row ends at ``as_of``.

    ``origin`` (run, start) gives the rows the zero comes from, e.g. tasks when ``df`` holds flows;
    a run absent there falls back to its own rows.
    """
    own = df.groupBy(run).agg(F.min(start).alias("_own"))
    zero = own
    if origin is not None:
        zero = own.join(origin.groupBy(run).agg(F.min(start).alias("_origin")), run, "left")
    t0 = F.coalesce("_origin", "_own") if origin is not None else F.col("_own")
    closed = F.coalesce(F.col(end), F.lit(as_of).cast("double"))
    return (df.join(zero.select(run, t0.alias("_t0")), run)
            .withColumns({"rel_start": F.col(start) - F.col("_t0"), "rel_end": closed - F.col("_t0")}).drop("_t0"))


def run_report(tasks: DataFrame, totals: DataFrame) -> DataFrame:
    """Per run and node: the run's phase and makespan, the node's busy share and deepest overlap."""
    nodes = busy_time(tasks, ["run", "node"]).join(max_overlap(tasks, ["run", "node"]), ["run", "node"])
    return nodes.join(run_rollup(tasks, totals).select("run", "phase", "makespan", "n_tasks", "n_failed"), "run")
