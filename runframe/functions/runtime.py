"""Session helpers shared by every operator."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_GROUP_CONF = "spark.runframe.hotGroupRows"
HOT_GROUP_ROWS = 2_000_000
#: A group is also too large for one task only beyond this part of all rows, which bounds the number of such groups.
HOT_PARTS_CONF = "spark.runframe.hotGroupParts"
HOT_PARTS = 10_000


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators are written for (all can be set on a live session).

    Functions of this package travel to the workers by value, so the cluster needs no installed copy.
    """
    cloudpickle.register_pickle_by_value(sys.modules["runframe"])
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "500",  # a task a folder costs the driver more than the listing
    }.items():
        spark.conf.set(key, value)
    return spark


def names(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def order_columns(order: str | Sequence[str]) -> list[Column]:
    """``"a"`` sorts ascending, ``"-a"`` descending; nulls go last in both."""
    out = []
    for item in names(order):
        out.append(F.col(item[1:]).desc_nulls_last() if item.startswith("-")
                   else F.col(item).asc_nulls_last())
    return out


def reverse(order: str | Sequence[str]) -> list[str]:
    return [item[1:] if item.startswith("-") else "-" + item for item in names(order)]


def same(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Null-safe equality of two frames on ``keys``."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def prepare_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-checkpoint-")
    context.setCheckpointDir(folder)


def work_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, shared by all executors."""
    prepare_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage so that loops and reuse see one fixed result."""
    prepare_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Share out an input of fewer splits than cores before costly row work; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
