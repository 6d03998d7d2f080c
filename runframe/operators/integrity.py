"""Content digests, put outcomes, stuck transfers and result checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import names
from runframe.operators.scan import scan


def block_manifest(blobs: DataFrame, id: str = "path", content: str = "content", block: int = 65536) -> DataFrame:
    """SHA-256 of every ``block`` bytes of each blob.

    The digests are made inside the row, so the content itself is never copied per block.
    """
    size = F.length(content)
    starts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    digests = F.transform(starts, lambda i: F.sha2(F.substr(F.col(content), i * block + 1, F.lit(block)), 256))
    return blobs.select(id, F.posexplode(digests).alias("block", "sha256"))


def content_digest(blobs: DataFrame, id: str = "path", content: str = "content") -> DataFrame:
    return blobs.select(id, F.sha2(F.col(content), 256).alias("sha256"), F.length(content).cast("long").alias("size"))


def classify_puts(log: DataFrame, key: str | Sequence[str], order: str, claimed: str = "claimed",
                  computed: str = "computed") -> DataFrame:
    """Outcome of each put: ``ok`` (installed), ``idempotent``, ``conflict`` or ``mismatch``.

    A put without a claim always installs. A claimed put installs only while nothing is installed
    and its content matches; afterwards it is compared with the installed digest.
    """
    keys = names(key)
    open_install = F.when(F.col(claimed).isNull(), F.col(computed))
    seen = scan(log, keys, order, {"_unclaimed": ("last_before", open_install)})
    first = seen.where(F.col("_unclaimed").isNull() & (F.col(claimed) == F.col(computed))).groupBy(*keys).agg(
        F.min(order).alias("_first_at"), F.min_by(claimed, order).alias("_first"))
    earlier = F.when(F.col("_first_at") < F.col(order), F.col("_first"))
    installed = F.coalesce("_unclaimed", earlier)
    outcome = (F.when(F.col(claimed).isNull(), "ok")
               .when(installed.isNull(), F.when(F.col(claimed) == F.col(computed), "ok").otherwise("mismatch"))
               .when(installed == F.col(claimed), "idempotent").otherwise("conflict"))
    return seen.join(first, keys, "left").select(
        *[F.col(c) for c in log.columns], outcome.alias("outcome"))


def stuck_transfers(transfers: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("run", "task")) -> DataFrame:
    """Open transfers after a restart: resumable, or failed with the reason.

    ``transfers``: keys, consumer, state, host (null when its entry is missing). ``outputs``: keys of
    outputs present locally.
    """
    keys = names(keys)
    local = outputs.select(*keys).distinct().withColumn("_here", F.lit(True))
    open_ = transfers.where(F.col("state").isin("Pending", "Transferring")).join(local, keys, "left")
    reason = F.when(F.col("host").isNull(), "missing entry").when(F.col("_here").isNull(), "no local output")
    return open_.select(*keys, "consumer", "state",
                        F.when(reason.isNull(), "Resumed").otherwise("Failed").alias("outcome"),
                        reason.alias("reason"))


def digest_match(a: DataFrame, b: DataFrame, keys: str | Sequence[str], content: str = "content") -> DataFrame:
    """Whether both systems produced the same bytes under each key; a missing side does not match."""
    keys = names(keys)
    left = a.select(*keys, F.md5(content).alias("left_md5"))
    right = b.select(*keys, F.md5(content).alias("right_md5"))
    match = F.coalesce(F.col("left_md5") == F.col("right_md5"), F.lit(False))
    return left.join(right, keys, "full").withColumn("match", match)
