"""Structured Streaming operators over message, event and detection streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import names

# fixed values: states a task or a transfer may be in
TASK_STATES = ("Pending", "Running", "ComputeDone", "Failed")
TRANSFER_STATES = ("Pending", "Transferring", "Done", "Failed")


def subscribe(streams: dict[str, DataFrame], me: str | None = None) -> DataFrame:
    """One stream of all peers' messages tagged by peer; addressed messages of others are left out."""
    tagged = [df.withColumn("peer", F.lit(peer)) for peer, df in streams.items()]
    merged = reduce(DataFrame.unionByName, tagged)
    if "target" not in merged.columns:
        return merged
    return merged.where(F.col("target").isNull() if me is None else F.col("target").isNull() | (F.col("target") == me))


def publish(df: DataFrame, path: str, checkpoint: str, to: str | None = None, format: str = "json"):
    """Write a stream for its readers: ``to`` names one reader, otherwise the message is for all."""
    addressed = df.withColumn("target", F.lit(to).cast("string"))
    return (addressed.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append"))


def on(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], peer: str = "peer") -> DataFrame:
    """Apply each peer's handler to that peer's messages; results come as one stream."""
    handled = [fn(stream.where(F.col(peer) == name)).withColumn(peer, F.lit(name)) for name, fn in handlers.items()]
    return reduce(DataFrame.unionByName, handled)


def on_batch(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str,
             peer: str = "peer"):
    """Handlers with side effects, run once per micro-batch with that peer's rows."""
    def run(batch: DataFrame, number: int) -> None:
        for name, fn in handlers.items():
            fn(batch.where(F.col(peer) == name), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def rolling_metrics(msgs: DataFrame, window: int = 10, slide: int = 1, watermark: str = "10 seconds") -> DataFrame:
    """Messages, bytes and latency per peer over a sliding window (seconds) of receive time.

    ``msgs``: peer, recv_ts, sent_ts (null when unstamped), bytes. Messages are first summed in panes of one slide, so each
    is shuffled once at most and a busy peer is combined per task; the windows are made of panes, not of messages.
    A stream hands on each window once, when the watermark has passed its end (append mode).
    """
    if window % slide:
        raise ValueError("a window is a whole number of slides")
    gap = (F.unix_micros("recv_ts") - F.unix_micros("sent_ts")) / 1e6
    timed = msgs.withColumn("_lat", F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))))
    if msgs.isStreaming:
        timed = timed.withWatermark("recv_ts", watermark)
    at = F.struct(F.when(F.col("_lat").isNotNull(), F.col("recv_ts")).alias("at"), F.col("_lat").alias("lat"))
    panes = timed.groupBy(F.window("recv_ts", f"{slide} seconds"), "peer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count("_lat").alias("stamped"), F.sum("_lat").alias("lat_sum"),
        F.max("_lat").alias("lat_max"), F.max(at).alias("newest"))
    out = (panes.groupBy(F.window(F.window_time("window"), f"{window} seconds", f"{slide} seconds"), "peer")
           .agg(F.sum("n").alias("msgs"), F.sum("bytes").alias("bytes"), F.max("newest").alias("newest"),
                (F.sum("lat_sum") / F.sum("stamped")).alias("avg_latency"), F.max("lat_max").alias("max_latency")))
    seconds = float(window)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "peer", "msgs",
                      (F.col("msgs") / seconds).alias("msgs_per_sec"), "bytes", (F.col("bytes") / seconds).alias("bytes_per_sec"),
                      F.col("newest.lat").alias("last_latency"), "avg_latency", "max_latency")


def latest_state(events: DataFrame, keys: str | Sequence[str], valid: Sequence[str] = TASK_STATES,
                 value: str = "state", order: str | Sequence[str] = "at") -> DataFrame:
    """Newest valid state per key (update mode). Unknown states are rejected.

    A plain aggregate: each task first reduces its own rows, so a busy key costs one row per task.
    """
    keys, order = names(keys), names(order)
    newest = F.max_by(F.struct(*order, value), F.struct(*order))
    known = events.where(F.col(value).isin(*valid))
    return known.groupBy(*keys).agg(newest.alias("_s")).select(*keys, "_s.*")


def append_once(stream: DataFrame, id: str | Sequence[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """Each id once within the watermark, for append sinks that may see retries."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(names(id))
