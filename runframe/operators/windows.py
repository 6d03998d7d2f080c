"""Ordered operators: top-k, warm windows, busy time, overlap, lanes, retention, numbering."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.runtime import int_conf, names, order_columns, reverse, same
from runframe.functions.streams import map_sorted, starts
from runframe.operators.scan import has_hot_group, scan


def top_k(df: DataFrame, by: str | Sequence[str] | None, k: int, order: str | Sequence[str],
          rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group by ``order``, numbered from 1.

    Each task keeps only its own first ``k`` rows per group before the shuffle, so a large group
    sends at most ``k`` rows per task. Spark prunes so up to a bound of ``k``; above it each group is first
    ranked in salted parts, so that no task meets a whole large group.
    """
    keys = names(by)

    def place(*extra: Column) -> Column:
        return F.row_number().over(Window.partitionBy(*keys, *extra).orderBy(*order_columns(order)))

    if not keys:
        df = df.orderBy(*order_columns(order)).limit(k)
    elif k > int_conf(df.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold", 1000):
        parts = int_conf(df.sparkSession, "spark.sql.shuffle.partitions", 200)
        salt = F.pmod(F.xxhash64(*[item.lstrip("-") for item in names(order)]), F.lit(parts))
        salted = df.withColumn("_salt", salt)
        df = salted.withColumn("_near", place(F.col("_salt"))).where(F.col("_near") <= k).drop("_salt", "_near")
    return df.withColumn(rank, place()).where(F.col(rank) <= k)


def warm_window(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], warm_from: int = 5,
                keep_short: bool = True) -> DataFrame:
    """Drop the first ``warm_from - 1`` rows of each group; short groups stay whole if ``keep_short``."""
    counted = scan(df, by, order, {"_pos": ("row_number",), "_n": ("total", F.lit(1).cast("long"))})
    warm = F.col("_pos") >= warm_from
    if keep_short:
        warm = warm | (F.col("_n") < warm_from)
    return counted.where(warm).drop("_pos", "_n")


def counter_deltas(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], value: str) -> DataFrame:
    """Step of a cumulative counter per row (the first counts from 0); null readings are skipped."""
    read = df.where(F.col(value).isNotNull())
    return (scan(read, by, order, {"_before": ("lag", F.col(value))})
            .withColumn("delta", F.col(value) - F.coalesce("_before", F.lit(0))).drop("_before"))


def mean_positive_delta(deltas: DataFrame, by: str | Sequence[str]) -> DataFrame:
    return deltas.groupBy(*names(by)).agg(
        F.avg(F.when(F.col("delta") > 0, F.col("delta"))).try_cast("bigint").alias("mean_delta"))


def latest(df: DataFrame, keys: str | Sequence[str], ts: str | Sequence[str]) -> DataFrame:
    """Newest row of each key, as a map-side combined aggregate."""
    keys, ts = names(keys), names(ts)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*ts))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def busy_time(intervals: DataFrame, by: str | Sequence[str], start: str = "start", end: str = "end",
              id: str = "task", min_span: float = 0.001) -> DataFrame:
    """Length of the union of intervals and its share of the observed span, per group."""
    keys = names(by)
    ordered = scan(intervals, keys, [start, end, id], {"_reach": ("max_before", F.col(end))})
    fresh = F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", F.col(start)))
    facts = ordered.groupBy(*keys).agg(
        F.sum(F.greatest(fresh, F.lit(0.0))).alias("busy"),
        (F.max(end) - F.min(start)).alias("_span"), F.count(F.lit(1)).alias("intervals"))
    span = F.greatest(F.col("_span"), F.lit(min_span))
    return facts.select(*keys, "busy", span.alias("span"), "intervals",
                        F.least(F.lit(100.0), F.col("busy") / span * 100).alias("busy_pct"))


def max_overlap(intervals: DataFrame, by: str | Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Largest number of intervals open at once; an end frees its slot before an equal start."""
    keys = names(by)
    steps = (intervals.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col(end).alias("t"), F.lit(-1).cast("long").alias("d")))).alias("e"))
        .groupBy(*keys, "e.t", "e.d").agg(F.sum("e.d").alias("step")))
    running = scan(steps, keys, ["t", "d"], {"open": ("sum", F.col("step"))}, has_hot_group(intervals, keys))
    rows = F.sum(F.when(F.col("d") == 1, F.col("step")).otherwise(0))
    deepest = F.greatest(F.max("open"), F.lit(0).cast("long"))
    return running.groupBy(*keys).agg(F.when(rows <= 1, rows).otherwise(deepest).alias("max_overlap"))


def assign_lanes(intervals: DataFrame, by: str | Sequence[str], start: str = "start", end: str = "end",
                 id: str = "task") -> DataFrame:
    """First lane free at an interval's start, in order of (start, id).

    Once everything before an interval has ended all lanes are free again, so a group falls into
    independent stretches. Each stretch is one sorted stream through a task that remembers only
    the end of each busy lane and the numbers of idle ones, in heaps.
    """
    keys = names(by)
    hot = has_hot_group(intervals, keys)
    reach = scan(intervals, keys, [start, id], {"_reach": ("max_before", F.col(end))}, hot)
    opens = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), 1).otherwise(0).cast("long")
    parts = scan(reach.withColumn("_opens", opens), keys, [start, id], {"_part": ("sum", F.col("_opens"))}, hot)
    group = [*keys, "_part"]
    data = parts.select(*intervals.columns, "_part")
    schema = T.StructType([*intervals.schema.fields, T.StructField("lane", T.LongType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        busy: list[tuple[float, int]] = []  # (end, lane)
        idle: list[int] = []
        previous = None
        for batch in batches:
            if not len(batch):
                continue
            lanes = []
            ends = batch[end].fillna(np.inf)  # an open interval keeps its lane
            for fresh, s, e in zip(starts(batch, group, previous), batch[start], ends):
                if fresh:
                    busy, idle = [], []
                while busy and busy[0][0] <= s:
                    heapq.heappush(idle, heapq.heappop(busy)[1])
                lane = heapq.heappop(idle) if idle else len(busy)
                heapq.heappush(busy, (e, lane))
                lanes.append(lane)
            previous = tuple(batch[c].iloc[-1] for c in group)
            yield batch.drop(columns="_part").assign(lane=lanes)

    return map_sorted(data, group, [start, id], place, schema)


COMPLETED = ("Succeeded", "Failed")


def retention(runs: DataFrame, policy: str, keep: int = 0, delay: float = 0.0, as_of: str | None = None,
              by: str = "template", order: Sequence[str] = ("created_at", "run_id"),
              completion: str = "completion_time") -> DataFrame:
    """Completed runs to evict: ``immediate``, ``delayed`` (seconds before ``as_of``), ``keepLatest``, ``none``."""
    done = runs.where(F.col("phase").isin(*COMPLETED))
    if policy == "none":
        return done.limit(0)
    if policy == "immediate":
        return done
    if policy == "delayed":
        age = F.to_timestamp(F.lit(as_of)).cast("double") - F.col(completion).cast("double")
        return done.where(age > delay)
    if policy == "keepLatest":
        return _all_but_newest(done, by, order, F.lit(keep), keep) if keep > 0 else done
    raise ValueError(f"unknown retention policy {policy!r}")


def _all_but_newest(done: DataFrame, by: str, order: Sequence[str], keep, most: int) -> DataFrame:
    """Rows older than the ``keep``-th newest of their group, found from at most ``most`` rows each."""
    newest = top_k(done, by, most, reverse(order), "_newest").where(F.col("_newest") <= keep)
    last_kept = newest.groupBy(by).agg(F.min(F.struct(*order)).alias("_edge"))
    return done.join(last_kept, by).where(F.struct(*order) < F.col("_edge")).select(done.columns)


def gc_runs(runs: DataFrame, max_runs: int, by: str = "template",
            order: Sequence[str] = ("created_at", "run_id")) -> DataFrame:
    """Oldest completed runs to delete so that at most ``max_runs`` remain; open runs count but stay."""
    completed = F.col("phase").isin(*COMPLETED)
    per = runs.groupBy(by).agg(F.count_if(~completed).alias("_open"), F.count(F.lit(1)).alias("_total"))
    done = runs.where(completed).join(per.where(F.col("_total") > max_runs), by)
    room = F.greatest(F.lit(max_runs) - F.col("_open"), F.lit(0))
    crowded = done.where(F.col("_open") >= max_runs).select(runs.columns)
    rest = done.where(F.col("_open") < max_runs).withColumn("_room", room)
    return crowded.unionByName(_all_but_newest(rest, by, order, F.col("_room"), max_runs).select(runs.columns))


def size_cap(runs: DataFrame, evicted: DataFrame, cap: int, by: str = "template",
             order: Sequence[str] = ("created_at", "run_id"), size: str = "bytes", id: str = "run_id") -> DataFrame:
    """Oldest completed runs to evict until the rest of each template fits in ``cap`` bytes.

    Open and already evicted runs neither count nor get evicted.
    """
    live = minus(runs.where(F.col("phase").isin(*COMPLETED)), evicted, id)
    sized = scan(live, by, order, {"_before": ("sum_before", F.col(size)), "_all": ("total", F.col(size))})
    return sized.where(F.col("_all") - F.col("_before") > cap).select(runs.columns)


def number_runs(runs: DataFrame, by: str | Sequence[str] = "template",
                order: Sequence[str] = ("created_at", "run_id")) -> DataFrame:
    """Running number of each run inside its template."""
    return scan(runs, by, order, {"run_number": ("row_number",)})


def recent_history(history: DataFrame, by: str | Sequence[str], n: int = 50,
                   order: Sequence[str] = ("-created_at", "-run_id")) -> DataFrame:
    """Newest ``n`` entries of each name."""
    return top_k(history, by, n, order)


def trend(runs: DataFrame, by: str | Sequence[str], order: Sequence[str], value: str = "makespan_s") -> DataFrame:
    """Value of each succeeded run over its index inside the configuration."""
    keys = names(by)
    good = runs.where(F.col("phase") == "Succeeded")
    return (scan(good, keys, order, {"index": ("row_number",)})
            .select(*keys, "index", *[o.lstrip("-") for o in order], value))


def shard_offsets(df: DataFrame, shard: str, order: str | Sequence[str]) -> DataFrame:
    """Global position of each row: rows in earlier shards (by name) plus its place in its own."""
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("shard_size"))
    offsets = scan(sizes, None, shard, {"shard_offset": ("sum_before", F.col("shard_size"))})
    local = scan(df, shard, order, {"_local": ("row_number",)})
    joined = local.join(offsets, same(local, offsets, [shard])).drop(offsets[shard])
    return joined.withColumn("global_pos", F.col("shard_offset") + F.col("_local") - 1).drop("_local")


def minus(df: DataFrame, other: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other``."""
    return df.join(other.select(*names(keys)), names(keys), "left_anti")


def common_keys(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*names(keys)).intersect(b.select(*names(keys)))


def node_set(*frames: DataFrame) -> DataFrame:
    """Distinct node names over the ``node``, ``src`` and ``dst`` columns of all frames."""
    parts = [f.select(F.col(c).alias("node")) for f in frames for c in ("node", "src", "dst") if c in f.columns]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.where("node IS NOT NULL").distinct()


def fan_in(frames: dict[str, DataFrame], ordered: str = "name") -> DataFrame:
    """Bag union of named inputs tagged with their source, in name or declared order."""
    listed = sorted(frames) if ordered == "name" else list(frames)
    merged = None
    for position, name in enumerate(listed):
        tagged = frames[name].withColumns({"source": F.lit(name), "source_pos": F.lit(position)})
        merged = tagged if merged is None else merged.unionByName(tagged)
    if merged is None:
        raise ValueError("fan_in needs at least one input")
    return merged
