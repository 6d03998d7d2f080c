"""Roll-ups over runs, tasks, flows, detections and agent samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import names
from runframe.operators.scan import scan
from runframe.operators.windows import top_k


def merge_summary(inputs: DataFrame, by: str | Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Per-input counts, and one total row: count, sum (2 dp), mean (4 dp), min, max, average."""
    per_input = inputs.groupBy(*names(by)).agg(F.count(value).alias("count"))
    total = inputs.agg(
        F.count(value).alias("count"),
        F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("sum"),
        F.round(F.coalesce(F.avg(value), F.lit(0.0)), 4).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return per_input, total


def run_rollup(tasks: DataFrame, totals: DataFrame, run: str = "run") -> DataFrame:
    """Phase, reason and makespan of each run.

    Any failed task fails the run with the first failure's reason (lowest task name); every
    declared task succeeded means Succeeded; otherwise the run is in progress.
    ``totals``: run, total_tasks.
    """
    failed = F.col("phase") == "Failed"
    why = F.coalesce("reason", F.lit("pod failed")) if "reason" in tasks.columns else F.lit("pod failed")
    facts = tasks.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(failed).alias("n_failed"),
        F.count_if(F.col("phase") == "Succeeded").alias("n_ok"),
        F.min_by(why, F.when(failed, F.col("task"))).alias("_why"),
        F.min(F.when(failed, F.col("task"))).alias("_who"),
        (F.max("end") - F.min("start")).alias("_span"))
    done = (F.col("n_ok") == F.col("n_tasks")) & (F.col("n_tasks") >= F.col("total_tasks"))
    return facts.join(totals, run, "left").select(
        run, "n_tasks", "n_failed",
        F.when(F.col("n_failed") > 0, "Failed").when(done, "Succeeded").otherwise("Running").alias("phase"),
        F.when(F.col("n_failed") > 0, F.concat(F.lit('task "'), "_who", F.lit('" failed ('), "_why", F.lit(")")))
        .alias("message"),
        F.greatest(F.coalesce("_span", F.lit(0.0)), F.lit(0.0)).alias("makespan"))


def finalize_stale(runs: DataFrame, tasks: DataFrame, run: str = "run") -> DataFrame:
    """Final phase for non-terminal runs that have no live task left."""
    live = F.col("phase").isin("Running", "Pending")
    tally = tasks.groupBy(run).agg(F.count_if(live).alias("live"),
                                   F.count_if(F.col("phase") == "Succeeded").alias("ok"),
                                   F.count_if(F.col("phase") == "Failed").alias("bad"))
    open_ = (runs.where(F.col("phase").isin("Running", "Scheduling", "Pending")).select(run)
             .join(tally, run, "left").na.fill(0, ["live", "ok", "bad"]).where("live = 0"))
    none = (F.col("ok") + F.col("bad")) == 0
    fine = F.col("bad") == 0
    return open_.select(
        run,
        F.when(none, "Failed").when(fine, "Succeeded").otherwise("Failed").alias("phase"),
        F.when(none, "stale: no tasks found").when(fine, "reconciled: all tasks succeeded")
        .otherwise("reconciled: one or more tasks failed").alias("message"))


def fuse_detections(dets: DataFrame, by: str | Sequence[str] = (), k: int = 5, order: str = "det_id",
                    class_col: str = "class") -> DataFrame:
    """Per class: detection count, distinct sensors, and mean confidence of the ``k`` best (3 dp)."""
    keys = [*names(by), class_col]
    base = dets.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    sensors = dets.select(*keys, "sensor").distinct().groupBy(*keys).agg(F.count("sensor").alias("n_sensors"))
    best = (top_k(dets, keys, k, ["-confidence", order]).groupBy(*keys)
            .agg(F.round(F.avg("confidence"), 3).alias("avg_confidence"),
                 F.transform(F.sort_array(F.collect_list(F.struct("rank", order))),
                             lambda r: r[order]).alias("top_detections")))
    return base.join(sensors, keys, "left").join(best, keys, "left")


def source_counts(dets: DataFrame, source: str = "sensor") -> DataFrame:
    return dets.groupBy(source).agg(F.count(F.lit(1)).alias("detections"))


def majority_class(df: DataFrame, by: str | Sequence[str], weight: str = "det_count", order: str = "pos",
                   class_col: str = "class") -> DataFrame:
    """Class with the largest summed weight; a tie goes to the class seen first."""
    keys = names(by)
    per_class = df.groupBy(*keys, class_col).agg(F.sum(weight).alias("_w"), F.min(order).alias("_first"))
    best = F.min_by(F.struct(class_col, "_w"), F.struct(-F.col("_w"), F.col("_first")))
    return (per_class.groupBy(*keys).agg(best.alias("_b"))
            .select(*keys, F.col(f"_b.{class_col}").alias(class_col), F.col("_b._w").alias("class_weight")))


def traffic_report(tracks: DataFrame, hops: DataFrame, track: str = "global_id",
                   class_col: str = "class") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Class counts, ranked track summary, and the ordered hops of each track.

    ``tracks``: global_id, class. ``hops``: global_id, camera, tracklet_id, frame_first, frame_last,
    det_count. Hops stay one row each (numbered), so a track of any length fits.
    """
    counts = tracks.groupBy(class_col).agg(F.count(F.lit(1)).alias("tracks"))
    ordered = scan(hops, track, ["frame_first", "camera", "tracklet_id"], {"hop": ("row_number",)})
    totals = hops.groupBy(track).agg(F.count(F.lit(1)).alias("hop_count"),
                                     F.sum("det_count").alias("det_count_total"),
                                     F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"))
    summary = tracks.select(track, class_col).join(totals, track)
    ranked = scan(summary, None, [class_col, "-det_count_total", track], {"rank": ("row_number",)})
    return counts, ranked, ordered


def link_traffic(flows: DataFrame) -> DataFrame:
    """Bytes and flow count per (src, dst) with the share of the busiest link."""
    links = flows.groupBy("src", "dst").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))
    peak = links.agg(F.max("bytes")).scalar()
    return links.withColumn("share", F.when(peak > 0, F.col("bytes") / peak).otherwise(0.0))


def observed_bandwidth(link_prof: DataFrame, min_samples: int = 3) -> DataFrame:
    """Bytes over seconds of each node pair, across templates."""
    return (link_prof.where((F.col("samples") >= min_samples) & (F.col("transfer_sec") > 0))
            .groupBy("src", "dst")
            .agg((F.sum("data_bytes") / F.sum("transfer_sec")).alias("bandwidth")))


def mean_pair_bandwidth(bandwidth: DataFrame, default: float = 125_000_000.0) -> DataFrame:
    """Mean over unordered node pairs (the direction from the lower name), default when there is none."""
    return bandwidth.where(F.col("src") < F.col("dst")).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.avg("bandwidth"), F.lit(float(default))).alias("mean_bandwidth"))


def ema_profile(obs: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
                value: str = "runtime", data: str | None = "data_bytes", alpha: float = 0.3,
                max_samples: int = 100, warmup: int = 0, run_number: str | None = None) -> DataFrame:
    """Exponential moving averages per key, as one aggregation.

    With n observations the p-th weighs ``(1-alpha)^(n-p)``, times ``alpha`` unless it is the first,
    which equals folding them one by one. ``data`` skips non-positive observations after the first.
    """
    keys = names(keys)
    seen = obs if run_number is None else obs.where(F.col(run_number) > warmup)
    one = F.lit(1).cast("long")
    columns = {"_p": ("row_number",), "_n": ("total", one)}
    if data is not None:
        positive = F.when(F.col(data) > 0, one).otherwise(one * 0)
        columns |= {"_dp": ("sum", positive), "_dn": ("total", positive)}
    numbered = scan(seen, keys, order, columns)

    def average(value: str, later: str) -> Column:
        """Weighted sum where ``later`` counts the observations folded in afterwards."""
        first = F.when(F.col("_p") == 1, F.lit(1.0)).otherwise(F.lit(float(alpha)))
        return F.sum(F.pow(F.lit(1.0 - alpha), F.expr(later)) * first * F.col(value))

    aggregates = [average(value, "_n - _p").alias(f"{value}_ema"),
                  F.least(F.max("_n"), F.lit(max_samples)).cast("long").alias("samples")]
    if data is not None:
        used = numbered.withColumn("_d", F.when((F.col("_p") == 1) | (F.col(data) > 0), F.col(data)))
        return used.groupBy(*keys).agg(*aggregates, average("_d", "_dn - _dp").alias("data_ema"))
    return numbered.groupBy(*keys).agg(*aggregates)


def link_ema(edges: DataFrame, order: str | Sequence[str], alpha: float = 0.3,
             max_samples: int = 100) -> DataFrame:
    """Moving averages of transfer time and bytes per edge and node pair; same-node edges skipped."""
    keys = ["template", "src_task", "dst_task", "src", "dst"]
    return ema_profile(edges.where(F.col("src") != F.col("dst")), keys, order, "transfer_sec", "data_bytes",
                       alpha, max_samples)


def agent_overhead(samples: DataFrame, counters: Sequence[str] = ("bytes_in", "bytes_out", "put_total", "put_ok"),
                   agent: str = "agent", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Per agent: counter growth, mean and peak cpu and memory, peak in-flight; then the totals."""
    window = [F.max_by(c, ts) - F.min_by(c, ts) for c in counters]
    per_agent = samples.groupBy(agent).agg(
        *[w.alias(f"{c}_delta") for c, w in zip(counters, window)],
        F.avg("cpu").alias("cpu_mean"), F.max("cpu").alias("cpu_peak"),
        F.avg("mem").alias("mem_mean"), F.max("mem").alias("mem_peak"),
        F.max("inflight").alias("peak_inflight"), F.count(F.lit(1)).alias("samples"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    total = per_agent.agg(
        F.count(F.lit(1)).alias("agents"), F.sum("cpu_peak").alias("cpu_peak"),
        F.sum("mem_peak").alias("mem_peak"),
        *[F.sum(f"{c}_delta").alias(f"{c}_delta") for c in counters],
        F.max("peak_inflight").alias("peak_inflight"), F.sum("samples").alias("samples"),
        (F.max("last_ts") - F.min("first_ts")).alias("window_sec"))
    return per_agent, total


def template_summary(templates: DataFrame, runs: DataFrame) -> DataFrame:
    """Run count, newest run and its phase, and task count of each template."""
    facts = runs.groupBy("template").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.max_by(F.struct("run_name", "phase"), F.struct("created_at", "run_id")).alias("_last"))
    return templates.join(facts, "template", "left").select(
        "template", "task_count", F.coalesce("run_count", F.lit(0)).cast("long").alias("run_count"),
        F.col("_last.run_name").alias("last_run"),
        F.when(F.col("run_count").isNotNull(), F.coalesce(F.col("_last.phase"), F.lit("Pending"))).alias("last_phase"))


def heat_band(value: Column, low: Column, high: Column) -> Column:
    """``low``/``mid``/``high`` third of the range, ``flat`` when all values are equal."""
    share = (value - low) / (high - low)
    return (F.when(high == low, "flat").when(share < 0.33, "low").when(share < 0.66, "mid").otherwise("high"))


def profile_matrix(profiles: DataFrame, value: str = "runtime_ema") -> DataFrame:
    """Task by node cells of each template with the heat band inside the template."""
    span = profiles.groupBy("template").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return profiles.join(span, "template").select(
        "template", "task", "node", value, "samples",
        heat_band(F.col(value), F.col("_lo"), F.col("_hi")).alias("band"))


def pivot_matrix(profiles: DataFrame, nodes: Sequence[str], value: str = "runtime_ema") -> DataFrame:
    """The same cells with one column per listed node."""
    return profiles.groupBy("template", "task").pivot("node", list(nodes)).agg(F.first(value))


def placement_share(tasks: DataFrame, by: str | Sequence[str], tasks_in: Sequence[str] | None = None,
                    nodes_in: Sequence[str] | None = None) -> DataFrame:
    """Share of the chosen tasks that ran on each chosen node, per configuration."""
    keys = names(by)
    chosen = tasks if tasks_in is None else tasks.where(F.col("task").isin(*tasks_in))
    if nodes_in is not None:
        chosen = chosen.where(F.col("node").isin(*nodes_in))
    per_node = chosen.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("placed"))
    total = per_node.groupBy(*keys).agg(F.sum("placed").alias("total"))
    return per_node.join(total, keys).withColumn("share", F.col("placed") / F.col("total"))


def cluster_totals(view: DataFrame) -> DataFrame:
    usable = F.col("ready") & F.col("schedulable")
    return view.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(usable).alias("usable"),
                    *[F.sum(c).alias(c) for c in ("cpu_used", "cpu_alloc", "mem_used", "mem_alloc",
                                                  "disk_used", "running_tasks")])


def link_classes(links: DataFrame, rate: str = "bytes_per_sec") -> DataFrame:
    """Mbps of each link and its class: fastest F, slowest S, others M; two rates M and F; one F."""
    mbps = F.round(F.col(rate) / 125_000, 2)
    rated = links.withColumn("mbps", mbps)
    span = rated.select("mbps").distinct()
    n, low, high = (span.agg(f).scalar() for f in (F.count(F.lit(1)), F.min("mbps"), F.max("mbps")))
    label = (F.when(F.col("mbps") == high, "F").when(n == 2, "M").when(F.col("mbps") == low, "S").otherwise("M"))
    return rated.withColumn("link_class", label)


def outcome_counts(runs: DataFrame, run_names: DataFrame | None = None, by: str | Sequence[str] = ()) -> DataFrame:
    """Succeeded, failed and other runs of a batch."""
    batch = runs if run_names is None else runs.join(run_names, "run_name", "left_semi")
    ok, bad = F.col("phase") == "Succeeded", F.col("phase") == "Failed"
    return batch.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(bad).alias("failed"),
        F.count_if(~(ok | bad)).alias("other"))


def provenance(tasks: DataFrame, by: str | Sequence[str], stage: str = "task", order: str = "end") -> DataFrame:
    """Node of each stage of each run (the last placement), one row per map entry."""
    return tasks.groupBy(*names(by), stage).agg(F.max_by("node", F.struct(order, "node")).alias("node"))


def mission_summary(fused: DataFrame, sources: DataFrame, stages: DataFrame) -> DataFrame:
    """Report as (section, key, value) rows: totals, classes, detections per source, stage nodes."""
    def section(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), key.cast("string").alias("key"),
                         value.cast("string").alias("value"))

    totals = fused.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("c"))
    return (section(totals, "summary", F.lit("total_detections"), F.col("n"))
            .unionByName(section(totals, "summary", F.lit("num_classes"), F.col("c")))
            .unionByName(section(fused, "class", F.col("class"), F.col("count")))
            .unionByName(section(sources, "source", F.col(sources.columns[0]), F.col("detections")))
            .unionByName(section(stages, "stage_node", F.col("task"), F.col("node"))))


def correctness_rollup(diffs: DataFrame, reports: DataFrame, expected: DataFrame) -> DataFrame:
    """Per cell: repetitions, OK, FAIL and NO_REPORT counts, mean tracks and class names.

    ``expected``: cell, rep. ``reports``: cell, rep, class, tracks (per class counts of the compared
    run). ``diffs``: findings with cell, rep.
    """
    made = reports.groupBy("cell", "rep").agg(F.sum("tracks").alias("tracks"))
    bad = diffs.select("cell", "rep").distinct().withColumn("_bad", F.lit(True))
    status = (F.when(F.col("tracks").isNull(), "NO_REPORT").when(F.col("_bad"), "FAIL").otherwise("OK"))
    reps = expected.join(made, ["cell", "rep"], "left").join(bad, ["cell", "rep"], "left").withColumn("status", status)
    out = reps.groupBy("cell").agg(
        F.count(F.lit(1)).alias("reps"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "FAIL", "NO_REPORT")],
        F.avg("tracks").alias("mean_tracks"))
    classes = (reports.select("cell", "class").distinct().groupBy("cell")
               .agg(F.array_join(F.sort_array(F.collect_list("class")), ",").alias("classes")))
    return out.join(classes, "cell", "left")
