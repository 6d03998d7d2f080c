"""Joins: pairing, resolvers, readiness, report comparison, flow contention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import names
from runframe.functions.values import pct, size_bytes
from runframe.operators.scan import has_hot_group, scan


def paired(runs: DataFrame, a: str, b: str, by: str | Sequence[str], order: str, key: str = "rep",
           system: str = "system", value: str = "makespan_s") -> DataFrame:
    """One row per key valid on both systems; of duplicate rows the last by ``order`` wins."""
    keys = [*names(by), key]

    def last_of(label: str) -> Column:
        return F.max_by(F.when(F.col(system) == label, F.col(value)),
                        F.when(F.col(system) == label, F.col(order)))

    return (runs.where(F.col(system).isin(a, b)).groupBy(*keys)
            .agg(last_of(a).alias("a_value"), last_of(b).alias("b_value"))
            .where(F.col("a_value").isNotNull() & F.col("b_value").isNotNull())
            .withColumn("delta", F.col("b_value") - F.col("a_value")))


def paired_by_position(runs: DataFrame, a: str, b: str, by: str | Sequence[str],
                       order: str | Sequence[str], system: str = "system",
                       value: str = "makespan_s") -> DataFrame:
    """The i-th run of ``a`` beside the i-th run of ``b``, cut to the shorter side."""
    keys = names(by)
    numbered = scan(runs.where(F.col(system).isin(a, b)), [*keys, system], order,
                    {"position": ("row_number",)})
    return (numbered.groupBy(*keys, "position")
            .agg(F.max(F.when(F.col(system) == a, F.col(value))).alias("a_value"),
                 F.max(F.when(F.col(system) == b, F.col(value))).alias("b_value"))
            .where(F.col("a_value").isNotNull() & F.col("b_value").isNotNull())
            .withColumn("delta", F.col("b_value") - F.col("a_value")))


def edge_transfers(tasks: DataFrame, spec: DataFrame, run: str = "run", dialect: str = "a") -> DataFrame:
    """Cross-node dependency edges with transfer seconds and the producer's declared bytes.

    ``tasks``: run, task, node, start, end. ``spec``: run, task, deps, data_size.
    """
    edges = spec.select(run, F.col("task").alias("child"), F.explode("deps").alias("dep"))
    child = tasks.select(run, F.col("task").alias("child"), F.col("node").alias("dst_node"),
                         F.col("start").alias("child_start"))
    dep = tasks.select(run, F.col("task").alias("dep"), F.col("node").alias("src_node"),
                       F.col("end").alias("dep_end"))
    size = spec.select(run, F.col("task").alias("dep"), size_bytes(F.col("data_size"), dialect).alias("bytes"))
    return (edges.join(child, [run, "child"]).join(dep, [run, "dep"]).join(size, [run, "dep"])
            .where((F.col("src_node") != F.col("dst_node"))
                   & F.col("child_start").isNotNull() & F.col("dep_end").isNotNull())
            .select(run, F.col("dep").alias("src_task"), F.col("child").alias("dst_task"),
                    "src_node", "dst_node", "bytes",
                    F.greatest(F.col("child_start") - F.col("dep_end"), F.lit(0.0)).alias("transfer_sec")))


def _with_profiles(candidates: DataFrame, task_prof: DataFrame, image_prof: DataFrame, value: str,
                   min_samples: int, positive: bool) -> DataFrame:
    def usable(prof: DataFrame, keys: list[str], name: str) -> DataFrame:
        kept = prof.where(F.col("samples") >= min_samples)
        if positive:
            kept = kept.where(F.col(value) > 0)
        return kept.select(*keys, F.col(value).alias(name))

    task_keys, image_keys = ["template", "task", "node"], ["image", "node"]
    return (candidates.join(usable(task_prof, task_keys, "_task_value"), task_keys, "left")
            .join(usable(image_prof, image_keys, "_image_value"), image_keys, "left"))


def resolve_runtime(candidates: DataFrame, task_prof: DataFrame, image_prof: DataFrame, min_samples: int = 3,
                    source: str = "profiler", default: float = 10.0) -> DataFrame:
    """Expected runtime of each candidate placement.

    ``candidates``: template, task, image, node, runtime, runtime_profile (map node -> seconds).
    Order of trust: template profile, image profile, per-node hint, positive scalar hint, default.
    ``source="manual"`` skips both profiles.
    """
    hints = [F.try_element_at("runtime_profile", F.col("node")),
             F.when(F.col("runtime") > 0, F.col("runtime")),
             F.lit(float(default) if default > 0 else 10.0)]
    if source == "manual":
        return candidates.withColumn("resolved_runtime", F.coalesce(*hints))
    joined = _with_profiles(candidates, task_prof, image_prof, "runtime_ema", min_samples, positive=False)
    return joined.select(*[candidates[c] if c not in ("template", "task", "node", "image") else F.col(c)
                           for c in candidates.columns],
                         F.coalesce("_task_value", "_image_value", *hints).alias("resolved_runtime"))


def resolve_bytes(candidates: DataFrame, task_prof: DataFrame, image_prof: DataFrame, min_samples: int = 3,
                  source: str = "profiler", default: str = "") -> DataFrame:
    """Expected output bytes: positive profile bytes, then the declared size, then the default."""
    declared = size_bytes(F.col("data_size"), "a")
    hints = [F.when(declared > 0, declared), size_bytes(F.lit(default), "a")]
    if source == "manual":
        return candidates.withColumn("resolved_bytes", F.coalesce(*hints))
    joined = _with_profiles(candidates, task_prof, image_prof, "data_ema", min_samples, positive=True)
    profiled = [F.col("_task_value").cast("long"), F.col("_image_value").cast("long")]
    return joined.select(*[F.col(c) for c in candidates.columns],
                         F.coalesce(*profiled, *hints).alias("resolved_bytes"))


def resolve_bandwidth(pairs: DataFrame, observed: DataFrame, config: DataFrame, source: str = "external",
                      default: float = 125_000_000.0) -> DataFrame:
    """Bandwidth of each (src, dst) pair: 0 on the same node, else by ``source``.

    ``external``: config, default. ``profiler``: observed, default. ``hybrid``: observed, config, default.
    """
    seen = observed.select("src", "dst", F.col("bandwidth").alias("_observed"))
    set_ = config.select("src", "dst", F.col("bytes_per_sec").alias("_config"))
    choices = {"external": ["_config"], "profiler": ["_observed"], "hybrid": ["_observed", "_config"]}[source]
    out = pairs
    if "_observed" in choices:
        out = out.join(seen, ["src", "dst"], "left")
    if "_config" in choices:
        out = out.join(set_, ["src", "dst"], "left")
    value = F.coalesce(*choices, F.lit(float(default)))
    return out.withColumn("bandwidth", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(value)).drop(*choices)


def with_frame_meta(dets: DataFrame, frames: DataFrame, by: str | Sequence[str] = "camera",
                    frame: str = "frame") -> DataFrame:
    """Attach frame metadata by file name, trying the ``.jpg`` name when the ``.png`` one is absent."""
    keys = names(by)
    meta = [c for c in frames.columns if c not in (*keys, frame)]
    jpg = dets.withColumn("_jpg", F.regexp_replace(F.col(frame), r"\.png$", ".jpg"))

    def lookup(key: str, name: str) -> DataFrame:
        return frames.select(*keys, F.col(frame).alias(key), F.struct(*meta).alias(name))

    found = (jpg.join(lookup(frame, "_exact"), [*keys, frame], "left")
             .join(lookup("_jpg", "_other"), [*keys, "_jpg"], "left")
             .withColumn("_meta", F.coalesce("_exact", "_other")).where("_meta IS NOT NULL"))
    return found.select(*[F.col(c) for c in dets.columns], "_meta.*")


def with_embeddings(dets: DataFrame, embs: DataFrame, keys: Sequence[str] = ("camera", "det_index"),
                    ) -> DataFrame:
    """Full match of detections and embeddings; ``match`` tells rows that lack the other side."""
    keys = names(keys)
    left = dets.withColumn("_det", F.lit(True))
    right = embs.withColumn("_emb", F.lit(True))
    state = (F.when(F.col("_det") & F.col("_emb"), "both")
             .when(F.col("_det"), "no_embedding").otherwise("no_detection"))
    return left.join(right, keys, "full").withColumn("match", state).drop("_det", "_emb")


def diff_reports(a: DataFrame, b: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Differences of two report track lists, one row per finding.

    Inputs hold ``keys``, pos, class, cameras, hop_count. Where the track counts differ only
    that is reported, together with differing class counts.
    """
    keys = names(keys)

    def totals(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_n"))

    def classes(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias(f"{side}_c"))

    def finding(kind: str, pos: Column, left: Column, right: Column) -> list[Column]:
        return [*map(F.col, keys), F.lit(kind).alias("finding"), pos.cast("long").alias("pos"),
                left.cast("string").alias("left_value"), right.cast("string").alias("right_value")]

    n = totals(a, "a").join(totals(b, "b"), keys, "full").na.fill(0, ["a_n", "b_n"])
    lengths = n.where("a_n <> b_n").select(*finding("n_tracks", F.lit(None), F.col("a_n"), F.col("b_n")))
    per_class = (classes(a, "a").join(classes(b, "b"), [*keys, "class"], "full").na.fill(0, ["a_c", "b_c"])
                 .where("a_c <> b_c"))
    counts = per_class.select(*finding(
        "counts_by_class", F.lit(None), F.concat_ws("=", "class", "a_c"), F.concat_ws("=", "class", "b_c")))
    fields = ["class", "cameras", "hop_count"]
    left = a.select(*keys, "pos", *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    right = b.select(*keys, "pos", *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    both = left.join(right, [*keys, "pos"]).join(n.where("a_n = b_n").select(*keys), keys, "left_semi")
    each = F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")),
                            F.struct(F.lit(f).alias("f"), F.col(f"a_{f}").alias("l"), F.col(f"b_{f}").alias("r")))
                     for f in fields])
    tracks = (both.withColumn("_d", F.explode(F.filter(each, lambda d: d.isNotNull())))
              .select(*keys, F.col("_d.f").alias("finding"), F.col("pos").cast("long"),
                      F.col("_d.l").alias("left_value"), F.col("_d.r").alias("right_value")))
    return lengths.unionByName(counts).unionByName(tracks)


def cluster_view(nodes: DataFrame, usage: DataFrame, disk: DataFrame, tasks: DataFrame) -> DataFrame:
    """Node view: allocatable, usage, last known disk and running tasks; missing is 0.

    ``nodes``: node, cpu_alloc, mem_alloc, ready, schedulable. ``usage``: node, cpu_used, mem_used.
    ``disk``: node, ts, disk_used (latest wins). ``tasks``: node, phase.
    """
    last_disk = disk.groupBy("node").agg(F.max_by("disk_used", "ts").alias("disk_used"))
    tally = tasks.groupBy("node").agg(F.count_if(F.col("phase") == "Running").alias("running_tasks"),
                                      F.count(F.lit(1)).alias("total_tasks"))
    out = (nodes.join(usage, "node", "left").join(last_disk, "node", "left").join(tally, "node", "left")
           .na.fill(0, ["cpu_used", "mem_used", "disk_used", "running_tasks", "total_tasks"]))
    return out.withColumns({"cpu_pct": pct(F.col("cpu_used"), F.col("cpu_alloc")),
                            "mem_pct": pct(F.col("mem_used"), F.col("mem_alloc"))})


def ready_tasks(spec: DataFrame, started: DataFrame, ready: DataFrame, assign: DataFrame) -> DataFrame:
    """Tasks not yet started whose dependencies all started and delivered.

    ``spec``: run, task, deps. ``started``: run, task, phase. ``ready``: run, task, node (data
    present there). ``assign``: run, task, node, has_agent. Without an agent on the task's node a
    dependency must have Succeeded instead.
    """
    open_ = spec.join(started, ["run", "task"], "left_anti").join(assign, ["run", "task"], "left")
    deps = open_.select("run", "task", "node", F.coalesce("has_agent", F.lit(False)).alias("has_agent"),
                        F.explode_outer("deps").alias("dep"))
    state = started.select("run", F.col("task").alias("dep"), F.col("phase").alias("dep_phase"))
    data = (ready.select("run", F.col("task").alias("dep"), "node").distinct()
            .withColumn("_there", F.lit(True)))
    seen = deps.join(state, ["run", "dep"], "left").join(data, ["run", "dep", "node"], "left")
    done = (F.when(F.col("dep").isNull(), True)
            .when(F.col("dep_phase").isNull(), False)
            .when(F.col("has_agent"), F.coalesce("_there", F.lit(False)))
            .otherwise(F.col("dep_phase") == "Succeeded"))
    return (seen.groupBy("run", "task").agg(F.bool_and(done).alias("_all"))
            .where("_all").select("run", "task"))


def predicted_vs_actual(runs: DataFrame, predicted: DataFrame, run: str = "run_name",
                        value: str = "makespan_s") -> DataFrame:
    """Actual makespan beside the predicted one (latest estimated end)."""
    expected = predicted.groupBy(run).agg(F.max("est_end").alias("predicted"))
    return runs.select(run, F.col(value).alias("actual")).join(expected, run)


def pick_flows(actual: DataFrame, predicted: DataFrame, run: str = "run") -> DataFrame:
    """All actual flows, and predicted flows of runs without any actual flow."""
    missing = predicted.join(actual.select(run).distinct(), run, "left_anti")
    return (actual.withColumn("flow_source", F.lit("actual"))
            .unionByName(missing.withColumn("flow_source", F.lit("predicted"))))


def owned_by(pods: DataFrame, runs: DataFrame) -> DataFrame:
    """Pods one of whose owners is the run itself, by uid rather than by name."""
    owners = pods.withColumn("uid", F.explode(F.array_distinct("owner_uids")))
    return owners.join(runs.select("uid", "run"), "uid").select("run", "uid", "pod")


def flow_contention(flows: DataFrame, bandwidth: DataFrame, tol: float = 0.01, id: str = "flow_id") -> DataFrame:
    """Per flow: how many flows leave its source and reach its destination when it starts,
    and whether it ran more than ``tol`` slower than ``bytes / bandwidth``.

    A flow that ends exactly when another starts no longer counts.
    """
    events = flows.select(id, "src", "dst", F.explode(F.array(
        F.struct(F.col("start").alias("t"), F.lit(1).alias("d")),
        F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    events = events.select(id, "src", "dst", F.col("e.t").alias("t"), F.col("e.d").cast("long").alias("d"))

    def active(node: str, name: str) -> DataFrame:
        # all changes at one instant count together, so equal starts see each other
        steps = events.groupBy(node, "t").agg(F.sum("d").alias("d"))
        running = scan(steps, node, "t", {name: ("sum", F.col("d"))}, has_hot_group(flows, node))
        return running.select(node, F.col("t").alias("start"), name)

    rate = bandwidth.select("src", "dst", "bandwidth")
    ideal = F.when(F.col("bandwidth") > 0, F.col("bytes") / F.col("bandwidth"))
    return (flows.join(active("src", "egress"), ["src", "start"])
            .join(active("dst", "ingress"), ["dst", "start"])
            .join(rate, ["src", "dst"], "left")
            .withColumn("ideal_sec", ideal)
            .withColumn("actual_sec", F.col("end") - F.col("start"))
            .withColumn("slower", F.coalesce(F.col("actual_sec") > F.col("ideal_sec") * (1 + tol), F.lit(False)))
            .select(id, "src", "dst", "egress", "ingress", "ideal_sec", "actual_sec", "slower"))
