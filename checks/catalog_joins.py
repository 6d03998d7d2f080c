"""Joins, set operations and sorts."""

from pyspark.sql import functions as F

import runframe as rf
from runframe.functions.runtime import cut
from checks.registry import query, rounded
from checks.views import OBS_ORDER

PAIRS = """
    WITH a AS (SELECT cell, rep, makespan_s FROM v_runs WHERE system = 'a' AND phase = 'Succeeded'),
    b AS (SELECT cell, rep, makespan_s FROM v_runs WHERE system = 'b' AND phase = 'Succeeded')"""


def good(v):
    return rf.valid_runs(v.runs)


@query("paired_runs", PAIRS + """
    SELECT cell, rep, a.makespan_s AS a_value, b.makespan_s AS b_value, round(b.makespan_s - a.makespan_s, 6) AS delta
    FROM a JOIN b USING (cell, rep)""")
def paired_runs(v):
    return rounded(rf.paired(good(v), "a", "b", "cell", "run_id"), "delta")


@query("paired_last_row", """
    WITH r AS (SELECT cell, CAST(CAST(rep AS BIGINT) // 10 AS VARCHAR) AS rep, system, makespan_s, run_id FROM v_runs WHERE phase = 'Succeeded'),
    l AS (SELECT cell, rep, system, arg_max(makespan_s, run_id) AS m FROM r GROUP BY ALL)
    SELECT a.cell, a.rep, a.m AS a_value, b.m AS b_value FROM l a JOIN l b USING (cell, rep) WHERE a.system = 'a' AND b.system = 'b'""")
def paired_last_row(v):
    coarse = good(v).withColumn("rep", F.expr("cast(cast(rep AS bigint) div 10 AS string)"))
    return rf.paired(coarse, "a", "b", "cell", "run_id").drop("delta")


@query("paired_by_position", """
    WITH r AS (SELECT cell, system, makespan_s, row_number() OVER (PARTITION BY cell, system ORDER BY run_id) AS position
      FROM v_runs WHERE phase = 'Succeeded')
    SELECT a.cell, position, a.makespan_s AS a_value, b.makespan_s AS b_value, round(b.makespan_s - a.makespan_s, 6) AS delta
    FROM r a JOIN r b USING (cell, position) WHERE a.system = 'a' AND b.system = 'b'""")
def paired_by_position(v):
    return rounded(rf.paired_by_position(good(v), "a", "b", "cell", "run_id"), "delta")


@query("edge_transfers", """
    SELECT e.run, e.dep AS src_task, e.child AS dst_task, p.node AS src_node, c.node AS dst_node, p.bytes,
      round(greatest(c.start_ - p.end_, 0), 6) AS transfer_sec
    FROM v_edges e JOIN v_dag c ON e.run = c.run AND e.child = c.task JOIN v_dag p ON e.run = p.run AND e.dep = p.task
    WHERE p.node <> c.node""")
def edge_transfers(v):
    return rounded(rf.edge_transfers(v.dag, v.dag), "transfer_sec")


CANDIDATES = """candidates AS (SELECT DISTINCT template, task, 'img' || (CAST(substr(task, 5) AS INT) % 3) AS image, 'n' || k AS node,
      CASE WHEN template = '2-HIGH' THEN NULL WHEN template = '1-URGENT' THEN 0.0::DOUBLE ELSE 7.5::DOUBLE END AS runtime,
      CASE WHEN template = '5-LOW' THEN 3.25::DOUBLE END AS hint FROM v_obs, range(0, 10) t(k))"""


def candidates(v):
    seen = v.kept_obs.select("template", "task", "image").distinct()
    return seen.withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(
        F.lit("n"), k.cast("string"))))).selectExpr(
        "template", "task", "image", "node",
        "CASE template WHEN '2-HIGH' THEN null WHEN '1-URGENT' THEN 0.0D ELSE 7.5D END AS runtime",
        "if(template = '5-LOW', map(node, 3.25D), cast(map() AS map<string, double>)) AS runtime_profile",
        "CASE template WHEN '2-HIGH' THEN '' WHEN '1-URGENT' THEN '1.5KB' ELSE '2MB' END AS data_size")


def profiles(v):
    by_task = rf.ema_profile(v.kept_obs, ["template", "task", "node"], OBS_ORDER)
    by_image = rf.ema_profile(v.kept_obs, ["image", "node"], OBS_ORDER)
    return by_task, by_image


@query("resolve_runtime", f"""
    WITH {CANDIDATES}
    SELECT c.template, c.task, c.node, round(coalesce(t.runtime_ema, i.runtime_ema, hint, CASE WHEN runtime > 0 THEN runtime END, 10.0), 6) AS resolved_runtime
    FROM candidates c LEFT JOIN (SELECT * FROM v_ema WHERE samples >= 60) t USING (template, task, node)
    LEFT JOIN (SELECT * FROM v_image_ema WHERE samples >= 60) i ON c.image = i.image AND c.node = i.node""")
def resolve_runtime(v):
    out = rf.resolve_runtime(candidates(v), *profiles(v), min_samples=60)
    return rounded(out.select("template", "task", "node", "resolved_runtime"), "resolved_runtime")


@query("resolve_runtime_manual", f"""
    WITH {CANDIDATES}
    SELECT template, task, node, coalesce(hint, CASE WHEN runtime > 0 THEN runtime END, 12.0) AS resolved_runtime FROM candidates""")
def resolve_runtime_manual(v):
    return rf.resolve_runtime(candidates(v), *profiles(v), source="manual", default=12).select(
        "template", "task", "node", "resolved_runtime")


@query("resolve_bytes", f"""
    WITH {CANDIDATES}
    SELECT c.template, c.task, c.node, CAST(coalesce(trunc(t.data_ema), trunc(i.data_ema),
      CASE template WHEN '2-HIGH' THEN 4096 WHEN '1-URGENT' THEN 1500 ELSE 2000000 END) AS BIGINT) AS resolved_bytes
    FROM candidates c LEFT JOIN (SELECT * FROM v_ema JOIN v_ema_data USING (template, task, node) WHERE samples >= 60 AND data_ema > 0) t
      USING (template, task, node)
    LEFT JOIN (SELECT * FROM v_image_ema JOIN v_image_data USING (image, node) WHERE samples >= 60 AND data_ema > 0) i
      ON c.image = i.image AND c.node = i.node""")
def resolve_bytes(v):
    out = rf.resolve_bytes(candidates(v), *profiles(v), min_samples=60, default="4KiB")
    return out.select("template", "task", "node", "resolved_bytes")


def link_profiles(v):
    edges = v.kept_obs.withColumnRenamed("task", "src_task")
    return rf.link_ema(edges, OBS_ORDER).withColumnsRenamed(
        {"transfer_sec_ema": "transfer_sec", "data_ema": "data_bytes"})


def link_config(v):
    return v.flows.groupBy("src", "dst").agg(F.max("bytes").cast("double").alias("bytes_per_sec"))


LINK_CONFIG = "config AS (SELECT src, dst, CAST(max(bytes) AS DOUBLE) AS rate FROM v_flows GROUP BY src, dst)"


# every link of the flows, and from every node to n0: nodes without flows have neither a configured nor an observed rate
@query("resolve_bandwidth", f"""
    WITH {LINK_CONFIG}, pairs AS (SELECT src, dst FROM v_flows UNION SELECT node, 'n0' FROM v_nodes)
    SELECT src, dst, round(CASE WHEN src = dst THEN 0 ELSE coalesce(o.bandwidth, rate, 5e6) END, 3) AS hybrid,
      round(CASE WHEN src = dst THEN 0 ELSE coalesce(rate, 5e6) END, 3) AS external,
      round(CASE WHEN src = dst THEN 0 ELSE coalesce(o.bandwidth, 5e6) END, 3) AS profiler
    FROM pairs LEFT JOIN v_observed o USING (src, dst) LEFT JOIN config USING (src, dst)""")
def resolve_bandwidth(v):
    pairs = v.flows.select("src", "dst").union(v.nodes.select("node", F.lit("n0"))).distinct()
    observed = rf.observed_bandwidth(link_profiles(v))
    for source in ("hybrid", "external", "profiler"):
        pairs = rf.resolve_bandwidth(pairs, observed, link_config(v), source, 5e6).withColumnRenamed("bandwidth", source)
    return rounded(pairs, "hybrid", "external", "profiler", digits=3)


@query("with_frame_meta", """
    WITH d AS (SELECT camera, det_id, frame, CASE WHEN class_id = 1 THEN frame || '.png' WHEN class_id = 2 THEN frame || '.bmp' ELSE frame || '.jpg' END AS name FROM v_boxes),
    f AS (SELECT DISTINCT camera, frame || '.jpg' AS name, CAST(frame AS BIGINT) % 640 AS orig_w FROM v_boxes)
    SELECT d.camera, det_id, orig_w FROM d JOIN f ON d.camera = f.camera AND replace(d.name, '.png', '.jpg') = f.name""")
def with_frame_meta(v):
    dets = v.boxes.selectExpr(
        "camera", "det_id", "concat(frame, CASE class_id WHEN 1 THEN '.png' WHEN 2 THEN '.bmp' ELSE '.jpg' END) AS frame")
    frames = v.boxes.selectExpr("camera", "concat(frame, '.jpg') AS frame", "cast(frame AS bigint) % 640 AS orig_w").distinct()
    return rf.with_frame_meta(dets, frames).drop("frame")


@query("with_embeddings", """
    SELECT class_id, CASE class_id WHEN 1 THEN 'no_embedding' WHEN 8 THEN 'no_detection' ELSE 'both' END AS match, count(*) AS rows FROM
      (SELECT class_id FROM v_boxes UNION ALL SELECT 8 FROM v_boxes WHERE class_id = 2) GROUP BY ALL""")
def with_embeddings(v):
    dets = v.boxes.select("camera", F.col("det_id").alias("det_index"), "class_id")
    embs = v.boxes.where("class_id <> 1").select("camera", F.col("det_id").alias("det_index"), "embedding")
    extra = v.boxes.where("class_id = 2").select("camera", F.concat("det_id", F.lit("x")).alias("det_index"), "embedding")
    out = rf.with_embeddings(dets, embs.unionByName(extra))
    return (out.withColumn("class_id", F.coalesce("class_id", F.lit(8))).groupBy("class_id", "match")
            .agg(F.count(F.lit(1)).alias("rows")))


REPORT_TRACKS = """
    report AS (SELECT o_orderpriority AS cell, CAST(o_custkey % 11 AS VARCHAR) AS rep,
      row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 11 ORDER BY o_orderkey) AS pos,
      o_orderstatus AS class, 'cam-' || (o_orderkey % 4) AS cameras, o_custkey % 5 AS hop_count, o_custkey % 11 AS r, o_orderkey AS k FROM orders),
    other AS (SELECT cell, rep, pos, CASE WHEN r = 3 AND pos = 2 THEN 'Z' ELSE class END AS class, cameras,
      CASE WHEN r = 5 AND pos <= 3 THEN hop_count + 1 ELSE hop_count END AS hop_count FROM report WHERE NOT (r = 7 AND pos = 1))"""


def report_tracks(v):
    tracks = v.table("orders").selectExpr(
        "o_orderpriority AS cell", "cast(o_custkey % 11 AS string) AS rep", "o_orderkey AS k", "o_orderstatus AS class",
        "concat('cam-', o_orderkey % 4) AS cameras", "o_custkey % 5 AS hop_count", "o_custkey % 11 AS r")
    report = rf.scan(tracks, ["cell", "rep"], "k", {"pos": ("row_number",)})
    other = report.where("NOT (r = 7 AND pos = 1)").selectExpr(
        "cell", "rep", "pos", "if(r = 3 AND pos = 2, 'Z', class) AS class", "cameras",
        "if(r = 5 AND pos <= 3, hop_count + 1, hop_count) AS hop_count")
    return report, other


@query("diff_reports", f"""
    WITH {REPORT_TRACKS},
    na AS (SELECT cell, rep, count(*) AS n FROM report GROUP BY ALL), nb AS (SELECT cell, rep, count(*) AS n FROM other GROUP BY ALL),
    ca AS (SELECT cell, rep, class, count(*) AS c FROM report GROUP BY ALL), cb AS (SELECT cell, rep, class, count(*) AS c FROM other GROUP BY ALL),
    j AS (SELECT a.cell, a.rep, a.pos, a.class AS ac, b.class AS bc, a.hop_count AS ah, b.hop_count AS bh
      FROM report a JOIN other b USING (cell, rep, pos) JOIN na USING (cell, rep) JOIN nb USING (cell, rep) WHERE na.n = nb.n)
    SELECT cell, rep, 'n_tracks' AS finding, NULL::BIGINT AS pos, CAST(na.n AS VARCHAR) AS left_value, CAST(coalesce(nb.n, 0) AS VARCHAR) AS right_value
      FROM na LEFT JOIN nb USING (cell, rep) WHERE na.n <> coalesce(nb.n, 0)
    UNION ALL SELECT cell, rep, 'counts_by_class', NULL, class || '=' || coalesce(ca.c, 0), class || '=' || coalesce(cb.c, 0)
      FROM ca FULL JOIN cb USING (cell, rep, class) WHERE coalesce(ca.c, 0) <> coalesce(cb.c, 0)
    UNION ALL SELECT cell, rep, 'class', pos, ac, bc FROM j WHERE ac <> bc
    UNION ALL SELECT cell, rep, 'hop_count', pos, CAST(ah AS VARCHAR), CAST(bh AS VARCHAR) FROM j WHERE ah <> bh""")
def diff_reports(v):
    report, other = report_tracks(v)
    return rf.diff_reports(report, other, ["cell", "rep"])


@query("correctness_rollup", f"""
    WITH {REPORT_TRACKS},
    reps AS (SELECT cell, rep, r, count(*) AS tracks FROM report GROUP BY ALL),
    pos2 AS (SELECT cell, rep, max(pos) AS n FROM report GROUP BY ALL)
    SELECT cell, count(*) AS reps, count(*) FILTER (r NOT IN (3, 5, 7, 9)) AS ok, count(*) FILTER (r IN (3, 5, 7)) AS fail,
      count(*) FILTER (r = 9) AS no_report, round(avg(CASE WHEN r <> 9 THEN tracks END), 6) AS mean_tracks, 'F,O,P' AS classes
    FROM reps GROUP BY cell""")
def correctness_rollup(v):
    report, other = report_tracks(v)
    made = report.where("r <> 9")
    per_class = made.groupBy("cell", "rep", "class").agg(F.count(F.lit(1)).alias("tracks"))
    expected = report.select("cell", "rep").distinct()
    diffs = rf.diff_reports(made, other.where("rep <> '9'"), ["cell", "rep"])
    return rounded(rf.correctness_rollup(diffs, per_class, expected), "mean_tracks")


CLUSTER = """
    view AS (SELECT n.node, cpu_alloc, mem_alloc, ready, schedulable, coalesce(u.cpu_used, 0) AS cpu_used, coalesce(u.mem_used, 0) AS mem_used,
      coalesce(d.disk_used, 0) AS disk_used, coalesce(t.running_tasks, 0) AS running_tasks, coalesce(t.total_tasks, 0) AS total_tasks
    FROM v_nodes n LEFT JOIN v_usage u USING (node) LEFT JOIN (SELECT node, arg_max(disk_used, ts) AS disk_used FROM v_disk GROUP BY node) d USING (node)
    LEFT JOIN (SELECT node, count(*) FILTER (phase = 'Running') AS running_tasks, count(*) AS total_tasks FROM v_disk GROUP BY node) t USING (node))"""


def cluster(v):
    return rf.cluster_view(v.nodes, v.usage, v.disk.select("node", "ts", "disk_used"), v.disk.select("node", "phase"))


@query("cluster_view", f"""
    WITH {CLUSTER} SELECT *, round(CASE WHEN cpu_alloc > 0 THEN cpu_used / cpu_alloc * 100 ELSE 0 END, 6) AS cpu_pct,
      round(CASE WHEN mem_alloc > 0 THEN mem_used / mem_alloc * 100 ELSE 0 END, 6) AS mem_pct FROM view""")
def cluster_view(v):
    return rounded(cluster(v), "cpu_pct", "mem_pct")


@query("cluster_totals", f"""
    WITH {CLUSTER} SELECT count(*) AS nodes, count(*) FILTER (ready AND schedulable) AS usable, CAST(sum(cpu_used) AS BIGINT) AS cpu_used,
      CAST(sum(cpu_alloc) AS BIGINT) AS cpu_alloc, CAST(sum(mem_used) AS BIGINT) AS mem_used, CAST(sum(mem_alloc) AS BIGINT) AS mem_alloc,
      CAST(sum(disk_used) AS BIGINT) AS disk_used, CAST(sum(running_tasks) AS BIGINT) AS running_tasks FROM view""")
def cluster_totals(v):
    return rf.cluster_totals(cluster(v))


STARTED = """
    started AS (SELECT run, task, CASE WHEN role = 'user' THEN 'Succeeded' ELSE 'Running' END AS phase FROM v_dag WHERE turn < 2 + conv_id % 3),
    ready AS (SELECT run, task, 'n' || k AS node FROM v_dag, range(0, 3) t(k) WHERE (conv_id + turn + k) % 4 <> 0),
    assign AS (SELECT run, task, node, conv_id % 5 <> 0 AS has_agent FROM v_dag)"""


def ready_inputs(v):
    started = v.dag.where("turn < 2 + conv_id % 3").selectExpr("run", "task", "if(role = 'user', 'Succeeded', 'Running') AS phase")
    ready = (v.dag.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("(conv_id + turn + k) % 4 <> 0")
             .selectExpr("run", "task", "concat('n', k) AS node"))
    assign = v.dag.selectExpr("run", "task", "node", "conv_id % 5 <> 0 AS has_agent")
    return v.dag.select("run", "task", "deps"), started, ready, assign


@query("ready_tasks", f"""
    WITH {STARTED}, todo AS (SELECT run, task FROM v_dag EXCEPT SELECT run, task FROM started),
    blocked AS (SELECT DISTINCT e.run, e.child AS task FROM v_edges e JOIN assign a ON e.run = a.run AND e.child = a.task
      LEFT JOIN started s ON e.run = s.run AND e.dep = s.task LEFT JOIN ready r ON e.run = r.run AND e.dep = r.task AND a.node = r.node
      WHERE s.task IS NULL OR (has_agent AND r.task IS NULL) OR (NOT has_agent AND s.phase <> 'Succeeded'))
    SELECT run, task FROM todo EXCEPT SELECT run, task FROM blocked""")
def ready_tasks(v):
    return rf.ready_tasks(*ready_inputs(v))


@query("predicted_vs_actual", """
    SELECT run_name, makespan_s AS actual, round(makespan_s + run_id % 7, 6) AS predicted FROM v_runs""")
def predicted_vs_actual(v):
    parts = v.runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(
        "run_name", "(makespan_s + run_id % 7) / (k + 1) AS est_end")
    return rounded(rf.predicted_vs_actual(v.runs, parts), "predicted")


@query("pick_flows", """
    SELECT flow_id, run, 'actual' AS flow_source FROM v_flows WHERE ok
    UNION ALL SELECT flow_id, run, 'predicted' FROM v_flows WHERE run NOT IN (SELECT run FROM v_flows WHERE ok)""")
def pick_flows(v):
    flows = v.flows.select("flow_id", "run", "ok")
    return rf.pick_flows(flows.where("ok").drop("ok"), flows.drop("ok"))


@query("owned_by", """
    SELECT 'c' || conv_id AS run, 'u' || conv_id AS uid, conv_id || '-' || turn AS pod FROM conversations WHERE turn % 3 <> 2""")
def owned_by(v):
    talks = v.table("conversations")
    pods = talks.selectExpr("concat(conv_id, '-', turn) AS pod",
                            "if(turn % 3 = 2, array('x'), array('y', concat('u', conv_id), concat('u', conv_id))) AS owner_uids")
    runs = talks.selectExpr("concat('u', conv_id) AS uid", "concat('c', conv_id) AS run").distinct()
    return rf.owned_by(pods, runs)


@query("flow_contention", f"""
    WITH {LINK_CONFIG},
    e AS (SELECT src, t, sum(sum(d)) OVER (PARTITION BY src ORDER BY t) AS egress FROM v_steps GROUP BY src, t),
    i AS (SELECT dst, t, sum(sum(d)) OVER (PARTITION BY dst ORDER BY t) AS ingress FROM v_steps GROUP BY dst, t)
    SELECT flow_id, f.src, f.dst, CAST(egress AS BIGINT) AS egress, CAST(ingress AS BIGINT) AS ingress, round(bytes / rate, 6) AS ideal_sec,
      round(end_ - start_, 6) AS actual_sec, coalesce(end_ - start_ > bytes / rate * 1.01, false) AS slower
    FROM v_flows f JOIN e ON f.src = e.src AND f.start_ = e.t JOIN i ON f.dst = i.dst AND f.start_ = i.t
    LEFT JOIN config c ON f.src = c.src AND f.dst = c.dst""")
def flow_contention(v):
    out = rf.flow_contention(v.flows, link_config(v).withColumnRenamed("bytes_per_sec", "bandwidth"))
    return rounded(out, "ideal_sec", "actual_sec")


@query("sort_runs", """
    WITH r AS (SELECT run_id, CASE WHEN phase = 'Failed' THEN NULL ELSE makespan_s END AS m FROM v_runs)
    SELECT run_id, row_number() OVER (ORDER BY m ASC NULLS LAST, run_id) AS place,
      row_number() OVER (ORDER BY m DESC NULLS FIRST, run_id) AS place_desc FROM r""")
def sort_runs(v):
    """The places that rows have in the frames as returned, both ways."""
    open_ = v.runs.select("run_id", F.expr("if(phase = 'Failed', null, makespan_s)").alias("m"))

    def places(desc, name):
        numbered = cut(rf.sort_runs(open_, "m", desc).withColumn("_at", F.monotonically_increasing_id()))
        return rf.scan(numbered, None, "_at", {name: ("row_number",)}).select("run_id", name)

    return places(False, "place").join(places(True, "place_desc"), "run_id")


@query("natural_reps", """
    SELECT rep, row_number() OVER (ORDER BY try_cast(rep AS BIGINT) IS NULL, try_cast(rep AS BIGINT), rep) AS place FROM
      (SELECT DISTINCT CASE WHEN phase = 'Failed' THEN 'retry-' || rep ELSE rep END AS rep FROM v_runs)""")
def natural_reps(v):
    reps = v.runs.selectExpr("if(phase = 'Failed', concat('retry-', rep), rep) AS rep").distinct()
    keyed = reps.select("rep", *[c.alias(n) for c, n in zip(rf.natural_rep("rep"), ("is_text", "number", "label"))])
    return rf.scan(keyed, None, ["is_text", "number", "label"], {"place": ("row_number",)}).select("rep", "place")


@query("cell_order", """
    SELECT cell, row_number() OVER (ORDER BY n, d, p, cell) AS place FROM (SELECT DISTINCT o_custkey % 4 AS n, (o_custkey % 5) * 30 AS d,
      o_orderkey % 2 AS p, 'n' || (o_custkey % 4) || '-d' || ((o_custkey % 5) * 30) || CASE WHEN o_orderkey % 2 = 1 THEN '-png' ELSE '-jpg' END AS cell FROM orders)""")
def cell_order(v):
    cells = v.table("orders").selectExpr(
        "concat('n', o_custkey % 4, '-d', (o_custkey % 5) * 30, if(o_orderkey % 2 = 1, '-png', '-jpg')) AS cell").distinct()
    names = ["cameras", "duration", "png", "label"]
    keyed = cells.select("cell", *[c.alias(n) for c, n in zip(rf.cell_sort_key("cell"), names)])
    return rf.scan(keyed, None, names, {"place": ("row_number",)}).select("cell", "place")


@query("top_values", """
    SELECT row_number() OVER (ORDER BY makespan_s DESC, run_id) AS rank, makespan_s, run_id FROM v_runs QUALIFY rank <= 5""")
def top_values(v):
    return rf.top_values(v.runs, "makespan_s", 5, ("run_id",)).withColumn("rank", F.col("rank").cast("long"))


@query("newest_runs", "SELECT run_id, run_name FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 50")
def newest_runs(v):
    return rf.by_created(v.runs, desc=True, n=50).select("run_id", "run_name")


@query("fan_in", """
    SELECT source, source_pos, count(*) AS rows, round(sum(value), 4) AS total FROM
      (SELECT l_returnflag AS source, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS source_pos, l_quantity AS value FROM lineitem)
    GROUP BY ALL""")
def fan_in(v):
    lines = v.table("lineitem").select("l_returnflag", F.col("l_quantity").alias("value"))
    merged = rf.fan_in({flag: lines.where(F.col("l_returnflag") == flag).select("value") for flag in ("R", "N", "A")})
    return merged.groupBy("source", "source_pos").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("node_set", "SELECT node FROM v_tasks UNION SELECT src FROM v_flows UNION SELECT dst FROM v_flows UNION SELECT node FROM v_nodes")
def node_set(v):
    return rf.node_set(v.tasks, v.flows, v.nodes)


@query("minus_runs", "SELECT run_id FROM v_runs WHERE phase <> 'Failed' AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def minus_runs(v):
    evicted = v.table("lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS run_id")
    return rf.minus(v.runs.where("phase <> 'Failed'"), evicted, "run_id").select("run_id")


@query("common_keys", PAIRS + " SELECT cell, rep FROM a INTERSECT SELECT cell, rep FROM b")
def common_keys(v):
    return rf.common_keys(v.runs.where("system = 'a' AND phase = 'Succeeded'"),
                          v.runs.where("system = 'b' AND phase = 'Succeeded'"), ["cell", "rep"])
