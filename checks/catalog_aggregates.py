"""Roll-ups and statistics."""

from pyspark.sql import functions as F

import runframe as rf
from checks.catalog_joins import LINK_CONFIG, PAIRS, link_config, link_profiles
from checks.registry import query, rounded
from checks.views import OBS_ORDER

RULE_SQL = {
    "lower": "floor((n - 1) * 0.95::DOUBLE)", "round": "greatest(round_even(n * 0.95::DOUBLE, 0) - 1, 0)",
    "floor": "least(n - 1, floor(n * 0.95::DOUBLE))", "trunc": "least(n - 1, floor(n * 0.95::DOUBLE))", "pct": "least(floor(n * 95 / 100), n - 1)",
}


def good(v):
    return v.runs.where("phase = 'Succeeded'")


@query("run_report", """
    WITH o AS (SELECT *, max(end_) OVER (PARTITION BY run, node ORDER BY start_, end_, task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_tasks),
    busy AS (SELECT run, node, sum(greatest(end_ - greatest(start_, coalesce(reach, start_)), 0)) AS busy, greatest(max(end_) - min(start_), 0.001) AS span,
      count(*) AS intervals FROM o GROUP BY run, node),
    s AS (SELECT run, node, start_ AS t, 1 AS d FROM v_tasks UNION ALL SELECT run, node, end_, -1 FROM v_tasks),
    c AS (SELECT run, node, sum(d) OVER (PARTITION BY run, node ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM s),
    deep AS (SELECT run, node, greatest(max(open), 0) AS max_overlap FROM c GROUP BY run, node),
    f AS (SELECT run, count(*) AS n_tasks, count(*) FILTER (phase = 'Failed') AS n_failed, count(*) FILTER (phase = 'Succeeded') AS n_ok,
      max(end_) - min(start_) AS makespan FROM v_tasks GROUP BY run)
    SELECT run, node, round(busy, 3) AS busy, round(span, 3) AS span, intervals, round(least(100, busy / span * 100), 4) AS busy_pct,
      CAST(CASE WHEN intervals = 1 THEN 1 ELSE max_overlap END AS BIGINT) AS max_overlap,
      CASE WHEN n_failed > 0 THEN 'Failed' WHEN n_ok = n_tasks THEN 'Succeeded' ELSE 'Running' END AS phase,
      round(makespan, 3) AS makespan, n_tasks, n_failed
    FROM busy JOIN deep USING (run, node) JOIN f USING (run)""")
def run_report(v):
    totals = v.tasks.groupBy("run").agg(F.count(F.lit(1)).alias("total_tasks"))
    out = rf.run_report(v.tasks, totals)
    return rounded(rounded(out, "busy", "span", "makespan", digits=3), "busy_pct", digits=4)


@query("run_rollup", """
    WITH t AS (SELECT run, task, start_, end_, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 1 THEN 'Failed' WHEN conv_id % 3 = 1 AND turn = 1 THEN 'Running'
      ELSE 'Succeeded' END AS phase, CASE WHEN turn = 1 THEN 'OOMKilled' END AS reason, conv_id FROM v_dag)
    SELECT run, count(*) AS n_tasks, count(*) FILTER (phase = 'Failed') AS n_failed,
      CASE WHEN bool_or(phase = 'Failed') THEN 'Failed' WHEN bool_and(phase = 'Succeeded') AND any_value(conv_id) % 7 <> 0 THEN 'Succeeded' ELSE 'Running' END AS phase,
      CASE WHEN bool_or(phase = 'Failed') THEN 'task "' || min(task) FILTER (phase = 'Failed') || '" failed (' ||
        coalesce(arg_min(reason, task) FILTER (phase = 'Failed' AND task = 't1'), 'pod failed') || ')' END AS message,
      round(greatest(max(end_) - min(start_), 0), 6) AS makespan FROM t GROUP BY run""")
def run_rollup(v):
    tasks = v.dag.withColumns({
        "phase": F.expr("CASE WHEN conv_id % 3 = 0 AND turn % 2 = 1 THEN 'Failed' WHEN conv_id % 3 = 1 AND turn = 1 THEN 'Running' ELSE 'Succeeded' END"),
        "reason": F.expr("if(turn = 1, 'OOMKilled', null)")})
    totals = v.dag.groupBy("run").agg(F.expr("count(*) + if(any_value(conv_id) % 7 = 0, 1, 0)").alias("total_tasks"))
    return rounded(rf.run_rollup(tasks, totals), "makespan")


@query("finalize_stale", """
    WITH t AS (SELECT run, CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN 'Running' WHEN conv_id % 4 = 1 AND turn = 1 THEN 'Failed' ELSE 'Succeeded' END AS phase, conv_id
      FROM v_dag WHERE conv_id % 5 <> 0),
    r AS (SELECT DISTINCT run, conv_id FROM v_dag WHERE conv_id % 6 <> 0),
    s AS (SELECT run, count(*) FILTER (phase = 'Running') AS live, count(*) FILTER (phase = 'Succeeded') AS ok, count(*) FILTER (phase = 'Failed') AS bad FROM t GROUP BY run)
    SELECT run, CASE WHEN coalesce(ok + bad, 0) = 0 THEN 'Failed' WHEN bad = 0 THEN 'Succeeded' ELSE 'Failed' END AS phase,
      CASE WHEN coalesce(ok + bad, 0) = 0 THEN 'stale: no tasks found' WHEN bad = 0 THEN 'reconciled: all tasks succeeded' ELSE 'reconciled: one or more tasks failed' END AS message
    FROM r LEFT JOIN s USING (run) WHERE coalesce(live, 0) = 0""")
def finalize_stale(v):
    tasks = v.dag.where("conv_id % 5 <> 0").selectExpr(
        "run", "CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN 'Running' WHEN conv_id % 4 = 1 AND turn = 1 THEN 'Failed' ELSE 'Succeeded' END AS phase")
    runs = v.dag.selectExpr("run", "if(conv_id % 6 = 0, 'Succeeded', 'Running') AS phase").distinct()
    return rf.finalize_stale(runs, tasks)


@query("cell_stats", """
    WITH g AS (SELECT cell, system, makespan_s, row_number() OVER (PARTITION BY cell, system ORDER BY makespan_s) - 1 AS k,
      count(*) OVER (PARTITION BY cell, system) AS n FROM v_runs WHERE phase = 'Succeeded')
    SELECT cell, system, count(*) AS n, round(avg(makespan_s), 6) AS mean, round(stddev_pop(makespan_s), 6) AS std,
      max(makespan_s) FILTER (k = floor((n - 1) * 0.95::DOUBLE)) AS p95 FROM g GROUP BY cell, system""")
def cell_stats(v):
    return rounded(rf.cell_stats(good(v), ["cell", "system"], "makespan_s"), "mean", "std")


for _rule, _place in RULE_SQL.items():
    @query(f"nearest_rank_{_rule}", f"""
        WITH g AS (SELECT cell, makespan_s, row_number() OVER (PARTITION BY cell ORDER BY makespan_s) - 1 AS k, count(*) OVER (PARTITION BY cell) AS n FROM v_runs)
        SELECT cell, makespan_s AS percentile FROM g WHERE k = {_place}""")
    def nearest_rank(v, rule=_rule):
        return rf.nearest_rank(v.runs, "cell", "makespan_s", 0.95, rule)


@query("nearest_rank_linear", "SELECT cell, round(quantile_cont(makespan_s, 0.95), 6) AS percentile FROM v_runs GROUP BY cell")
def nearest_rank_linear(v):
    return rounded(rf.nearest_rank(v.runs, "cell", "makespan_s", 0.95, "linear"), "percentile")


@query("history_stats", """
    WITH g AS (SELECT template, makespan_s, row_number() OVER (PARTITION BY template ORDER BY makespan_s) - 1 AS k, count(*) OVER (PARTITION BY template) AS n
      FROM v_runs WHERE phase = 'Succeeded')
    SELECT template, count(*) AS n, round(avg(makespan_s), 6) AS mean, min(makespan_s) AS min, max(makespan_s) AS max, round(stddev_pop(makespan_s), 6) AS std,
      round(median(makespan_s), 6) AS median, max(makespan_s) FILTER (k = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95 FROM g GROUP BY template""")
def history_stats(v):
    runs = v.runs.withColumn("makespan_s", F.expr("if(phase = 'Failed', 0.0D, makespan_s)"))
    return rounded(rf.history_stats(runs, "template"), "mean", "std", "median")


@query("histogram", """
    WITH g AS (SELECT cell, min(makespan_s) AS lo, (max(makespan_s) - min(makespan_s)) / 12 AS w FROM v_runs GROUP BY cell),
    c AS (SELECT r.cell, CAST(least(floor((makespan_s - lo) / w), 11) AS INTEGER) AS bin, count(*) AS count FROM v_runs r JOIN g ON r.cell = g.cell GROUP BY ALL)
    SELECT g.cell, CAST(b AS INTEGER) AS bin, round(lo + b * w, 9) AS lo, coalesce(count, 0) AS count FROM g CROSS JOIN range(0, 12) t(b)
    LEFT JOIN c ON c.cell = g.cell AND c.bin = b""")
def histogram(v):
    return rounded(rf.histogram(v.runs, "cell", "makespan_s", 12), "lo", digits=9)


@query("merge_counts", "SELECT l_returnflag AS source, count(l_quantity) AS count FROM lineitem GROUP BY ALL")
def merge_counts(v):
    lines = v.table("lineitem").withColumnRenamed("l_returnflag", "source")
    return rf.merge_summary(lines, "source", "l_quantity")[0]


@query("merge_summary", """
    SELECT count(l_extendedprice) AS count, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS mean,
      min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem""")
def merge_summary(v):
    return rf.merge_summary(v.table("lineitem"), "l_returnflag", "l_extendedprice")[1]


@query("fuse_detections", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY confidence DESC, det_id) AS k FROM v_dets)
    SELECT class, count(*) AS count, count(DISTINCT sensor) AS n_sensors, round(avg(confidence) FILTER (k <= 5), 3) AS avg_confidence,
      string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5) AS top_detections FROM r GROUP BY class""")
def fuse_detections(v):
    return rf.fuse_detections(v.dets).withColumn("top_detections", F.array_join(F.col("top_detections").cast("array<string>"), ","))


@query("source_counts", "SELECT sensor, count(*) AS detections FROM v_dets GROUP BY sensor")
def source_counts(v):
    return rf.source_counts(v.dets)


@query("majority_class", """
    WITH p AS (SELECT o_custkey, o_orderstatus AS class, sum(o_custkey % 3 + 1) AS w, min(o_orderkey) AS first FROM orders GROUP BY ALL)
    SELECT o_custkey, class, CAST(w AS BIGINT) AS class_weight FROM p QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, first) = 1""")
def majority_class(v):
    votes = v.table("orders").selectExpr("o_custkey", "o_orderstatus AS class", "o_custkey % 3 + 1 AS det_count", "o_orderkey AS pos")
    return rf.majority_class(votes, "o_custkey")


HOPS = """
    hops AS (SELECT tracklet_id % 37 AS global_id, camera, tracklet_id, frame_first, frame_last, det_count FROM v_tracklets),
    tracks AS (SELECT DISTINCT tracklet_id % 37 AS global_id, 'class' || (tracklet_id % 37 % 3) AS class FROM v_tracklets)"""


def report(v):
    hops = v.tracklets.withColumn("global_id", F.expr("tracklet_id % 37"))
    tracks = hops.selectExpr("global_id", "concat('class', global_id % 3) AS class").distinct()
    return rf.traffic_report(tracks, hops.drop("embedding", "class"))


@query("traffic_counts", f"WITH {HOPS} SELECT class, count(*) AS tracks FROM tracks GROUP BY class")
def traffic_counts(v):
    return report(v)[0]


@query("traffic_report", f"""
    WITH {HOPS}, s AS (SELECT global_id, class, count(*) AS hop_count, CAST(sum(det_count) AS BIGINT) AS det_count_total,
      string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras FROM tracks JOIN hops USING (global_id) GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY class, det_count_total DESC, global_id) AS rank FROM s""")
def traffic_report(v):
    return report(v)[1]


@query("traffic_hops", f"""
    WITH {HOPS} SELECT global_id, tracklet_id, row_number() OVER (PARTITION BY global_id ORDER BY frame_first, camera, tracklet_id) AS hop FROM hops""")
def traffic_hops(v):
    return report(v)[2].select("global_id", "tracklet_id", "hop")


@query("link_traffic", """
    SELECT src, dst, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS flows, round(sum(bytes) / max(sum(bytes)) OVER (), 9) AS share FROM v_flows GROUP BY src, dst""")
def link_traffic(v):
    return rounded(rf.link_traffic(v.flows), "share", digits=9)


@query("observed_bandwidth", "SELECT src, dst, round(bandwidth, 4) AS bandwidth FROM v_observed")
def observed_bandwidth(v):
    return rounded(rf.observed_bandwidth(link_profiles(v)), "bandwidth", digits=4)


@query("mean_pair_bandwidth", "SELECT count(*) AS pairs, round(avg(bandwidth), 4) AS mean_bandwidth FROM v_observed WHERE src < dst")
def mean_pair_bandwidth(v):
    return rounded(rf.mean_pair_bandwidth(rf.observed_bandwidth(link_profiles(v))), "mean_bandwidth", digits=4)


@query("ema_profile", """
    SELECT template, task, node, round(runtime_ema, 6) AS runtime_ema, samples, round(data_ema, 4) AS data_ema
    FROM v_ema JOIN v_ema_data USING (template, task, node)""")
def ema_profile(v):
    out = rf.ema_profile(v.kept_obs, ["template", "task", "node"], OBS_ORDER)
    return rounded(rounded(out, "runtime_ema"), "data_ema", digits=4)


@query("image_profile", """
    SELECT image, node, round(runtime_ema, 6) AS runtime_ema, samples, round(data_ema, 4) AS data_ema
    FROM v_image_ema JOIN v_image_data USING (image, node)""")
def image_profile(v):
    out = rf.ema_profile(v.kept_obs, ["image", "node"], OBS_ORDER)
    return rounded(rounded(out, "runtime_ema"), "data_ema", digits=4)


@query("link_profile", """
    SELECT template, src_task, dst_task, src, dst, round(transfer_sec, 6) AS transfer_sec, samples, round(data_bytes, 4) AS data_bytes
    FROM v_link_ema JOIN v_link_data USING (template, src_task, dst_task, src, dst)""")
def link_profile(v):
    return rounded(rounded(link_profiles(v), "transfer_sec"), "data_bytes", digits=4)


@query("warm_profile", """
    WITH w AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY created_at, run_id) AS run_number FROM v_runs),
    p AS (SELECT template, cell, makespan_s, row_number() OVER (PARTITION BY template, cell ORDER BY run_number) AS p,
      count(*) OVER (PARTITION BY template, cell) AS n FROM w WHERE run_number > 5)
    SELECT template, cell, round(sum(pow(0.5, n - p) * CASE WHEN p = 1 THEN 1 ELSE 0.5 END * makespan_s), 6) AS makespan_s_ema,
      least(max(n), 20) AS samples FROM p GROUP BY ALL""")
def warm_profile(v):
    out = rf.ema_profile(rf.number_runs(v.runs), ["template", "cell"], "run_number", "makespan_s", None, alpha=0.5,
                         max_samples=20, warmup=5, run_number="run_number")
    return rounded(out, "makespan_s_ema")


AGENTS = """
    agents AS (SELECT agent, arg_max(bytes_in, ts) - arg_min(bytes_in, ts) AS bytes_in_delta, arg_max(bytes_out, ts) - arg_min(bytes_out, ts) AS bytes_out_delta,
      arg_max(put_total, ts) - arg_min(put_total, ts) AS put_total_delta, arg_max(put_ok, ts) - arg_min(put_ok, ts) AS put_ok_delta,
      avg(cpu) AS cpu_mean, max(cpu) AS cpu_peak, avg(mem) AS mem_mean, max(mem) AS mem_peak, max(inflight) AS peak_inflight, count(*) AS samples,
      min(ts) AS first_ts, max(ts) AS last_ts FROM v_samples GROUP BY agent)"""


@query("agent_overhead", f"WITH {AGENTS} SELECT * REPLACE (round(cpu_mean, 6) AS cpu_mean, round(mem_mean, 6) AS mem_mean) FROM agents")
def agent_overhead(v):
    return rounded(rf.agent_overhead(v.samples)[0], "cpu_mean", "mem_mean")


@query("agent_totals", f"""
    WITH {AGENTS} SELECT count(*) AS agents, round(sum(cpu_peak), 6) AS cpu_peak, round(sum(mem_peak), 6) AS mem_peak,
      CAST(sum(bytes_in_delta) AS BIGINT) AS bytes_in_delta, CAST(sum(bytes_out_delta) AS BIGINT) AS bytes_out_delta,
      CAST(sum(put_total_delta) AS BIGINT) AS put_total_delta, CAST(sum(put_ok_delta) AS BIGINT) AS put_ok_delta,
      max(peak_inflight) AS peak_inflight, CAST(sum(samples) AS BIGINT) AS samples, max(last_ts) - min(first_ts) AS window_sec FROM agents""")
def agent_totals(v):
    return rounded(rf.agent_overhead(v.samples)[1], "cpu_peak", "mem_peak")


SPEEDUP = """
    st AS (SELECT cell, system, avg(makespan_s) AS mean, stddev_pop(makespan_s) AS std FROM v_runs WHERE phase = 'Succeeded' GROUP BY ALL),
    sp AS (SELECT a.cell, a.mean AS base_mean, b.mean AS other_mean, a.std AS base_std, b.std AS other_std, b.mean / a.mean AS speedup, b.std / a.std AS std_ratio
      FROM st a JOIN st b USING (cell) WHERE a.system = 'a' AND b.system = 'b')"""


@query("speedup", f"""WITH {SPEEDUP} SELECT cell, round(base_mean, 6) AS base_mean, round(other_mean, 6) AS other_mean, round(base_std, 6) AS base_std,
    round(other_std, 6) AS other_std, round(speedup, 6) AS speedup, round(std_ratio, 6) AS std_ratio FROM sp""")
def speedup(v):
    out = rf.speedup(rf.cell_stats(good(v), ["cell", "system"], "makespan_s"), "a", "b", "cell")
    return rounded(out, "base_mean", "other_mean", "base_std", "other_std", "speedup", "std_ratio")


@query("verdict", f"""WITH {SPEEDUP} SELECT round(min(speedup), 6) AS min_ratio, CASE WHEN min(speedup) >= 1.2 THEN 'PASS' WHEN min(speedup) >= 0.9 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict FROM sp""")
def verdict(v):
    ratios = rf.speedup(rf.cell_stats(good(v), ["cell", "system"], "makespan_s"), "a", "b", "cell")
    return rounded(rf.verdict(ratios, 1.2, 0.9), "min_ratio")


def deltas(v):
    return rf.paired(rf.valid_runs(v.runs), "a", "b", "cell", "run_id")


@query("paired_bootstrap", PAIRS + """,
    d AS (SELECT cell, b.makespan_s - a.makespan_s AS delta, CAST(row_number() OVER (PARTITION BY cell ORDER BY rep) - 1 AS BIGINT) AS j,
      count(*) OVER (PARTITION BY cell) AS n FROM a JOIN b USING (cell, rep)),
    seeds AS (SELECT cell, r, ('0x' || substr(md5('42|' || cell || '|' || r), 1, 8))::BIGINT % 2147483647 AS s1,
      ('0x' || substr(md5('42|' || cell || '|' || r), 9, 8))::BIGINT % 2147483647 AS s2 FROM (SELECT DISTINCT cell FROM d), range(0, 10000) t(r)),
    x1 AS (SELECT cell, r, n, s1, s2 + j // 2147483647 AS s2, (s1 + j * 69621) % 2147483647 AS x FROM d JOIN seeds USING (cell)),
    x2 AS (SELECT cell, r, n, s1, (x * x + s2) % 2147483647 AS x FROM x1),
    draws AS (SELECT cell, r, CAST((x * 2147483647 + (x * x + s1) % 2147483647) % n AS BIGINT) AS j FROM x2),
    m AS (SELECT cell, r, avg(delta) AS mean FROM draws JOIN d USING (cell, j) GROUP BY cell, r),
    k AS (SELECT cell, mean, row_number() OVER (PARTITION BY cell ORDER BY mean, r) - 1 AS k FROM m),
    ci AS (SELECT cell, max(mean) FILTER (k = 250) AS lo, max(mean) FILTER (k = 9750) AS hi FROM k GROUP BY cell),
    base AS (SELECT cell, avg(makespan_s) AS bm FROM b GROUP BY cell),
    f AS (SELECT cell, count(*) AS n_pairs, avg(delta) AS mean_delta, count(*) FILTER (delta > 0) AS wins FROM d GROUP BY cell)
    SELECT cell, n_pairs, round(mean_delta, 6) AS mean_delta, wins, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, round(bm, 6) AS baseline_mean,
      round(mean_delta / bm * 100, 6) AS speedup_pct, round(lo / bm * 100, 6) AS ci_lo_pct, round(hi / bm * 100, 6) AS ci_hi_pct
    FROM f JOIN ci USING (cell) JOIN base USING (cell)""")
def paired_bootstrap(v):
    baseline = rf.valid_runs(v.runs).where("system = 'b'").select("cell", "makespan_s")
    out = rf.paired_bootstrap(deltas(v), baseline, "cell", "rep")
    return rounded(out, *[c for c in out.columns if c not in ("cell", "n_pairs", "wins")])


@query("seed_speedup_median", """
    WITH r AS (SELECT cell, seed, avg(makespan_s) FILTER (system = 'b') / avg(makespan_s) FILTER (system = 'a') AS ratio FROM v_runs WHERE phase = 'Succeeded' GROUP BY ALL)
    SELECT cell, count(ratio) AS seeds, count(*) FILTER (ratio > 1) AS wins, round(median(ratio), 6) AS median_ratio FROM r GROUP BY cell""")
def seed_speedup_median(v):
    return rounded(rf.seed_speedup_median(good(v), "a", "b"), "median_ratio")


@query("grouped_means", """
    SELECT namespace, cell, round(avg(makespan_s) FILTER (system = 'a'), 6) AS mean_a, round(avg(makespan_s) FILTER (system = 'b'), 6) AS mean_b FROM v_runs GROUP BY ALL""")
def grouped_means(v):
    return rounded(rf.grouped_means(v.runs, ["namespace", "cell"], "system", ["a", "b"]), "mean_a", "mean_b")


@query("sensitivity", """
    SELECT system, template, count(*) AS n, round(avg(makespan_s), 6) AS mean, round(stddev_pop(makespan_s), 6) AS std FROM v_runs WHERE cell = '2-HIGH' GROUP BY ALL""")
def sensitivity(v):
    return rounded(rf.sensitivity(v.runs, "template", {"cell": "2-HIGH"}), "mean", "std")


@query("prediction_error", """
    WITH i AS (SELECT template, makespan_s AS actual, makespan_s + run_id % 7 AS predicted, row_number() OVER (PARTITION BY template ORDER BY created_at, run_id) AS iteration FROM v_runs)
    SELECT template, count(*) AS n, round(avg(abs(actual - predicted) / actual * 100), 6) AS mean_error_pct FROM i WHERE iteration > 4 GROUP BY template""")
def prediction_error(v):
    pairs = rf.number_runs(v.runs).selectExpr("template", "makespan_s AS actual", "makespan_s + run_id % 7 AS predicted", "run_number AS iteration")
    return rounded(rf.prediction_error(pairs, "template"), "mean_error_pct")


@query("template_summary", """
    SELECT t.template, t.task_count, count(r.run_id) AS run_count, arg_max(run_name, (created_at, run_id)) AS last_run, arg_max(phase, (created_at, run_id)) AS last_phase
    FROM (SELECT DISTINCT 't' || (c_custkey % 12) AS template, c_custkey % 12 + 1 AS task_count FROM customer) t LEFT JOIN v_runs r ON r.template = t.template GROUP BY ALL""")
def template_summary(v):
    templates = v.table("customer").selectExpr("concat('t', c_custkey % 12) AS template", "c_custkey % 12 + 1 AS task_count").distinct()
    return rf.template_summary(templates, v.runs)


@query("profile_matrix", """
    WITH s AS (SELECT *, min(runtime_ema) OVER w AS lo, max(runtime_ema) OVER w AS hi FROM v_ema WINDOW w AS (PARTITION BY template))
    SELECT template, task, node, round(runtime_ema, 6) AS runtime_ema, samples, CASE WHEN lo = hi THEN 'flat' WHEN (runtime_ema - lo) / (hi - lo) < 0.33 THEN 'low'
      WHEN (runtime_ema - lo) / (hi - lo) < 0.66 THEN 'mid' ELSE 'high' END AS band FROM s""")
def profile_matrix(v):
    profiles = rf.ema_profile(v.kept_obs, ["template", "task", "node"], OBS_ORDER, data=None)
    return rounded(rf.profile_matrix(profiles), "runtime_ema")


NODES = [f"n{i}" for i in range(8)]


@query("pivot_matrix", "SELECT template, task, " + ", ".join(
    f"round(max(runtime_ema) FILTER (node = '{n}'), 6) AS {n}" for n in NODES) + " FROM v_ema GROUP BY template, task")
def pivot_matrix(v):
    profiles = rf.ema_profile(v.kept_obs, ["template", "task", "node"], OBS_ORDER, data=None)
    return rounded(rf.pivot_matrix(profiles, NODES), *NODES)


@query("placement_share", """
    SELECT kind, node, count(*) AS placed, CAST(sum(count(*)) OVER (PARTITION BY kind) AS BIGINT) AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 9) AS share
    FROM v_tasks GROUP BY kind, node""")
def placement_share(v):
    return rounded(rf.placement_share(v.tasks, "kind"), "share", digits=9)


@query("link_classes", f"""
    WITH {LINK_CONFIG}, r AS (SELECT src, dst, round(rate / 125000, 2) AS mbps FROM config),
    s AS (SELECT count(DISTINCT mbps) AS n, min(mbps) AS lo, max(mbps) AS hi FROM r)
    SELECT src, dst, mbps, CASE WHEN mbps = hi THEN 'F' WHEN n = 2 THEN 'M' WHEN mbps = lo THEN 'S' ELSE 'M' END AS link_class FROM r, s""")
def link_classes(v):
    return rf.link_classes(link_config(v)).drop("bytes_per_sec")


@query("outcome_counts", """
    SELECT template, count(*) AS total, count(*) FILTER (phase = 'Succeeded') AS succeeded, count(*) FILTER (phase = 'Failed') AS failed, CAST(0 AS BIGINT) AS other
    FROM v_runs WHERE run_id IN (SELECT l_orderkey FROM lineitem) GROUP BY template""")
def outcome_counts(v):
    batch = v.table("lineitem").select(F.col("l_orderkey").alias("run_id")).distinct()
    named = v.runs.join(batch, "run_id", "left_semi").select("run_name")
    return rf.outcome_counts(v.runs, named, "template")


@query("provenance", "SELECT run, kind, arg_max(node, (end_, node)) AS node FROM v_tasks GROUP BY run, kind")
def provenance(v):
    return rf.provenance(v.tasks, "run", "kind")


@query("mission_summary", """
    SELECT 'summary' AS section, 'total_detections' AS key, CAST(count(*) AS VARCHAR) AS value FROM v_dets
    UNION ALL SELECT 'summary', 'num_classes', CAST(count(DISTINCT class) AS VARCHAR) FROM v_dets
    UNION ALL SELECT 'class', class, CAST(count(*) AS VARCHAR) FROM v_dets GROUP BY class
    UNION ALL SELECT 'source', sensor, CAST(count(*) AS VARCHAR) FROM v_dets GROUP BY sensor
    UNION ALL SELECT 'stage_node', kind, arg_max(node, (end_, node)) FROM v_tasks GROUP BY kind""")
def mission_summary(v):
    stages = rf.provenance(v.tasks, [], "kind").withColumnRenamed("kind", "task")
    return rf.mission_summary(rf.fuse_detections(v.dets), rf.source_counts(v.dets), stages)
