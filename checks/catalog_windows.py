"""Ordered operators, graphs and integrity checks."""

from pyspark.sql import functions as F

import runframe as rf
from checks.registry import query, rounded

AS_OF = "2001-06-01 00:00:00"


@query("warm_window", """
    SELECT run_id FROM (SELECT run_id, row_number() OVER w AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM
      (SELECT o_orderkey AS run_id, o_custkey, o_orderdate FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, run_id)) WHERE n < 5 OR p >= 5""")
def warm_window(v):
    runs = v.table("orders").selectExpr("o_orderkey AS run_id", "o_custkey", "o_orderdate")
    return rf.warm_window(runs, "o_custkey", ["o_orderdate", "run_id"]).select("run_id")


@query("warm_window_strict", """
    SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY template ORDER BY run_name) AS p FROM v_runs) WHERE p > 4""")
def warm_window_strict(v):
    return rf.warm_window(v.runs, "template", "run_name", keep_short=False).select("run_id")


@query("counter_deltas", """
    WITH r AS (SELECT agent, event_id, put_total FROM v_samples WHERE event_id % 9 <> 0)
    SELECT agent, event_id, put_total - coalesce(lag(put_total) OVER (PARTITION BY agent ORDER BY event_id), 0) AS delta FROM r""")
def counter_deltas(v):
    gaps = v.samples.withColumn("put_total", F.expr("if(event_id % 9 = 0, null, put_total)"))
    return rf.counter_deltas(gaps, "agent", "event_id", "put_total").select("agent", "event_id", "delta")


@query("mean_positive_delta", """
    WITH d AS (SELECT agent, put_total - coalesce(lag(put_total) OVER (PARTITION BY agent ORDER BY event_id), 0) AS delta FROM v_samples)
    SELECT agent, CAST(trunc(avg(delta)) AS BIGINT) AS mean_delta FROM d WHERE delta > 0 GROUP BY agent""")
def mean_positive_delta(v):
    return rf.mean_positive_delta(rf.counter_deltas(v.samples, "agent", "event_id", "put_total"), "agent")


@query("top_k", """
    SELECT class, det_id, confidence, CAST(row_number() OVER (PARTITION BY class ORDER BY confidence DESC, det_id) AS INTEGER) AS rank FROM v_dets QUALIFY rank <= 5""")
def top_k(v):
    return rf.top_k(v.dets, "class", 5, ["-confidence", "det_id"]).select("class", "det_id", "confidence", "rank")


@query("latest_state", """
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) = max(ts) AS seen, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def latest_state(v):
    events = v.table("events").select("user_id", "ts", "event_id", "event_type")
    return rf.latest(events, "user_id", ["ts", "event_id"]).select("user_id", "event_type", F.lit(True).alias("seen"), "event_id")


@query("busy_time", """
    WITH o AS (SELECT *, max(end_) OVER (PARTITION BY node ORDER BY start_, end_, task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_tasks)
    SELECT node, round(sum(greatest(end_ - greatest(start_, coalesce(reach, start_)), 0)), 3) AS busy, round(max(end_) - min(start_), 3) AS span, count(*) AS intervals,
      round(sum(greatest(end_ - greatest(start_, coalesce(reach, start_)), 0)) / (max(end_) - min(start_)) * 100, 4) AS busy_pct FROM o GROUP BY node""")
def busy_time(v):
    return rounded(rounded(rf.busy_time(v.tasks, "node"), "busy", "span", digits=3), "busy_pct", digits=4)


@query("max_overlap", """
    WITH s AS (SELECT node, start_ AS t, 1 AS d FROM v_tasks UNION ALL SELECT node, end_, -1 FROM v_tasks),
    c AS (SELECT node, sum(d) OVER (PARTITION BY node ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM s)
    SELECT node, CAST(max(open) AS BIGINT) AS max_overlap FROM c GROUP BY node""")
def max_overlap(v):
    return rf.max_overlap(v.tasks, "node")


@query("assign_lanes", """
    WITH g AS (SELECT run, node, list([{'task': task, 's': start_, 'e': end_, 'lane': 0::BIGINT}] ORDER BY start_, task) AS bars FROM v_tasks GROUP BY run, node),
    p AS (SELECT run, node, unnest(list_reduce(bars, lambda placed, b: list_concat(placed, [{'task': b[1].task, 's': b[1].s, 'e': b[1].e,
      'lane': list_filter(range(0, len(placed) + 1), lambda l: len(list_filter(placed, lambda o: o.lane = l AND o.e > b[1].s)) = 0)[1]}]))) AS o FROM g)
    SELECT run, node, o.task AS task, o.lane AS lane FROM p""")
def assign_lanes(v):
    return rf.assign_lanes(v.tasks.select("run", "node", "task", "start", "end"), ["run", "node"]).select("run", "node", "task", "lane")


@query("lane_count", """
    WITH s AS (SELECT run, node, start_ AS t, 1 AS d FROM v_tasks UNION ALL SELECT run, node, end_, -1 FROM v_tasks),
    c AS (SELECT run, node, sum(d) OVER (PARTITION BY run, node ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM s)
    SELECT run, node, CAST(max(open) AS BIGINT) AS lanes FROM c GROUP BY run, node""")
def lane_count(v):
    """First fit opens exactly as many lanes as intervals ever overlap."""
    lanes = rf.assign_lanes(v.tasks.select("run", "node", "task", "start", "end"), ["run", "node"])
    return lanes.groupBy("run", "node").agg((F.max("lane") + 1).alias("lanes"))


@query("retention_keep_latest", """
    SELECT run_id FROM v_runs WHERE phase IN ('Succeeded', 'Failed') QUALIFY row_number() OVER (PARTITION BY template ORDER BY created_at DESC, run_id DESC) > 7""")
def retention_keep_latest(v):
    return rf.retention(v.runs, "keepLatest", keep=7).select("run_id")


@query("retention_delayed", f"SELECT run_id FROM v_runs WHERE epoch(TIMESTAMP '{AS_OF}') - epoch(created_at) > 864000")
def retention_delayed(v):
    runs = v.runs.withColumnRenamed("created_at", "completion_time")
    return rf.retention(runs, "delayed", delay=864000, as_of=AS_OF).select("run_id")


@query("retention_immediate", "SELECT run_id FROM v_runs")
def retention_immediate(v):
    return rf.retention(v.runs, "immediate").select("run_id")


@query("size_cap", """
    WITH l AS (SELECT run_id, template, bytes, created_at FROM v_runs WHERE phase = 'Succeeded' AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
    s AS (SELECT run_id, sum(bytes) OVER (PARTITION BY template) - coalesce(sum(bytes) OVER (PARTITION BY template ORDER BY created_at, run_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM l)
    SELECT run_id FROM s WHERE left_ > 500000000""")
def size_cap(v):
    runs = v.runs.withColumn("phase", F.expr("if(phase = 'Failed', 'Running', phase)"))
    evicted = v.table("lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS run_id")
    return rf.size_cap(runs, evicted, 500_000_000).select("run_id")


@query("gc_runs", """
    WITH r AS (SELECT run_id, template, created_at, run_id % 10 = 0 AND template <> 't3' OR template = 't5' AND run_id % 2 = 0 AS open FROM v_runs),
    n AS (SELECT template, count(*) AS total FROM r GROUP BY template),
    p AS (SELECT run_id, total, row_number() OVER (PARTITION BY template ORDER BY created_at, run_id) AS k FROM r JOIN n USING (template) WHERE NOT open)
    SELECT run_id FROM p WHERE k <= total - 150""")
def gc_runs(v):
    open_ = F.expr("run_id % 10 = 0 AND template <> 't3' OR template = 't5' AND run_id % 2 = 0")
    runs = v.runs.withColumn("phase", F.when(open_, "Running").otherwise(F.col("phase")))
    return rf.gc_runs(runs, 150).select("run_id")


@query("number_runs", "SELECT run_id, row_number() OVER (PARTITION BY template ORDER BY created_at, run_id) AS run_number FROM v_runs")
def number_runs(v):
    return rf.number_runs(v.runs).select("run_id", "run_number")


@query("recent_history", """
    SELECT template, run_id, CAST(row_number() OVER (PARTITION BY template ORDER BY created_at DESC, run_id DESC) AS INTEGER) AS rank FROM v_runs QUALIFY rank <= 50""")
def recent_history(v):
    return rf.recent_history(v.runs, "template").select("template", "run_id", "rank")


@query("trend", """
    SELECT template, row_number() OVER (PARTITION BY template ORDER BY created_at, run_id) AS index, run_id, makespan_s FROM v_runs WHERE phase = 'Succeeded'""")
def trend(v):
    return rf.trend(v.runs, "template", ["created_at", "run_id"]).drop("created_at")


@query("shard_offsets", """
    WITH s AS (SELECT source, count(*) AS shard_size FROM documents GROUP BY source),
    o AS (SELECT source, shard_size, coalesce(sum(shard_size) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shard_offset FROM s)
    SELECT doc_id, source, shard_size, CAST(shard_offset AS BIGINT) AS shard_offset,
      CAST(shard_offset + row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS global_pos FROM documents JOIN o USING (source)""")
def shard_offsets(v):
    return rf.shard_offsets(v.table("documents").select("doc_id", "source"), "source", "doc_id")


# --- graphs ---

LAYERS = """
    RECURSIVE walk AS (SELECT run, task, 0 AS layer FROM v_dag WHERE len(deps) = 0
      UNION SELECT e.run, e.child, w.layer + 1 FROM walk w JOIN v_edges e ON e.run = w.run AND e.dep = w.task)"""


@query("dag_layers", f"WITH {LAYERS} SELECT run, task, CAST(max(layer) AS INTEGER) AS layer FROM walk GROUP BY run, task")
def dag_layers(v):
    return rf.dag_layers(v.dag)


RANKS = """
    RECURSIVE up AS (SELECT d.run, d.task, d.runtime AS cost, d.task AS via, 1 AS hops FROM v_dag d
      UNION ALL SELECT p.run, p.task, p.runtime + p.bytes / 1e6 + u.cost, u.task, u.hops + 1 FROM up u JOIN v_edges e ON e.run = u.run AND e.child = u.task
        JOIN v_dag p ON p.run = e.run AND p.task = e.dep)"""


@query("upward_rank", f"WITH {RANKS} SELECT run, task, round(max(cost), 6) AS rank FROM up GROUP BY run, task")
def upward_rank(v):
    return rounded(rf.upward_rank(v.dag, 1e6).select("run", "task", "rank"), "rank")


@query("critical_path_length", f"""
    WITH {RANKS}, r AS (SELECT run, task, max(cost) AS rank FROM up GROUP BY run, task)
    SELECT run, round(max(rank), 6) AS critical_path, count(*) AS tasks FROM r GROUP BY run""")
def critical_path_length(v):
    return rounded(rf.critical_path(v.dag, 1e6)[0], "critical_path")


@query("critical_path_tasks", f"""
    WITH {RANKS}, r AS (SELECT run, task, max(cost) AS rank FROM up GROUP BY run, task),
    nx AS (SELECT e.run, e.dep AS task, arg_max(e.child, (r.rank, -CAST(substr(e.child, 2) AS INT))) AS next FROM v_edges e
      JOIN r ON r.run = e.run AND r.task = e.child GROUP BY e.run, e.dep),
    path AS (SELECT run, arg_max(task, rank) AS task, 0 AS pos FROM r GROUP BY run
      UNION ALL SELECT p.run, nx.next, p.pos + 1 FROM path p JOIN nx ON nx.run = p.run AND nx.task = p.task)
    SELECT run, task, CAST(pos AS INTEGER) AS pos FROM path""")
def critical_path_tasks(v):
    return rf.critical_path(v.dag, 1e6)[1]


# the smallest label that reaches a node: rows of `label` are replaced by key while smaller labels come from the last round
LABELS = """
    e AS (SELECT l_orderkey AS a, l_partkey + 1000000000 AS b FROM lineitem),
    two AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    label(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM two
      UNION SELECT two.a, min(label.component) FROM label JOIN two ON two.b = label.id JOIN recurring.label AS old ON old.id = two.a
        WHERE label.component < old.component GROUP BY two.a)"""


def component_labels(v):
    lines = v.table("lineitem").selectExpr("l_orderkey AS a", "l_partkey + 1000000000 AS b")
    return rf.connected_components(lines.select(F.explode(F.array("a", "b")).alias("id")), lines)


@query("connected_components", f"WITH RECURSIVE {LABELS.strip()} SELECT id, component FROM label")
def connected_components(v):
    """Component of every order and part over all line items."""
    return component_labels(v)


@query("connected_components_whole", f"WITH RECURSIVE {LABELS.strip()} SELECT id, component FROM label")
def connected_components_whole(v):
    return component_labels(v)


@query("order_components", f"WITH RECURSIVE {LABELS.strip()} SELECT component, count(*) AS members FROM label GROUP BY component")
def order_components(v):
    return component_labels(v).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


@query("successors", """
    SELECT run, dep AS task, child AS successor, count(*) OVER (PARTITION BY run, dep) AS n_successors FROM v_edges""")
def successors(v):
    return rf.successors(v.dag)


# --- integrity ---

@query("block_manifest", """
    WITH b AS (SELECT page_id, encode(html) AS c FROM pages),
    k AS (SELECT page_id, c, unnest(range(0, CAST(ceil(octet_length(c) / 512.0) AS BIGINT))) AS block FROM b)
    SELECT page_id, CAST(block AS INTEGER) AS block, sha256(array_slice(c, block * 512 + 1, block * 512 + 512)) AS sha256 FROM k""")
def block_manifest(v):
    blobs = v.table("pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return rf.block_manifest(blobs, "page_id", block=512)


@query("content_digest", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents")
def content_digest(v):
    blobs = v.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return rf.content_digest(blobs, "doc_id")


@query("classify_puts", """
    WITH u AS (SELECT *, max(CASE WHEN claimed IS NULL THEN at_ END) OVER (PARTITION BY key ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_at FROM v_puts),
    f AS (SELECT key, min(at_) AS first_at FROM u WHERE open_at IS NULL AND claimed = computed GROUP BY key),
    s AS (SELECT u.key, u.at_, u.claimed, u.computed, coalesce(o.computed, CASE WHEN first_at < u.at_ THEN c.claimed END) AS installed FROM u
      LEFT JOIN v_puts o ON o.key = u.key AND o.at_ = u.open_at LEFT JOIN f ON f.key = u.key LEFT JOIN v_puts c ON c.key = u.key AND c.at_ = f.first_at)
    SELECT key, at_ AS at, CASE WHEN claimed IS NULL THEN 'ok' WHEN installed IS NULL THEN CASE WHEN claimed = computed THEN 'ok' ELSE 'mismatch' END
      WHEN installed = claimed THEN 'idempotent' ELSE 'conflict' END AS outcome FROM s""")
def classify_puts(v):
    return rf.classify_puts(v.puts, "key", "at").select("key", "at", "outcome")


@query("stuck_transfers", """
    SELECT run, task, consumer, state, CASE WHEN host IS NULL OR here IS NULL THEN 'Failed' ELSE 'Resumed' END AS outcome,
      CASE WHEN host IS NULL THEN 'missing entry' WHEN here IS NULL THEN 'no local output' END AS reason FROM
      (SELECT l_orderkey AS run, l_linenumber AS task, l_partkey || '-' || l_suppkey AS consumer, CASE l_returnflag WHEN 'A' THEN 'Done' WHEN 'N' THEN 'Pending' ELSE 'Transferring' END AS state,
        CASE WHEN l_suppkey % 5 <> 0 THEN 'h' || l_suppkey END AS host FROM lineitem)
      LEFT JOIN (SELECT o_orderkey AS run, true AS here FROM orders WHERE o_orderstatus = 'F') USING (run)
    WHERE state <> 'Done'""")
def stuck_transfers(v):
    transfers = v.table("lineitem").selectExpr(
        "l_orderkey AS run", "l_linenumber AS task", "concat(l_partkey, '-', l_suppkey) AS consumer",
        "CASE l_returnflag WHEN 'A' THEN 'Done' WHEN 'N' THEN 'Pending' ELSE 'Transferring' END AS state",
        "if(l_suppkey % 5 = 0, null, concat('h', l_suppkey)) AS host")
    outputs = v.table("orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS run")
    present = outputs.join(transfers.select("run", "task").distinct(), "run")
    return rf.stuck_transfers(transfers, present)


@query("digest_match", """
    SELECT doc_id, md5(a.text) AS left_md5, md5(b.text) AS right_md5, coalesce(md5(a.text) = md5(b.text), false) AS match
    FROM (SELECT doc_id, text FROM documents WHERE lang <> 'de') a FULL JOIN (SELECT doc_id, CASE WHEN source = 'src3' THEN text || 'x' ELSE text END AS text
      FROM documents WHERE source <> 'src5') b USING (doc_id)""")
def digest_match(v):
    docs = v.table("documents")
    right = docs.where("source <> 'src5'").withColumn("text", F.expr("if(source = 'src3', concat(text, 'x'), text)"))
    return rf.digest_match(docs.where("lang <> 'de'"), right, "doc_id", "text")
