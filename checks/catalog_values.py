"""Sources, sinks and column jobs."""

from pyspark.sql import functions as F

import runframe as rf
from checks.registry import query, rounded
from runframe.functions.runtime import cut, work_folder
from runframe import schemas

SIZE_TEXT = """CASE l_linenumber WHEN 1 THEN concat(cast(l_quantity AS int), 'MB')
    WHEN 2 THEN concat(cast(cast(l_quantity AS int) AS string), '.5GiB') WHEN 3 THEN '' WHEN 4 THEN concat(' ', cast(l_quantity AS int), 'kb ')
    WHEN 5 THEN cast(cast(l_quantity AS int) AS string) WHEN 6 THEN concat(cast(l_quantity AS int), 'TB')
    ELSE concat('x', cast(l_quantity AS int), 'B') END"""
SIZE_TEXT_SQL = """CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS INT) || 'MB'
    WHEN 2 THEN CAST(l_quantity AS INT) || '.5GiB' WHEN 3 THEN '' WHEN 4 THEN ' ' || CAST(l_quantity AS INT) || 'kb '
    WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 6 THEN CAST(l_quantity AS INT) || 'TB'
    ELSE 'x' || CAST(l_quantity AS INT) || 'B' END"""


@query("read_runs", """
    SELECT run_id, rep, system, run_name, CASE WHEN phase NOT IN ('', '?', 'NA') THEN phase END AS phase,
      coalesce(try_cast(makespan_s AS DOUBLE), try_cast(makespan AS DOUBLE), try_cast(wall_s AS DOUBLE)) AS makespan_s,
      try_cast(wall_s AS DOUBLE) AS wall_s
    FROM v_raw_runs
    WHERE coalesce(try_cast(makespan_s AS DOUBLE), try_cast(makespan AS DOUBLE), try_cast(wall_s AS DOUBLE)) IS NOT NULL""")
def read_runs(v):
    """Written as files of two headers (other order, a column more) and read back together."""
    folder = work_folder(v.spark)
    even, odd = v.raw_runs.where("run_id % 2 = 0"), v.raw_runs.where("run_id % 2 = 1")
    even.select("rep", "system", "run_name", "phase", "makespan_s", "makespan", "wall_s").write.csv(f"{folder}/a", header=True)
    odd.select("wall_s", "makespan", "cell", "makespan_s", "run_name", "rep", "phase", "iteration",
               "system").write.csv(f"{folder}/b", header=True)
    runs = rf.read_runs(v.spark, [f"{folder}/a", f"{folder}/b"])
    return runs.withColumn("run_id", F.substring_index("run_name", "-", -1).cast("long")).drop("iteration")


@query("two_hop_records", """
    WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) / 1e6 AS t, value FROM events)
    SELECT event_type AS system, CASE WHEN user_id % 2 = 0 THEN 'same' ELSE 'cross' END AS coloc,
      (user_id % 4) || 'MB' AS payload, 'r' || event_id AS run_name, CAST(event_id AS BIGINT) AS bytes,
      round(value + 8 - 0, 3) AS e2e, round(value, 3) AS compute,
      CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE END AS upload, CASE WHEN event_id % 2 = 0 THEN 2.0::DOUBLE END AS poll,
      CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE END AS download, 3.0::DOUBLE AS visible
    FROM e""")
def two_hop_records(v):
    t = "(unix_micros(cast(ts AS timestamp)) / 1e6)"
    raw = v.table("events").selectExpr(
        "concat('/r/', event_type, '/', if(user_id % 2 = 0, 'same', 'cross'), '-', user_id % 4, 'MB/', event_id, '.json') AS _file",
        "concat('r', event_id) AS run_name",
        f"named_struct('t0_wall', {t}, 't1_wall', {t} + value, 't1p_wall', if(event_id % 2 = 0, {t} + value + 1, null)) AS producer_log",
        f"""named_struct('t3_wall', {t} + value + 5, 't_found_wall', if(event_id % 2 = 0, {t} + value + 7, null),
            't4_wall', {t} + value + 8, 'bytes', event_id, 'expected_bytes', event_id, 'ok', true) AS consumer_log""",
        "named_struct('producer_finished', '2024-01-01T00:00:00Z', 'consumer_started', '2024-01-01T00:00:01Z') AS pod_api")
    phases = rf.two_hop_phases(rf.two_hop_columns(raw))
    out = phases.select("system", "coloc", "payload", "run_name", "bytes", "e2e", "compute", "upload", "poll",
                        "download", "visible")
    return rounded(out, "e2e", "compute", "upload", "poll", "download", "visible", digits=3)


@query("two_hop_phases", """
    SELECT event_id, round(greatest(value - 100, 0), 3) AS hold, round(105 - value, 3) AS wait, round(5.0::DOUBLE, 3) AS visible,
      CASE WHEN user_id % 3 = 0 THEN NULL ELSE round(10 + greatest(value, 100) - value, 3) END AS compute
    FROM events""")
def two_hop_phases(v):
    t = "(unix_micros(cast(ts AS timestamp)) / 1e6)"
    stamps = v.table("events").selectExpr(
        "event_id", f"{t} AS t0", f"if(user_id % 3 = 0, null, {t} + 10 + greatest(value, 100) - value) AS t1",
        f"{t} AS t1p", f"{t} + value AS t2", f"if(event_id % 2 = 0, {t} + 105, null) AS t3", f"{t} + 105 AS t3_api",
        f"{t} AS t_found", f"{t} + 110 AS t4")
    # hold is measured from a second stamp so that both signs occur
    held = rf.two_hop_phases(stamps.withColumn("t1", F.expr(f"t0 + 100"))).select("event_id", "hold", "wait", "visible")
    compute = rf.two_hop_phases(stamps).select("event_id", "compute")
    return rounded(held.join(compute, "event_id"), "hold", "wait", "visible", "compute", digits=3)


@query("consolidate_cells", """
    SELECT l_shipmode_cell AS cell, try_cast(nullif(regexp_extract(l_shipmode_cell, '^n(\\d+)-d(\\d+)', 1), '') AS INTEGER) AS n_cameras,
      try_cast(nullif(regexp_extract(l_shipmode_cell, '^n(\\d+)-d(\\d+)', 2), '') AS INTEGER) AS duration_s, count(*) AS rows,
      CAST(sum(o_orderkey) AS BIGINT) AS keys, count(*) FILTER (o_orderpriority = '2-HIGH') AS high
    FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 5 = 0 THEN 'odd-' || o_custkey % 3 ELSE 'n' || o_custkey % 4 || '-d' || (o_custkey % 3) * 30 || '-jpg' END
      AS l_shipmode_cell FROM orders) GROUP BY ALL""")
def consolidate_cells(v):
    """One summary per cell, written with headers in two orders and read back by the reader."""
    folder = work_folder(v.spark)
    cells = v.table("orders").selectExpr(
        "if(o_custkey % 5 = 0, concat('odd-', o_custkey % 3), concat('n', o_custkey % 4, '-d', (o_custkey % 3) * 30, '-jpg')) AS cell",
        "cast(o_orderkey AS string) AS rep", "o_orderpriority AS system")
    held = cut(cells)  # written once per cell
    cell_names = [f"odd-{i}" for i in range(3)] + [f"n{c}-d{d}-jpg" for c in range(4) for d in (0, 30, 60)]
    for place, name in enumerate(cell_names):
        columns = ["rep", "system"] if place % 2 else ["system", "rep"]
        held.where(F.col("cell") == name).select(*columns).write.csv(f"{folder}/{name}/summary.csv", header=True)
    read = rf.consolidate_cells(v.spark, folder)
    return (read.groupBy("cell", "n_cameras", "duration_s")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("rep").cast("long")).alias("keys"),
                 F.count_if(F.col("system") == "2-HIGH").alias("high")))


@query("flow_log", """
    SELECT flow_id AS from_task, src, dst, bytes, round(start_, 3) AS start, round(end_, 3) AS end, ok FROM v_flows
    WHERE hash_ok""".replace("WHERE hash_ok", "WHERE split_part(flow_id, '-', 2) <> '7'"))
def flow_log(v):
    record = F.to_json(F.struct(
        F.col("flow_id").alias("fromTask"), F.lit("c").alias("toTask"), F.col("src").alias("srcNode"),
        F.col("dst").alias("dstNode"), F.col("bytes").alias("dataSize"), F.col("start").alias("startUnix"),
        F.col("end").alias("endUnix"), "ok"))
    broken = F.split("flow_id", "-")[1] == "7"
    lines = rf.spread(v.flows).select(F.when(broken, F.concat(F.lit('{"fromTask": '), "flow_id")).otherwise(record).alias("value"))
    folder = work_folder(v.spark)
    lines.write.text(folder)
    out = rf.read_flows(v.spark, folder).select("from_task", "src", "dst", "bytes", "start", "end", "ok")
    return rounded(out, "start", "end", digits=3)


@query("flow_lines", """
    SELECT flow_id AS from_task, src, dst, bytes, ok FROM v_flows WHERE split_part(flow_id, '-', 2) <> '7'""")
def flow_lines(v):
    """The same log held in a column, with blank and broken lines."""
    record = F.to_json(F.struct(
        F.col("flow_id").alias("fromTask"), F.lit("c").alias("toTask"), F.col("src").alias("srcNode"),
        F.col("dst").alias("dstNode"), F.col("bytes").alias("dataSize"), F.col("start").alias("startUnix"),
        F.col("end").alias("endUnix"), "ok"))
    broken = F.split("flow_id", "-")[1] == "7"
    lines = v.flows.select(F.when(broken & F.col("ok"), " ").when(broken, "{").otherwise(record).alias("value"))
    return rf.parse_flow_lines(lines).select("from_task", "src", "dst", "bytes", "ok")


@query("doc_lines", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, length(text) AS chars FROM documents")
def doc_lines(v):
    folder = work_folder(v.spark)
    v.table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").write.json(folder)
    return rf.read_jsonl_docs(v.spark, folder).select("doc_id", F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("chars"))


@query("explode_runs", """
    WITH d AS (SELECT *, 't' || (turn + 1) || '|' || node || '|n' || (turn + 1) % 3 || '|' || bytes || '|' || (turn % 2 = 0) AS flow FROM v_dag)
    SELECT 'runs' AS part, run, NULL AS task, 'ns|Succeeded|1704067200' AS detail, round(max(runtime), 2) AS number FROM d GROUP BY run
    UNION ALL SELECT 'specs', run, task, concat_ws('|', 'img', array_to_string(deps, ','), '250m', '1Gi', node, bytes || 'B'), round(2 * runtime, 2)
      FROM d WHERE turn <> 3
    UNION ALL SELECT 'tasks', run, task, concat_ws('|', CASE WHEN turn % 2 = 0 THEN 'Succeeded' END, 'Done', node, '1704067210',
      CASE WHEN turn % 2 = 0 THEN '1704067260' END, CAST(turn = 1 AS VARCHAR), bytes || 'B'), NULL FROM d
    UNION ALL SELECT 'predicted_tasks', run, task, node, round(runtime, 2) FROM d
    UNION ALL SELECT 'predicted_flows', run, task, flow, round(runtime, 2) FROM d
    UNION ALL SELECT 'actual_flows', run, task, flow, round(runtime, 2) FROM d WHERE turn <> 2""")
def explode_runs(v):
    """All six tables of run documents, one row per entry."""
    even = F.col("turn") % 2 == 0
    spec = F.struct(F.col("task").alias("name"), F.when(F.col("turn") != 3, F.lit("img")).alias("image"),
                    F.col("deps").alias("dependencies"), F.concat(F.col("bytes").cast("string"), F.lit("B")).alias("dataSize"),
                    "runtime", F.struct(F.lit("250m").alias("cpu"), F.lit("1Gi").alias("memory")).alias("resources"),
                    F.struct(F.array("node").alias("nodeNames")).alias("constraints"),
                    F.create_map("node", "runtime").alias("runtimeProfile"))
    done = F.struct(F.col("task").alias("name"), F.when(even, "Succeeded").alias("phase"), F.lit("Done").alias("state"), "node",
                    F.lit("2024-01-01T00:00:10Z").alias("startTime"), F.when(even, "2024-01-01T00:01:00Z").alias("completionTime"),
                    (F.col("turn") == 1).alias("sending"), F.concat(F.col("bytes").cast("string"), F.lit("B")).alias("dataSize"))
    guess = F.struct(F.col("task").alias("name"), "node", F.lit(0.0).alias("estStart"), F.col("runtime").alias("estEnd"))
    flow = F.struct(F.col("task").alias("fromTask"), F.concat(F.lit("t"), F.col("turn") + 1).alias("toTask"),
                    F.col("node").alias("srcNode"), F.concat(F.lit("n"), (F.col("turn") + 1) % 3).alias("dstNode"),
                    F.lit(0.0).alias("start"), F.col("runtime").alias("end"), F.col("bytes").alias("dataSize"), even.alias("ok"))
    docs = v.dag.groupBy("run").agg(
        F.collect_list(spec).alias("specs"), F.max("runtime").alias("makespan"), F.collect_list(done).alias("tasks"),
        F.collect_list(guess).alias("predictedTasks"), F.collect_list(flow).alias("predictedNetworkFlows"),
        F.collect_list(F.when(F.col("turn") != 2, flow)).alias("actualNetworkFlows"),
    ).select(
        F.struct(F.col("run").alias("name"), F.lit("ns").alias("namespace"), F.lit("u").alias("uid"),
                 F.lit("2024-01-01T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.struct(F.col("specs").alias("tasks")).alias("spec"),
        F.struct(F.lit("Succeeded").alias("phase"), "makespan", "tasks", "predictedTasks", "predictedNetworkFlows",
                 "actualNetworkFlows").alias("status"))
    tables = rf.explode_runs(docs)

    def part(name, task, number, *detail):
        return tables[name].select(F.lit(name).alias("part"), "run", F.expr(task).alias("task"), F.concat_ws(
            "|", *[F.expr(d).cast("string") for d in detail]).alias("detail"), F.expr(number).alias("number"))

    flow_text = ("to_task", "src", "dst", "bytes", "ok")
    whole = part("runs", "cast(null AS string)", "makespan", "namespace", "phase", "unix_timestamp(created_at)")
    for other in (
            part("specs", "task", "runtime + runtime_profile[node_names[0]]", "image", "array_join(deps, ',')", "cpu", "memory",
                 "node_names[0]", "data_size"),
            part("tasks", "task", "cast(null AS double)", "phase", "state", "node", "unix_timestamp(start_time)",
                 "unix_timestamp(completion_time)", "sending", "data_size"),
            part("predicted_tasks", "task", "est_end - est_start", "node"),
            part("predicted_flows", "from_task", "end - start", *flow_text),
            part("actual_flows", "from_task", "end - start", *flow_text)):
        whole = whole.unionByName(other)
    return rounded(whole, "number", digits=2)


@query("read_links", """
    SELECT src, dst, round(avg(rate), 4) AS rate, count(*) AS entries FROM
      (SELECT src, dst, CAST(bytes AS DOUBLE) AS rate, split_part(flow_id, '-', 2) AS kind FROM v_flows)
    WHERE kind NOT IN ('6', '7') GROUP BY src, dst""")
def read_links(v):
    kind = F.split("flow_id", "-")[1]
    value = F.when(kind == "6", "fast").when(kind == "7", "-1").otherwise(F.col("bytes").cast("string"))
    config = v.flows.select(F.create_map(F.concat("src", F.lit("_to_"), "dst"), value).alias("data"))
    links, _ = rf.read_links(rf.links_from_map(config))
    return links.groupBy("src", "dst").agg(F.round(F.avg("bytes_per_sec"), 4).alias("rate"),
                                           F.count(F.lit(1)).alias("entries"))


@query("read_blobs", """
    SELECT page_id, CAST(strlen(coalesce(html, '') || chr(10)) AS BIGINT) AS length, sha256(coalesce(html, '') || chr(10)) AS digest FROM pages""")
def read_blobs(v):
    """Each page written as a file of its own and read back as bytes."""
    folder = work_folder(v.spark)
    rf.write_texts(rf.spread(v.table("pages").select("page_id", F.col("html").alias("value"))), folder, "page_id")
    blobs = rf.read_blobs(v.spark, folder, "*.txt")
    return blobs.select(F.regexp_extract("path", r"page_id=(\d+)/", 1).cast("long").alias("page_id"), "length",
                        F.sha2("content", 256).alias("digest"))


@query("flatten_agent_metrics", """
    WITH e AS (SELECT *, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pushed, CAST(0 AS BIGINT) AS z, CAST(1 AS BIGINT) AS o FROM events)
    SELECT event_id AS ts_s, 'n' || (user_id % 8) AS node, 'p' AS agent_pod, z AS cpu_m, z AS mem_mb, CAST(event_id AS BIGINT) AS bytes_in,
      pushed * 5 AS bytes_out, o AS put_total, o AS put_ok, z AS put_idempotent, z AS put_conflict, z AS put_checksum_mismatch,
      pushed AS push_attempts, pushed AS push_success, z AS push_failed, CAST(pushed * user_id AS BIGINT) AS push_inflight, o AS disk_bytes,
      z AS run_count, CAST(user_id AS BIGINT) AS goroutines, CAST(floor(value) AS BIGINT) AS mem_alloc_b, o AS mem_sys_b,
      CAST(event_id AS BIGINT) AS uptime_s
    FROM e""")
def flatten_agent_metrics(v):
    push = schemas.AGENT_METRICS["push"].dataType.simpleString()
    nested = v.table("events").selectExpr(
        "event_id AS ts_s", "concat('n', user_id % 8) AS node", "'p' AS agent_pod", "cast(null AS bigint) AS cpu_m",
        "cast(null AS bigint) AS mem_mb",
        f"""named_struct('uptime_seconds', event_id, 'goroutines', user_id,
            'memory', named_struct('alloc_bytes', cast(floor(value) AS bigint), 'sys_bytes', 1L),
            'disk', named_struct('bytes_used', 1L, 'run_count', cast(null AS bigint)),
            'transfers', named_struct('put_total', 1L, 'put_ok', 1L, 'put_checksum_mismatch', 0L,
                'put_conflict', cast(null AS bigint), 'put_idempotent', 0L, 'bytes_in', event_id),
            'push', if(event_id % 2 = 0, cast(named_struct('attempts', 1L, 'success', 1L, 'failed', 0L,
                'inflight', user_id, 'bytes_out', 5L) AS {push}), null)) AS metrics""")
    return rf.flatten_agent_metrics(nested)


@query("append_history", """
    WITH new AS (SELECT run_name AS id, phase, created_at, run_id FROM v_runs),
    old AS (SELECT run_name AS id FROM v_runs WHERE system = 'a')
    SELECT id, phase, run_id FROM new WHERE id NOT IN (SELECT id FROM old)""")
def append_history(v):
    new = v.runs.select(F.col("run_name").alias("id"), "phase", "created_at", "run_id")
    old = v.runs.where("system = 'a'").select(F.col("run_name").alias("id"))
    return rf.append_history(new.unionByName(new), old).select("id", "phase", "run_id")


@query("size_shards", """
    SELECT CAST(least(3, floor(before * 4 / total)) AS INTEGER) AS shard, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM
      (SELECT n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       sum(n_chars) OVER () AS total FROM documents) GROUP BY 1""")
def size_shards(v):
    return (rf.size_shards(v.table("documents").select("doc_id", "n_chars"), 4, "n_chars", "doc_id")
            .groupBy("shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")))


@query("valid_runs", """
    SELECT run_id, CAST(makespan_s AS BIGINT) AS makespan_s FROM v_raw_runs
    WHERE phase = 'Succeeded' AND regexp_full_match(makespan_s, '\\d+')""")
def valid_runs(v):
    return rf.valid_runs(v.raw_runs, "int").select("run_id", "makespan_s")


@query("search_runs", "SELECT run_id, run_name FROM v_runs WHERE contains(lower(run_name), 't7-1') OR contains(lower(phase), 't7-1')")
def search_runs(v):
    return rf.search(v.runs, " T7-1 ", ["run_name", "phase"]).select("run_id", "run_name")


@query("normalize_sizes", f"""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)::BIGINT AS q, {SIZE_TEXT_SQL} AS size FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(CASE l_linenumber WHEN 1 THEN q * 1000000 WHEN 2 THEN (q + 0.5) * 1073741824 WHEN 4 THEN q * 1000 WHEN 5 THEN q ELSE 0 END AS BIGINT) AS a_bytes,
      CAST(CASE l_linenumber WHEN 1 THEN q * 1000000 WHEN 2 THEN q WHEN 4 THEN q * 1000 WHEN 5 THEN q WHEN 6 THEN q ELSE 0 END AS BIGINT) AS b_bytes,
      CAST(CASE l_linenumber WHEN 1 THEN q * 1000000 WHEN 3 THEN 0 WHEN 4 THEN q * 1000 WHEN 5 THEN q WHEN 6 THEN q * 1000000000000 END AS BIGINT) AS c_bytes
    FROM s""")
def normalize_sizes(v):
    specs = v.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[
        f"{SIZE_TEXT} AS {d}" for d in "abc"])
    for dialect in "abc":
        specs = rf.normalize_sizes(specs, dialect, dialect)
    return specs.drop("a", "b", "c")


@query("normalize_resources", """
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)::BIGINT AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN q * 1000 + 500 WHEN 3 THEN 0 WHEN 4 THEN q * 7777777 // 1000000
        WHEN 5 THEN q * 777 // 1000 WHEN 6 THEN 0 ELSE q * 1000 END AS BIGINT) AS cpu_millis,
      CAST(CASE l_linenumber WHEN 1 THEN q * 1048576 WHEN 2 THEN 0 WHEN 3 THEN q * 1000 WHEN 4 THEN q WHEN 5 THEN q * 1099511627776
        WHEN 6 THEN q * 1000000000 ELSE 0 END AS BIGINT) AS mem_bytes FROM s""")
def normalize_resources(v):
    specs = v.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        """CASE l_linenumber WHEN 1 THEN concat(cast(l_quantity AS int), 'm') WHEN 2 THEN concat(cast(l_quantity AS int), '.5')
           WHEN 3 THEN '' WHEN 4 THEN concat(cast(l_quantity AS int) * 7777777, 'n') WHEN 5 THEN concat(cast(l_quantity AS int) * 777, 'u')
           WHEN 6 THEN 'many' ELSE cast(cast(l_quantity AS int) AS string) END AS cpu""",
        """CASE l_linenumber WHEN 1 THEN concat(cast(l_quantity AS int), 'Mi') WHEN 2 THEN concat(cast(l_quantity AS int), '.5Gi')
           WHEN 3 THEN concat(cast(l_quantity AS int), 'K') WHEN 4 THEN cast(cast(l_quantity AS int) AS string)
           WHEN 5 THEN concat(cast(l_quantity AS int), 'Ti') WHEN 6 THEN concat(cast(l_quantity AS int), 'G') ELSE 'x' END AS mem""")
    return rf.normalize_resources(specs).drop("cpu", "mem")


@query("map_values", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_tax * 2, 4) AS l_tax, round(l_quantity * l_quantity, 2) AS l_quantity FROM lineitem""")
def map_values(v):
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_quantity")
    return rf.map_values(rf.map_values(lines, "l_tax", lambda x: x * 2, 4), "l_quantity", lambda x: x * x, 2)


@query("map_values_array", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_tax * 3, 4) AS first, round(l_quantity * 3, 4) AS second, round(l_extendedprice * 3, 4) AS third FROM lineitem""")
def map_values_array(v):
    lines = v.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "array(l_tax, l_quantity, l_extendedprice) AS xs")
    out = rf.map_values(lines, "xs", lambda x: x * 3, 4)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col("xs")[i].alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("parse_names", """
    SELECT event_id, CAST(CASE WHEN event_type <> 'click' THEN user_id END AS INTEGER) AS name_index,
      CASE WHEN event_type <> 'click' THEN 'cam-' || user_id END AS camera,
      CASE event_type WHEN 'view' THEN 'capture-' || user_id WHEN 'click' THEN 'infer' ELSE 'chunk-' || user_id END AS partner FROM events""")
def parse_names(v):
    named = v.table("events").selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN concat('infer-', user_id) WHEN 'click' THEN 'infer' "
        "ELSE concat('chunk-', user_id) END AS name")
    return rf.parse_names(named, "name").drop("name")


@query("runs_of", "SELECT run_id, run_name FROM v_runs WHERE template = 't4'")
def runs_of(v):
    return rf.runs_of(v.runs, "t4").select("run_id", "run_name")


@query("backfill_start", """
    SELECT run_id, CASE run_id % 3 WHEN 0 THEN epoch(created_at)::BIGINT + 60
      WHEN 1 THEN CASE WHEN phase = 'Failed' THEN epoch(created_at)::BIGINT ELSE CAST(floor(epoch(created_at) + 3600 - makespan_s) AS BIGINT) END
      ELSE epoch(created_at)::BIGINT END AS started FROM v_runs""")
def backfill_start(v):
    runs = v.runs.withColumns({
        "start_time": F.expr("if(run_id % 3 = 0, created_at + interval 60 seconds, null)"),
        "completion_time": F.expr("if(run_id % 3 = 1, created_at + interval 1 hour, null)"),
        "makespan_s": F.expr("if(phase = 'Failed', 0.0D, makespan_s)")})
    return rf.backfill_start(runs).select("run_id", F.unix_timestamp("start_time").alias("started"))


@query("rebase_times", """
    WITH z AS (SELECT run, min(start_) AS t0 FROM v_tasks GROUP BY run)
    SELECT run, task, round(start_ - t0, 3) AS rel_start, round(CASE WHEN phase = 'Running' THEN 1706745600.0 ELSE end_ END - t0, 3) AS rel_end
    FROM v_tasks JOIN z USING (run)""")
def rebase_times(v):
    open_ = v.tasks.withColumn("end", F.expr("if(phase = 'Running', null, end)"))
    out = rf.rebase(open_, as_of=1706745600.0).select("run", "task", "rel_start", "rel_end")
    return rounded(out, "rel_start", "rel_end", digits=3)


@query("rebase_flows", """
    WITH own AS (SELECT run, min(start_) AS t FROM v_flows GROUP BY run),
    o AS (SELECT CAST(o_orderkey AS VARCHAR) AS run, min(epoch_us(o_orderdate) / 1e6) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT flow_id, round(start_ - coalesce(o.t, own.t), 3) AS rel_start, round(end_ - coalesce(o.t, own.t), 3) AS rel_end
    FROM v_flows f JOIN own ON own.run = f.run LEFT JOIN o ON o.run = f.run""")
def rebase_flows(v):
    """Flows relative to the start of their order; orders that are not finished give no origin."""
    origin = v.table("orders").where("o_orderstatus = 'F'").selectExpr(
        "cast(o_orderkey AS string) AS run", "unix_micros(cast(o_orderdate AS timestamp)) / 1e6 AS start")
    return rounded(rf.rebase(v.flows, origin).select("flow_id", "rel_start", "rel_end"), "rel_start", "rel_end", digits=3)


@query("run_diff", """
    WITH p AS (SELECT rep || '-' || cell AS k, system, makespan_s FROM v_runs)
    SELECT l.k, round(r.makespan_s - l.makespan_s, 6) AS diff, round((r.makespan_s - l.makespan_s) / l.makespan_s * 100, 6) AS diff_pct
    FROM p l JOIN p r USING (k) WHERE l.system = 'a' AND r.system = 'b'""")
def run_diff(v):
    keyed = v.runs.withColumn("k", F.concat_ws("-", "rep", "cell"))
    out = rf.run_diff(keyed.where("system = 'a'"), keyed.where("system = 'b'"), "k")
    return rounded(out.select("k", "diff", "diff_pct"), "diff", "diff_pct")


@query("letterbox_geometry", """
    WITH f AS (SELECT p_partkey, p_size * 20 + 100 AS w, CAST(floor(p_retailprice) AS INT) % 1000 + 100 AS h FROM part),
    s AS (SELECT *, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS scale FROM f),
    n AS (SELECT *, CAST(round_even(w * scale, 0) AS INTEGER) AS new_w, CAST(round_even(h * scale, 0) AS INTEGER) AS new_h FROM s)
    SELECT p_partkey, round(scale, 9) AS scale, new_w, new_h, CAST(floor((640 - new_w) / 2) AS INTEGER) AS pad_x,
      CAST(floor((640 - new_h) / 2) AS INTEGER) AS pad_y FROM n""")
def letterbox_geometry(v):
    frames = v.table("part").selectExpr(
        "p_partkey", "p_size * 20 + 100 AS orig_w", "cast(floor(p_retailprice) AS int) % 1000 + 100 AS orig_h")
    return rounded(rf.letterbox_geometry(frames).drop("orig_w", "orig_h"), "scale", digits=9)


@query("box_to_original", """
    WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 10 AS cx, l_discount * 1000 AS cy, l_tax * 1000 + 5 AS w, 40.0 AS h FROM lineitem),
    b AS (SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM d),
    o AS (SELECT *, (x1 - 4) / 0.5 AS ox1, (y1 - 8) / 0.5 AS oy1, (x2 - 4) / 0.5 AS ox2, (y2 - 8) / 0.5 AS oy2 FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ox1, 4) AS x1, round(oy1, 4) AS y1, round(ox2, 4) AS x2, round(oy2, 4) AS y2,
      CAST(least(greatest(round_even(ox1, 0), 0), 800) AS INTEGER) AS crop_x1, CAST(least(greatest(round_even(ox2, 0), 0), 800) AS INTEGER) AS crop_x2,
      CAST(least(greatest(round_even(oy1, 0), 0), 600) AS INTEGER) AS crop_y1, CAST(least(greatest(round_even(oy2, 0), 0), 600) AS INTEGER) AS crop_y2
    FROM o""")
def box_to_original(v):
    dets = v.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity * 10 AS cx", "l_discount * 1000 AS cy",
        "l_tax * 1000 + 5 AS w", "40.0D AS h", "0.5D AS scale", "4 AS pad_x", "8 AS pad_y", "800 AS orig_w", "600 AS orig_h")
    out = rf.box_to_original(rf.center_to_corners(dets))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x1", "y1", "x2", "y2",
                              "crop_x1", "crop_x2", "crop_y1", "crop_y2"), "x1", "y1", "x2", "y2", digits=4)


@query("iou_pairs", """
    SELECT a.camera, a.frame, a.det_id AS a_det_id, b.det_id AS b_det_id,
      round(i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i), 9) AS iou
    FROM v_boxes a JOIN v_boxes b ON a.camera = b.camera AND a.frame = b.frame AND a.det_id < b.det_id,
    LATERAL (SELECT greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i)
    WHERE i > 0""")
def iou_pairs(v):
    return rounded(rf.iou_pairs(v.boxes, ["camera", "frame"]), "iou", digits=9)


@query("normalize_vectors", """
    SELECT vec_id, i - 1 AS i, round(CASE WHEN label = 0 THEN 0.0 ELSE embedding[i]::DOUBLE
      / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) END, 9) AS v
    FROM embeddings, range(1, 65) t(i)""")
def normalize_vectors(v):
    zero = v.table("embeddings").withColumn("embedding", F.expr("if(label = 0, transform(embedding, x -> float(0)), embedding)"))
    out = rf.normalize_vectors(zero, "embedding").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rounded(out.withColumn("i", F.col("i").cast("long")), "v", digits=9)


@query("cosine_pairs", """
    WITH a AS (SELECT vec_id, embedding AS e FROM embeddings), b AS (SELECT vec_id + 1 AS vec_id, embedding AS f FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(list_zip(e, f), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
      / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(f, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS cosine
    FROM a JOIN b USING (vec_id)""")
def cosine_pairs(v):
    e = v.table("embeddings").select("vec_id", "embedding")
    return rounded(rf.cosine_pairs(e, e.withColumn("vec_id", F.col("vec_id") + 1), "vec_id"), "cosine", digits=9)


@query("assoc_candidates", """
    WITH d AS (SELECT * FROM v_boxes JOIN v_frames USING (camera, frame)),
    p AS (SELECT a.camera, a.frame_index, a.det_id AS a_det_id, b.det_id AS b_det_id,
      greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
      (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas, list_dot_product(a.embedding, b.embedding) AS s
      FROM d a JOIN d b ON a.camera = b.camera AND b.frame_index = a.frame_index + 1)
    SELECT camera, frame_index, a_det_id, b_det_id, round(i / (areas - i), 9) AS iou,
      round((1 - i / (areas - i)) * 0.7 + (1 - s) * 0.3, 9) AS cost FROM p WHERE i / (areas - i) >= 0.3""")
def assoc_candidates(v):
    dets = rf.frame_index(v.boxes.drop("embedding"), "camera")
    out = rf.assoc_candidates(dets, v.boxes.select("camera", "det_id", "embedding"))
    return rounded(out, "iou", "cost", digits=9)


@query("box_to_letterbox", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 0.5::DOUBLE + 4, 6) AS x1, round(l_discount * 0.5::DOUBLE + 8, 6) AS y1,
      round((l_quantity + 1) * 0.5::DOUBLE + 4, 6) AS x2, round(l_tax * 100 * 0.5::DOUBLE + 8, 6) AS y2 FROM lineitem""")
def box_to_letterbox(v):
    dets = v.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity AS x1", "l_discount AS y1", "l_quantity + 1 AS x2",
        "l_tax * 100 AS y2", "0.5D AS scale", "4 AS pad_x", "8 AS pad_y")
    return rounded(rf.box_to_letterbox(dets).drop("scale", "pad_x", "pad_y"), "x1", "y1", "x2", "y2")


@query("write_report", "SELECT run_id, run_name, phase FROM v_runs")
def write_report(v):
    folder = work_folder(v.spark)
    rf.write_report(v.runs, folder, ["run_id", "run_name", "phase"])
    return v.spark.read.schema("run_id long, run_name string, phase string").csv(folder, header=True)
