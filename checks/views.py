"""Operator inputs made from the given tables: the same definitions for Spark and for DuckDB."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runframe import configure, spread
from runframe.functions.runtime import work_folder

OBS_ORDER = ["at", "ok", "ln", "pk", "sk", "price"]
LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) AS bigint))"


class Views:
    """Spark side. Each attribute is a lazy DataFrame over whole tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS run_id", "concat('t', o_custkey % 10, '-', o_orderkey) AS run_name",
            "concat('ns', o_custkey % 3) AS namespace", "if(o_orderkey % 2 = 0, 'a', 'b') AS system",
            "o_orderpriority AS cell", "cast(o_orderkey div 2 AS string) AS rep",
            "if(o_orderstatus = 'P', 'Failed', 'Succeeded') AS phase", "o_totalprice / 1000 AS makespan_s",
            "concat('t', o_custkey % 10) AS template", "cast(o_orderdate AS timestamp) AS created_at",
            "cast(floor(o_totalprice * 100) AS bigint) AS bytes", "cast(o_custkey % 7 AS string) AS seed")

    @cached_property
    def raw_runs(self) -> DataFrame:
        """Run rows as text, with the null markers of summary files."""
        return self.table("orders").selectExpr(
            "o_orderkey AS run_id", "o_orderpriority AS cell", "cast(o_orderkey div 2 AS string) AS rep",
            "cast(null AS string) AS iteration", "if(o_orderkey % 2 = 0, 'a', 'b') AS system",
            "concat('r-', o_orderkey) AS run_name", "if(o_orderstatus = 'P', '?', 'Succeeded') AS phase",
            "CASE o_orderstatus WHEN 'P' THEN '?' WHEN 'O' THEN cast(cast(floor(o_totalprice) AS bigint) AS string) "
            "ELSE 'NA' END AS makespan_s",
            "if(o_custkey % 2 = 0, '', cast(o_custkey AS string)) AS makespan",
            "if(o_custkey % 5 = 0, 'n/a', cast(o_orderkey AS string)) AS wall_s")

    @cached_property
    def tasks(self) -> DataFrame:
        start = "unix_micros(cast(ts AS timestamp)) / 1e6"
        return self.table("events").selectExpr(
            "cast(cast(ts AS date) AS string) AS run", "concat('e', event_id) AS task", "event_id",
            "concat('n', user_id % 8) AS node", f"{start} AS start", f"{start} + value * 60 AS end",
            "CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Running' ELSE 'Succeeded' END AS phase",
            "event_type AS kind", "cast(floor(value * 10000) AS bigint) AS bytes")

    @cached_property
    def dag(self) -> DataFrame:
        """Conversations as task graphs: a turn depends on the one or two turns before it."""
        return self.table("conversations").selectExpr(
            "concat('c', conv_id) AS run", "concat('t', turn) AS task",
            "CASE WHEN turn = 0 THEN cast(array() AS array<string>) "
            "WHEN turn = 1 THEN array('t0') ELSE array(concat('t', turn - 1), concat('t', turn - 2)) END AS deps",
            "length(text) / 100.0D AS runtime", "cast(length(text) * 1000 AS bigint) AS bytes",
            "concat('n', turn % 3) AS node", "conv_id", "turn", "role",
            "cast(conv_id * 100 + turn * 10 AS double) AS start",
            "cast(conv_id * 100 + turn * 10 AS double) + length(text) / 100.0D AS end",
            "concat(length(text), 'KB') AS data_size")

    @cached_property
    def flows(self) -> DataFrame:
        start = "unix_micros(cast(l_shipdate AS timestamp)) / 1e6 + l_linenumber * 3600"
        return self.table("lineitem").selectExpr(
            f"{LINE_ID} AS flow_id", "concat('n', l_suppkey % 8) AS src", "concat('n', l_partkey % 8) AS dst",
            "cast(floor(l_extendedprice) AS bigint) AS bytes", f"{start} AS start",
            f"{start} + l_quantity * 600 AS end", "l_returnflag <> 'R' AS ok", "cast(l_orderkey AS string) AS run")

    @cached_property
    def _joined(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "o_orderdate", "o_orderpriority")

    @cached_property
    def obs(self) -> DataFrame:
        return self._observed(self._joined)

    @cached_property
    def kept_obs(self) -> DataFrame:
        """The same, joined once and kept as files: an operator that numbers its input reads it up to three times."""
        folder = work_folder(self.spark)
        self._joined.write.parquet(folder)
        return self._observed(self.spark.read.schema(self._joined.schema).parquet(folder))

    def _observed(self, joined: DataFrame) -> DataFrame:
        return joined.selectExpr(
            "o_orderpriority AS template", "concat('task', l_linenumber) AS task",
            "concat('img', l_linenumber % 3) AS image", "concat('n', l_suppkey % 8) AS node",
            "l_quantity AS runtime", "if(l_returnflag = 'N', 0.0D, l_extendedprice) AS data_bytes",
            "cast(o_orderdate AS timestamp) AS at", "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_suppkey AS sk", "l_extendedprice AS price",
            "concat('task', l_linenumber + 1) AS dst_task", "concat('n', l_suppkey % 8) AS src",
            "concat('n', l_partkey % 8) AS dst", "l_quantity + l_tax AS transfer_sec")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "concat('n', n_nationkey) AS node", "cast(n_regionkey * 1000 AS bigint) AS cpu_alloc",
            "cast(n_nationkey * 100 AS bigint) AS mem_alloc", "n_regionkey <> 1 AS ready",
            "n_nationkey % 4 <> 0 AS schedulable")

    @cached_property
    def usage(self) -> DataFrame:
        return self.table("supplier").groupBy(F.expr("concat('n', s_nationkey)").alias("node")).agg(
            F.count(F.lit(1)).alias("cpu_used"), F.sum(F.expr("cast(floor(s_acctbal) AS bigint)")).alias("mem_used"))

    @cached_property
    def disk(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "concat('n', c_nationkey) AS node", "c_custkey AS ts", "cast(floor(c_acctbal * 10) AS bigint) AS disk_used",
            "if(c_mktsegment = 'MACHINERY', 'Running', 'Succeeded') AS phase")

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("events").selectExpr(
            "concat('agent', user_id % 8) AS agent", "unix_micros(cast(ts AS timestamp)) AS ts", "value AS cpu",
            "value * 2 AS mem", "event_id % 5 AS inflight", "event_id * 10 AS bytes_in", "event_id * 7 AS bytes_out",
            "event_id * 3 AS put_total", "event_id * 2 AS put_ok", "event_id")

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text", "source"))

    @cached_property
    def dets(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS det_id", "event_type AS class", "value / 500 AS confidence",
            "concat('s', user_id % 4) AS sensor", "cast(cast(ts AS date) AS string) AS run")

    @cached_property
    def boxes(self) -> DataFrame:
        x1, y1 = "l_quantity", "l_discount * 100"
        return self.table("lineitem").selectExpr(
            "concat('cam-', l_suppkey % 4) AS camera", "lpad(cast(l_partkey AS string), 12, '0') AS frame",
            f"{LINE_ID} AS det_id", f"{x1} AS x1", f"{y1} AS y1", f"{x1} + 5 + l_tax * 100 AS x2",
            f"{y1} + 10 AS y2", "l_extendedprice / 100000 AS score", "l_linenumber AS class_id",
            "concat('class', l_linenumber) AS class",
            "array(l_quantity / 50, l_discount * 10, l_tax * 10) AS embedding")

    @cached_property
    def tracklets(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "concat('cam-', vec_id % 4 + 1) AS camera", "vec_id AS tracklet_id", "concat('class', label) AS class",
            "embedding", "vec_id % 13 + 1 AS det_count", "lpad(cast(vec_id AS string), 8, '0') AS frame_first",
            "lpad(cast(vec_id + 5 AS string), 8, '0') AS frame_last")

    @cached_property
    def puts(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "source AS key", "doc_id AS at",
            "CASE WHEN doc_id % 11 = 0 THEN null WHEN doc_id % 3 = 0 THEN sha2(source, 256) ELSE sha2(text, 256) END AS claimed",
            "if(doc_id % 3 = 0 AND doc_id % 17 <> 0, sha2(source, 256), sha2(text, 256)) AS computed")


# DuckDB side, under the name v_<attribute>
SQL_VIEWS = {
    "v_runs": """SELECT o_orderkey AS run_id, 't' || (o_custkey % 10) || '-' || o_orderkey AS run_name,
        'ns' || (o_custkey % 3) AS namespace, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS system,
        o_orderpriority AS cell, CAST(o_orderkey // 2 AS VARCHAR) AS rep,
        CASE WHEN o_orderstatus = 'P' THEN 'Failed' ELSE 'Succeeded' END AS phase, o_totalprice / 1000 AS makespan_s,
        't' || (o_custkey % 10) AS template, o_orderdate AS created_at,
        CAST(floor(o_totalprice * 100) AS BIGINT) AS bytes, CAST(o_custkey % 7 AS VARCHAR) AS seed FROM orders""",
    "v_raw_runs": """SELECT o_orderkey AS run_id, o_orderpriority AS cell, CAST(o_orderkey // 2 AS VARCHAR) AS rep,
        CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS system, 'r-' || o_orderkey AS run_name,
        CASE WHEN o_orderstatus = 'P' THEN '?' ELSE 'Succeeded' END AS phase,
        CASE o_orderstatus WHEN 'P' THEN '?' WHEN 'O' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
            ELSE 'NA' END AS makespan_s,
        CASE WHEN o_custkey % 2 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS makespan,
        CASE WHEN o_custkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS wall_s FROM orders""",
    "v_tasks": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, 'e' || event_id AS task, event_id,
        'n' || (user_id % 8) AS node, epoch_us(ts) / 1e6 AS start_, epoch_us(ts) / 1e6 + value * 60 AS end_,
        CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Running' ELSE 'Succeeded' END AS phase,
        event_type AS kind, CAST(floor(value * 10000) AS BIGINT) AS bytes FROM events""",
    "v_dag": """SELECT 'c' || conv_id AS run, 't' || turn AS task,
        CASE WHEN turn = 0 THEN []::VARCHAR[] WHEN turn = 1 THEN ['t0'] ELSE ['t' || (turn - 1), 't' || (turn - 2)] END AS deps,
        length(text) / 100.0::DOUBLE AS runtime, length(text) * 1000 AS bytes, 'n' || (turn % 3) AS node, conv_id, turn, role,
        CAST(conv_id * 100 + turn * 10 AS DOUBLE) AS start_,
        CAST(conv_id * 100 + turn * 10 AS DOUBLE) + length(text) / 100.0::DOUBLE AS end_ FROM conversations""",
    "v_edges": "SELECT run, task AS child, unnest(deps) AS dep FROM v_dag",
    "v_flows": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS flow_id,
        'n' || (l_suppkey % 8) AS src, 'n' || (l_partkey % 8) AS dst, CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
        epoch_us(l_shipdate) / 1e6 + l_linenumber * 3600 AS start_,
        epoch_us(l_shipdate) / 1e6 + l_linenumber * 3600 + l_quantity * 600 AS end_, l_returnflag <> 'R' AS ok,
        CAST(l_orderkey AS VARCHAR) AS run FROM lineitem""",
    "v_obs": """SELECT o_orderpriority AS template, 'task' || l_linenumber AS task, 'img' || (l_linenumber % 3) AS image,
        'n' || (l_suppkey % 8) AS node, l_quantity AS runtime,
        CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE ELSE l_extendedprice END AS data_bytes, o_orderdate AS at_,
        l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS price,
        'task' || (l_linenumber + 1) AS dst_task, 'n' || (l_suppkey % 8) AS src, 'n' || (l_partkey % 8) AS dst,
        l_quantity + l_tax AS transfer_sec FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_nodes": """SELECT 'n' || n_nationkey AS node, CAST(n_regionkey * 1000 AS BIGINT) AS cpu_alloc,
        CAST(n_nationkey * 100 AS BIGINT) AS mem_alloc, n_regionkey <> 1 AS ready, n_nationkey % 4 <> 0 AS schedulable
        FROM nation""",
    "v_usage": """SELECT 'n' || s_nationkey AS node, count(*) AS cpu_used,
        CAST(sum(CAST(floor(s_acctbal) AS BIGINT)) AS BIGINT) AS mem_used FROM supplier GROUP BY 1""",
    "v_disk": """SELECT 'n' || c_nationkey AS node, c_custkey AS ts, CAST(floor(c_acctbal * 10) AS BIGINT) AS disk_used,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Running' ELSE 'Succeeded' END AS phase FROM customer""",
    "v_samples": """SELECT 'agent' || (user_id % 8) AS agent, epoch_us(ts) AS ts, value AS cpu, value * 2 AS mem,
        event_id % 5 AS inflight, event_id * 10 AS bytes_in, event_id * 7 AS bytes_out, event_id * 3 AS put_total,
        event_id * 2 AS put_ok, event_id FROM events""",
    "v_docs": "SELECT doc_id, text, source FROM documents",
    "v_dets": """SELECT event_id AS det_id, event_type AS class, value / 500 AS confidence,
        's' || (user_id % 4) AS sensor, CAST(CAST(ts AS DATE) AS VARCHAR) AS run FROM events""",
    "v_boxes": """SELECT 'cam-' || (l_suppkey % 4) AS camera, lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS frame,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS det_id, l_quantity AS x1,
        l_discount * 100 AS y1, l_quantity + 5 + l_tax * 100 AS x2, l_discount * 100 + 10 AS y2,
        l_extendedprice / 100000 AS score, l_linenumber AS class_id, 'class' || l_linenumber AS class,
        [l_quantity / 50, l_discount * 10, l_tax * 10] AS embedding FROM lineitem""",
    "v_tracklets": """SELECT 'cam-' || (vec_id % 4 + 1) AS camera, vec_id AS tracklet_id, 'class' || label AS class,
        embedding, vec_id % 13 + 1 AS det_count, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS frame_first,
        lpad(CAST(vec_id + 5 AS VARCHAR), 8, '0') AS frame_last FROM embeddings""",
    "v_puts": """SELECT source AS key, doc_id AS at_,
        CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN sha256(source) ELSE sha256(text) END AS claimed,
        CASE WHEN doc_id % 3 = 0 AND doc_id % 17 <> 0 THEN sha256(source) ELSE sha256(text) END AS computed
        FROM documents""",
    # helpers of the oracles
    "v_steps": "SELECT start_ AS t, 1 AS d, src, dst FROM v_flows UNION ALL SELECT end_, -1, src, dst FROM v_flows",
    "v_frames": """SELECT camera, frame, row_number() OVER (PARTITION BY camera ORDER BY frame) - 1 AS frame_index
        FROM (SELECT DISTINCT camera, frame FROM v_boxes)""",
    "v_chunks": """SELECT doc_id || '-c' || i AS chunk_id, doc_id, i AS chunk_no, source,
        substr(text, CAST(i * 400 + 1 AS BIGINT), 500) AS text
        FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1
            ELSE CAST(ceil((length(text) - 500) / 400.0) AS BIGINT) + 1 END)) AS i FROM v_docs WHERE length(text) > 0)""",
    "v_tokens": """SELECT chunk_id, sha256(token) AS h FROM (SELECT chunk_id,
        unnest(regexp_split_to_array(lower(text), '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+')) AS token FROM v_chunks) WHERE token <> ''""",
    "v_hashed": """SELECT chunk_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 128 AS INTEGER) AS idx,
        CAST(sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS count
        FROM v_tokens GROUP BY ALL HAVING sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 1 THEN 1 ELSE -1 END) <> 0""",
    "v_query_tokens": """SELECT query_id, sha256(token) AS h FROM (SELECT item_id AS query_id,
        unnest(regexp_split_to_array(lower(text), '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+')) AS token FROM benchmark) WHERE token <> ''""",
    "v_query_hashed": """SELECT query_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 128 AS INTEGER) AS idx,
        CAST(sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS count
        FROM v_query_tokens GROUP BY ALL""",
    "v_ema": """SELECT template, task, node, sum(pow(0.7, n - p) * CASE WHEN p = 1 THEN 1 ELSE 0.3 END * runtime) AS runtime_ema,
        least(max(n), 100) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY template, task, node ORDER BY at_, ok, ln, pk, sk, price) AS p,
        count(*) OVER (PARTITION BY template, task, node) AS n FROM v_obs) GROUP BY template, task, node""",
    "v_ema_data": """SELECT template, task, node, sum(pow(0.7, n - q) * CASE WHEN q = 1 THEN 1 ELSE 0.3 END * data_bytes) AS data_ema
        FROM (SELECT *, row_number() OVER (PARTITION BY template, task, node ORDER BY p) AS q,
        count(*) OVER (PARTITION BY template, task, node) AS n FROM
        (SELECT *, row_number() OVER (PARTITION BY template, task, node ORDER BY at_, ok, ln, pk, sk, price) AS p FROM v_obs)
        WHERE p = 1 OR data_bytes > 0) GROUP BY template, task, node""",
    "v_image_ema": """SELECT image, node, sum(pow(0.7, n - p) * CASE WHEN p = 1 THEN 1 ELSE 0.3 END * runtime) AS runtime_ema,
        least(max(n), 100) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY image, node ORDER BY at_, ok, ln, pk, sk, price) AS p,
        count(*) OVER (PARTITION BY image, node) AS n FROM v_obs) GROUP BY image, node""",
    "v_image_data": """SELECT image, node, sum(pow(0.7, n - q) * CASE WHEN q = 1 THEN 1 ELSE 0.3 END * data_bytes) AS data_ema
        FROM (SELECT *, row_number() OVER (PARTITION BY image, node ORDER BY p) AS q, count(*) OVER (PARTITION BY image, node) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY image, node ORDER BY at_, ok, ln, pk, sk, price) AS p FROM v_obs)
        WHERE p = 1 OR data_bytes > 0) GROUP BY image, node""",
    "v_link_ema": """SELECT template, src_task, dst_task, src, dst,
        sum(pow(0.7, n - p) * CASE WHEN p = 1 THEN 1 ELSE 0.3 END * transfer_sec) AS transfer_sec, least(max(n), 100) AS samples
        FROM (SELECT *, task AS src_task, row_number() OVER (PARTITION BY template, task, dst_task, src, dst ORDER BY at_, ok, ln, pk, sk, price) AS p,
        count(*) OVER (PARTITION BY template, task, dst_task, src, dst) AS n FROM v_obs WHERE src <> dst)
        GROUP BY template, src_task, dst_task, src, dst""",
    "v_link_data": """SELECT template, src_task, dst_task, src, dst,
        sum(pow(0.7, n - q) * CASE WHEN q = 1 THEN 1 ELSE 0.3 END * data_bytes) AS data_bytes
        FROM (SELECT *, row_number() OVER (PARTITION BY template, src_task, dst_task, src, dst ORDER BY p) AS q,
        count(*) OVER (PARTITION BY template, src_task, dst_task, src, dst) AS n FROM
        (SELECT *, task AS src_task, row_number() OVER (PARTITION BY template, task, dst_task, src, dst ORDER BY at_, ok, ln, pk, sk, price) AS p
        FROM v_obs WHERE src <> dst) WHERE p = 1 OR data_bytes > 0) GROUP BY template, src_task, dst_task, src, dst""",
    "v_observed": """SELECT src, dst, sum(data_bytes) / sum(transfer_sec) AS bandwidth
        FROM v_link_ema JOIN v_link_data USING (template, src_task, dst_task, src, dst)
        WHERE samples >= 3 AND transfer_sec > 0 GROUP BY src, dst""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, in order of need."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in SQL_VIEWS and name not in needed:
                add(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    add(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({SQL_VIEWS[name]})" for name in needed)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"
