"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

import runframe as rf
from runframe import schemas


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_runs_csv(spark, tmp_path):
    write(tmp_path / "r.csv", "rep,system,run_name,phase,makespan_s,wall_s\n1,a,r1,Succeeded,12,13\n2,a,r2,?,?,7\n3,b,r3,Failed,NA,\nretry-1,b,r4,Succeeded,x,9.5\n")
    got = {r.run_name: (r.phase, r.makespan_s) for r in rf.read_runs(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {"r1": ("Succeeded", 12.0), "r2": (None, 7.0), "r4": ("Succeeded", 9.5)}


def test_runs_csv_of_mixed_headers(spark, tmp_path):
    write(tmp_path / "a.csv", "rep,system,run_name,phase,makespan_s,wall_s\n1,a,r1,Succeeded,12,13\n")
    write(tmp_path / "b.csv", "\nsystem,rep,makespan_s,run_name\nb,2,5,r2\nb,3,6,r3\n")
    write(tmp_path / "c.csv", "run_name,iteration,wall_s,extra\nr4,9,4,z\n")
    write(tmp_path / "empty.csv", "")
    got = {(r.run_name, r.rep, r.iteration, r.system, r.phase, r.makespan_s)
           for r in rf.read_runs(spark, str(tmp_path)).collect()}
    assert got == {("r1", "1", None, "a", "Succeeded", 12.0), ("r2", "2", None, "b", None, 5.0),
                   ("r3", "3", None, "b", None, 6.0), ("r4", None, "9", None, None, 4.0)}
    write(tmp_path / "none/empty.csv", "")
    assert rf.read_runs(spark, str(tmp_path / "none")).collect() == []


def test_two_hop_files(spark, tmp_path):
    record = {"run_name": "r", "producer_log": {"t0_wall": 1.0, "t1_wall": 2.0, "t1p_wall": 2.5, "bytes": 5},
              "consumer_log": {"t3_wall": None, "t_found_wall": 6.0, "t4_wall": 8.0, "bytes": 5, "expected_bytes": 5, "ok": True},
              "pod_api": {"producer_finished": "1970-01-01T00:00:03Z", "consumer_started": "1970-01-01T00:00:04Z"}}
    write(tmp_path / "sysa/same-10MB/r1.json", json.dumps(record))
    write(tmp_path / "sysa/cross-10MB/r2.json", "{broken")
    write(tmp_path / "sysa/same-10MB/manifest.yml", "a: 1")
    rows = rf.two_hop_phases(rf.read_two_hop(spark, str(tmp_path))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.system, r.coloc, r.payload) == ("sysa", "same", "10MB")
    assert (r.e2e, r.compute, r.upload, r.hold, r.wait, r.poll, r.download, r.visible) == (7, 1, 0.5, 1, 1, 2, 2, 4)


def test_agent_metrics_files(spark, tmp_path):
    full = {"node": "n1", "uptime_seconds": 9, "goroutines": 3, "memory": {"alloc_bytes": 5, "sys_bytes": 6}, "disk": {"bytes_used": 7, "run_count": 1},
            "transfers": {"put_total": 4, "put_ok": 3, "put_conflict": 1, "bytes_in": 80}, "push": {"attempts": 2, "inflight": 1, "bytes_out": 50}, "config": {}}
    write(tmp_path / "metrics-1.json", json.dumps(full, indent=2))
    write(tmp_path / "metrics-2.json", json.dumps({"node": "n2", "uptime_seconds": 1}, indent=2))
    metrics = rf.read_agent_metrics(spark, str(tmp_path))
    samples = metrics.select(F.lit(1).alias("ts_s"), "node", F.lit("p").alias("agent_pod"), F.lit(None).cast("long").alias("cpu_m"),
                             F.lit(2).cast("long").alias("mem_mb"), F.struct("*").alias("metrics"))
    got = {r.node: r for r in rf.flatten_agent_metrics(samples).collect()}
    assert (got["n1"].bytes_in, got["n1"].bytes_out, got["n1"].put_ok, got["n1"].push_failed, got["n1"].uptime_s, got["n1"].mem_alloc_b) == (80, 50, 3, 0, 9, 5)
    assert (got["n2"].put_total, got["n2"].disk_bytes, got["n2"].uptime_s, got["n2"].cpu_m, got["n2"].mem_mb) == (0, 0, 1, 0, 2)


def test_cells(spark, tmp_path):
    head = "rep,system,run_name,phase,makespan_s,wall_s,report_ok\n"
    write(tmp_path / "n4-d60-jpg/summary.csv", head + "1,a,r,Succeeded,5,6,1\n")
    write(tmp_path / "odd/summary.csv", head + "1,a,r,Succeeded,5,6,1\n")
    got = {r.cell: (r.n_cameras, r.duration_s) for r in rf.consolidate_cells(spark, str(tmp_path)).collect()}
    assert got == {"n4-d60-jpg": (4, 60), "odd": (None, None)}


def test_flow_log_and_append(spark, tmp_path):
    good = {"fromTask": "a", "toTask": "b", "srcNode": "n1", "dstNode": "n2", "dataSize": 7, "startUnix": 1.0, "endUnix": 2.0, "ok": True}
    path = str(tmp_path / "flows")
    write(tmp_path / "flows/x.json", json.dumps(good) + "\n\n{bad\n" + json.dumps({**good, "ok": False}) + "\n")
    assert sorted(r.ok for r in rf.read_flows(spark, path).collect()) == [False, True]
    rf.append_flows(spark.createDataFrame([tuple(good.values())], schemas.FLOW), path)
    assert rf.read_flows(spark, path).count() == 3


def test_flow_lines_are_parsed_once(spark):
    good = json.dumps({"fromTask": "a", "toTask": "b", "srcNode": "n1", "dstNode": "n2", "dataSize": 7, "startUnix": 1.0, "endUnix": 2.0, "ok": True})
    rows = [good, " ", "", None, "{", ' {"fromTask": "x"', '{"fromTask": x}', '{"dataSize": "many"}', "junk", '  {"fromTask": "c}"', '{"fromTask": "d}"} tail', "{}"]
    lines = spark.createDataFrame([(r,) for r in rows], "value string").where("value IS NULL OR value <> 'nothing'")
    parsed = rf.parse_flow_lines(lines.selectExpr("concat(value, '') AS value"))
    assert sorted(str(r.from_task) for r in parsed.collect()) == ["None", "a", "d}"]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "trim(concat" not in plan


def test_documents_blobs_and_reports(spark, tmp_path):
    write(tmp_path / "d.jsonl", '{"doc_id": "1", "text": "a"}\n{"doc_id": "2", "text": "b"}\n')
    docs = rf.read_jsonl_docs(spark, str(tmp_path / "d.jsonl"))
    assert docs.count() == 2
    write(tmp_path / "blobs/a.bin", "abc")
    assert [r.length for r in rf.read_blobs(spark, str(tmp_path / "blobs")).collect()] == [3]
    rf.write_report(docs, str(tmp_path / "out"), ["doc_id"], "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["doc_id"]
    rf.write_report(docs.select(F.struct("*").alias("d")), str(tmp_path / "nested"), format="json")
    assert spark.read.json(str(tmp_path / "nested")).select("d.text").count() == 2
    with pytest.raises(ValueError):
        rf.write_report(docs, str(tmp_path / "x"), format="xml")


def test_tasks_put_their_files_in_place(spark, tmp_path):
    """The driver does not move the files: those of a finished task are there even though the job fails later."""
    def late(batches):
        import time
        for batch in batches:
            if batch.column("id")[0].as_py() >= 50:
                time.sleep(8)
                raise ValueError("late")
            yield batch

    rows = spark.range(0, 100, 1, 2).selectExpr("id", "concat('p', id) AS value")
    path = str(tmp_path / "texts")
    with pytest.raises(Exception, match="late"):
        rf.write_texts(rows.mapInArrow(late, rows.schema), path, "id")
    assert len(list((tmp_path / "texts").glob("id=*/*.txt"))) == 50
    rf.write_texts(rows, str(tmp_path / "whole"), "id")
    blobs = rf.read_blobs(spark, str(tmp_path / "whole"), "*.txt").collect()
    assert sorted(bytes(r.content) for r in blobs) == sorted(b"p%d\n" % i for i in range(100))


def test_tasks_write_their_files_themselves(spark, tmp_path):
    """Hadoop's local files cost a process each to set a mode and leave a checksum beside them; names and texts are as Spark's."""
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), ("a/b=%:", 2, "y\u00e9\nz"), ("", 3, "e"), (None, 4, ""), ("\u00fc {}[]", None, "u")],
                                 "`k:1` string, n int, value string").coalesce(1)
    rf.write_texts(rows, str(tmp_path / "own"), ["k:1", "n"])
    rows.write.partitionBy("k:1", "n").text(str(tmp_path / "spark"))

    def texts(folder):
        return {str(f.parent.relative_to(tmp_path / folder)): f.read_bytes() for f in (tmp_path / folder).glob("*/*/*.txt")}

    assert texts("own") == texts("spark") and len(texts("own")) == 5
    assert all(f.suffix == ".txt" for f in (tmp_path / "own").rglob("*") if f.is_file())
    with pytest.raises(FileExistsError):
        rf.write_texts(rows, str(tmp_path / "own"), ["k:1", "n"])


def test_run_documents(spark):
    doc = {"metadata": {"name": "r1", "namespace": "ns", "creationTimestamp": "2024-01-01T00:00:00Z"},
           "spec": {"tasks": [{"name": "a", "image": "i", "runtime": 3}, {"name": "b", "image": "i", "dependencies": ["a"], "runtime": 2.5},
                              {"name": "", "image": "i"}, {"name": "c"}]},
           "status": {"phase": "Running", "tasks": [{"name": "a", "phase": "Succeeded", "startTime": "2024-01-01T00:00:01Z"}],
                      "actualNetworkFlows": [{"fromTask": "a", "toTask": "b", "dataSize": 4, "start": 0.5, "end": 1}]}}
    frame = spark.createDataFrame([(json.dumps(doc),)], "v string").select(F.from_json("v", schemas.RUN_DOCUMENT).alias("d")).select("d.*")
    tables = rf.explode_runs(frame)
    assert {(r.task, tuple(r.deps), r.runtime) for r in tables["specs"].collect()} == {("a", (), 3.0), ("b", ("a",), 2.5)}
    assert tables["tasks"].first().completion_time is None
    assert tables["actual_flows"].first().bytes == 4
    assert tables["predicted_flows"].count() == 0


def test_links(spark):
    config = spark.createDataFrame([("a_to_b", "10"), ("b_to_c_to_d", "5.5"), ("x_to_y", "-1"), ("p_to_q", "fast"), ("nokey", "3"),
                                    ("defaultBandwidth", "77")], "key string, value string")
    links, default = rf.read_links(config)
    assert {(r.src, r.dst, r.bytes_per_sec) for r in links.collect()} == {("a", "b", 10.0), ("b", "c_to_d", 5.5)}
    assert default.first()[0] == 77.0


def test_history(spark):
    new = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 1, "z")], "id string, created_at long, phase string")
    old = spark.createDataFrame([("b",)], "id string")
    assert [tuple(r) for r in rf.append_history(new, old).collect()] == [("a", 0, "y")]


def test_sizes(spark):
    df = spark.createDataFrame([("100MB",), ("1.5GiB",), (" 2 kb",), ("",), ("7",), ("1TB",), ("junk",), (None,)], "s string")
    def parsed(d):
        return [r.s_bytes for r in rf.normalize_sizes(df, "s", d).collect()]
    assert parsed("a") == [100_000_000, 1_610_612_736, 2_000, 0, 7, 0, 0, 0]
    assert parsed("b") == [100_000_000, 1, 2_000, 0, 7, 1, 0, 0]
    assert parsed("c") == [100_000_000, None, 2_000, 0, 7, 10**12, None, 0]


def test_shards(hot, tmp_path):
    df = hot.range(100).selectExpr("id", "id % 7 + 1 AS size")
    cut = rf.size_shards(df, 4, "size", "id")
    totals = {r.shard: r.s for r in cut.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert set(totals) == {0, 1, 2, 3} and max(totals.values()) - min(totals.values()) <= 14
    rf.write_shards(cut, str(tmp_path / "shards"))
    assert hot.read.parquet(str(tmp_path / "shards")).where("shard = 2").count() == cut.where("shard = 2").count()


def test_size_shards_of_huge_sizes(spark):
    df = spark.createDataFrame([(i, 10 ** 14) for i in range(6)], "id long, size long")
    cut = rf.size_shards(df, 300_000, "size", "id")
    assert [r["shard"] for r in cut.orderBy("id").collect()] == [0, 50_000, 100_000, 150_000, 200_000, 250_000]
