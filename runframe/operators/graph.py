"""Graph operators over many task graphs at once, the rounds shared by all runs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runframe.functions.runtime import cut, work_folder


def edges_of(tasks: DataFrame, run: str = "run", name: str = "task", deps: str = "deps") -> DataFrame:
    return tasks.select(run, F.col(name).alias("child"), F.explode(deps).alias("dep")).distinct()


def successors(tasks: DataFrame, run: str = "run", name: str = "task", deps: str = "deps") -> DataFrame:
    """Each task's direct successors with their number, one row per successor."""
    edges = edges_of(tasks, run, name, deps)
    count = edges.groupBy(run, "dep").agg(F.count(F.lit(1)).alias("n_successors"))
    return (edges.join(count, [run, "dep"])
            .select(run, F.col("dep").alias(name), F.col("child").alias("successor"), "n_successors"))


def _cycle() -> None:
    raise ValueError("task dependencies contain a cycle")


def _written(rounds: list[DataFrame], folder: str) -> DataFrame:
    """The rounds of a loop as parts of one table."""
    rounds[-1].write.parquet(f"{folder}/round={len(rounds) - 1}")
    return rounds[-1].sparkSession.read.schema(rounds[-1].schema).parquet(f"{folder}/round={len(rounds) - 1}")


def _farthest(edges: DataFrame, base: DataFrame) -> DataFrame:
    """(run, node, value): the largest sum along a path from a source (a node that no edge enters) to each node.

    ``edges``: run, a, b, w (not negative); ``base``: run, node, value, read at the sources. A node with one edge in and
    one out lies inside a chain. Chains become single edges by pointer doubling, so the rounds after that follow the
    branching of a graph and not its length: the front of round k holds the best paths of k such edges, and is written as one
    part of a table. Nodes inside chains get the value of their chain's head and their distance from it.
    """
    edges = cut(edges.groupBy("run", "a", "b").agg(F.max("w").alias("w")))
    n_edges = edges.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    into = edges.groupBy("run", F.col("b").alias("node")).agg(
        F.count(F.lit(1)).alias("n_in"), F.max("a").alias("head"), F.max("w").alias("far"))
    out = edges.groupBy("run", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    inner = cut(into.join(out, ["run", "node"]).where("n_in = 1 AND n_out = 1").select("run", "node", "head", "far"))
    chains, reach = inner, 1
    while True:
        ahead = chains.select("run", F.col("node").alias("head"), F.col("head").alias("_h"), F.col("far").alias("_f"))
        met = chains.join(ahead, ["run", "head"], "left")
        if met.where("_h IS NOT NULL").isEmpty():
            break
        if reach > n_edges:
            _cycle()
        chains, reach = cut(met.select("run", "node", F.coalesce("_h", "head").alias("head"), (F.col("far") + F.coalesce("_f", F.lit(0))).alias("far"))), 2 * reach
    # edges between nodes that are not inside chains
    within = chains.select("run", F.col("node").alias("a"), "head", "far")
    kept = edges.join(inner.select("run", F.col("node").alias("b")), ["run", "b"], "left_anti").join(within, ["run", "a"], "left")
    short = cut(kept.select("run", F.coalesce("head", "a").alias("a"), "b", (F.col("w") + F.coalesce("far", F.lit(0))).alias("w"))
                .groupBy("run", "a", "b").agg(F.max("w").alias("w")))
    inside = into.select("run", "node")
    folder = f"{work_folder(edges.sparkSession)}/farthest"
    rounds = [base.select("run", "node", "value").join(inside, ["run", "node"], "left_anti")]
    front = _written(rounds, folder)
    while not front.isEmpty():
        if len(rounds) > n_edges + 1:
            _cycle()
        step = short.join(front.withColumnRenamed("node", "a"), ["run", "a"])
        rounds.append(step.groupBy("run", F.col("b").alias("node")).agg(F.max(F.col("value") + F.col("w")).alias("value")))
        front = _written(rounds, folder)
    found = (edges.sparkSession.read.schema(rounds[0].schema).parquet(*[f"{folder}/round={k}" for k in range(len(rounds))])
             .groupBy("run", "node").agg(F.max("value").alias("value")))
    heads = found.select("run", F.col("node").alias("head"), "value")
    return found.unionByName(chains.join(heads, ["run", "head"]).select("run", "node", (F.col("value") + F.col("far")).alias("value")))


def dag_layers(tasks: DataFrame, run: str = "run", name: str = "task", deps: str = "deps") -> DataFrame:
    """Longest distance from a root. A dependency that is no task counts as a root. A cycle raises ValueError."""
    edges = edges_of(tasks, run, name, deps).select(F.col(run).alias("run"), F.col("dep").alias("a"), F.col("child").alias("b"), F.lit(1).cast("long").alias("w"))
    known = tasks.select(F.col(run).alias("run"), F.col(name).alias("node")).distinct()
    nodes = known.unionByName(edges.select("run", F.col("a").alias("node"))).distinct()
    found = _settled(_farthest(edges, nodes.withColumn("value", F.lit(0).cast("long"))), known)
    return found.select(F.col("run").alias(run), F.col("node").alias(name), F.col("value").cast("int").alias("layer"))


def _settled(found: DataFrame, known: DataFrame) -> DataFrame:
    """Values of all known nodes; a node without one is on a cycle or behind it."""
    out = cut(known.join(found, ["run", "node"], "left"))
    if not out.where("value IS NULL").isEmpty():
        _cycle()
    return out


def upward_rank(tasks: DataFrame, bandwidth: float, run: str = "run", name: str = "task", deps: str = "deps",
                runtime: str = "runtime", bytes: str = "bytes", comm_factor: float = 1.0) -> DataFrame:
    """rank = runtime + largest (transfer + rank) over successors, with the successor that gives it (ties to the smaller name).

    Runtimes and sizes are not negative, so the costliest path always runs to a task without successors.
    """
    comm = F.when(F.col(bytes) > 0, F.col(bytes) / F.lit(float(bandwidth)) * comm_factor).otherwise(0.0)
    known = cut(tasks.select(F.col(run).alias("run"), F.col(name).cast("string").alias("node"), F.col(runtime).cast("double").alias("value"), comm.alias("_comm")))
    cost = known.select("run", F.col("node").alias("b"), (F.col("value") + F.col("_comm")).alias("w"))
    pairs = edges_of(tasks, run, name, deps).select(F.col(run).alias("run"), F.col("child").cast("string").alias("a"), F.col("dep").cast("string").alias("b"))
    edges = cut(pairs.join(cost, ["run", "b"]))  # against the flow: from a task to what it depends on
    ranks = _settled(_farthest(edges, known.select("run", "node", "value")), known.select("run", "node").distinct())
    offered = edges.join(ranks.select("run", F.col("node").alias("a"), "value"), ["run", "a"])
    following = offered.groupBy("run", F.col("b").alias("node")).agg(F.min_by("a", F.struct(-F.col("value"), F.col("a"))).alias("next_task"))
    return ranks.join(following, ["run", "node"], "left").select(
        F.col("run").alias(run), F.col("node").alias(name), F.col("value").alias("rank"), "next_task")


def critical_path(tasks: DataFrame, bandwidth: float, run: str = "run", name: str = "task", deps: str = "deps",
                  runtime: str = "runtime", bytes: str = "bytes", comm_factor: float = 1.0,
                  ) -> tuple[DataFrame, DataFrame]:
    """Length of each run's critical path, and its tasks in order (ties by task name).

    The path doubles every round: to the first 2^k tasks come those 2^k successors further on.
    """
    ranks = cut(upward_rank(tasks, bandwidth, run, name, deps, runtime, bytes, comm_factor))
    length = ranks.groupBy(run).agg(F.max("rank").alias("critical_path"), F.count(F.lit(1)).alias("tasks"))
    head = F.min_by(name, F.struct(-F.col("rank"), F.col(name)))
    path = ranks.groupBy(run).agg(head.alias(name)).select(run, F.lit(0).alias("pos"), name)
    jump, far = ranks.where("next_task IS NOT NULL").select(run, name, F.col("next_task").alias("_to")), 1
    while not jump.isEmpty():
        ahead = path.join(jump, [run, name]).select(run, (F.col("pos") + far).alias("pos"), F.col("_to").alias(name))
        path = cut(path.unionByName(ahead))
        further = jump.select(run, F.col(name).alias("_to"), F.col("_to").alias("_then"))
        jump, far = cut(jump.join(further, [run, "_to"]).select(run, name, F.col("_then").alias("_to"))), 2 * far
    return length, path


def connected_components(nodes: DataFrame, edges: DataFrame, id: str = "id") -> DataFrame:
    """Smallest member of each node's component; nodes without an edge stand alone.

    ``edges``: a, b. Alternates large-star and small-star steps until the edges stop changing;
    each step is one aggregate and one join, and every step is written out. Tasks keep their size on larger graphs,
    see ``_parts_for``.
    """
    current = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    mark = _fingerprint(current)
    with _parts_for(current.sparkSession, mark[0]) as many:
        while mark[0]:
            current = cut(_small_star(_large_star(current)))
            after = _fingerprint(current)
            if after == mark:
                break
            mark = after
        roots = current.groupBy("u").agg(F.min("v").alias("_root"))
        out = (nodes.select(id).distinct().join(roots.withColumnRenamed("u", id), id, "left")
               .select(id, F.coalesce("_root", id).alias("component")))
        return cut(out) if many else out


#: Edges a task of a step should get.
TASK_EDGES = 500_000


@contextmanager
def _parts_for(spark: SparkSession, edges: int) -> Iterator[bool]:
    """More shuffle partitions for what runs inside, if the usual ones would get more than ``TASK_EDGES`` edges each.

    They are not merged by their compressed size: pairs of sorted numbers take two bytes a row on disk and a hundred in memory.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-edges // TASK_EDGES)
    if needed <= usual:
        yield False
        return
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(needed))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield True
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(usual))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return (both.where("v > u").join(low, "u").where("v <> _m")
            .select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("_m"))
    neighbours = edges.join(low, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return neighbours.unionByName(low.select("u", F.col("_m").alias("v"))).distinct()
