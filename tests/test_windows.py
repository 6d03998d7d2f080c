"""Top rows per group beyond the bound up to which Spark prunes by itself, and matching by a named method."""

import random

import numpy as np
import pytest

import runframe as rf


def test_top_k_above_the_pruning_bound(spark):
    rows = [("hot" if i < 9_000 else f"g{i % 5}", None if i % 3 == 0 else i % 7, i) for i in range(12_000)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    got = {(r.g, r.id): r["rank"] for r in rf.top_k(df, "g", 5_000, ["-x", "id"]).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        expected |= {(g, r[2]): place for place, r in enumerate(ordered[:5_000], 1)}
    assert got == expected


def test_retention_of_thousands(spark):
    df = spark.createDataFrame([("t", "Succeeded", i // 2, i) for i in range(4_000)],
                               "template string, phase string, created_at long, run_id long")
    gone = rf.retention(df, "keepLatest", keep=1_500)
    assert sorted(r.run_id for r in gone.select("run_id").collect()) == list(range(2_500))


def test_matching_methods(spark):
    rng = np.random.default_rng(3)
    rows = []
    for camera in ("a", "b"):
        for i in range(6):
            vector = rng.normal(size=4)
            rows.append((camera, i, [float(x) for x in vector / np.linalg.norm(vector)]))
    df = spark.createDataFrame(rows, "camera string, tracklet_id long, embedding array<double>")

    def total(method):
        return sum(r.sim for r in rf.match_cameras(df, -1.0, method=method).collect())

    assert total("auction") == pytest.approx(total("exact"), abs=1e-3)
    with pytest.raises(ValueError):
        rf.match_cameras(df, method="other")


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 steps, a diamond and a ladder: layers, ranks and the path, in fewer than 20 rounds for the chain."""
    from runframe.operators import graph

    n = 10_000
    chain = spark.range(n + 1).selectExpr("'long' AS run", "concat('t', id) AS task", "if(id = 0, cast(array() AS array<string>), array(concat('t', id - 1))) AS deps")
    rounds = []
    cut, written = graph.cut, graph._written
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append("cut") or cut(df))
    monkeypatch.setattr(graph, "_written", lambda r, f: rounds.append("round") or written(r, f))
    layers = rf.dag_layers(chain)
    assert layers.where("cast(substr(task, 2) AS int) <> layer").count() == 0 and layers.count() == n + 1
    assert rounds.count("round") < 4 and len(rounds) < 24


def test_layers_and_paths_of_any_graph(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for r in range(6):
        size = 24
        deps = {i: sorted({rng.randrange(max(0, i - 4), i) for _ in range(rng.choice([0, 1, 1, 1, 2]))} if i else set()) for i in range(size)}
        cost = {i: float(rng.randrange(1, 9)) for i in range(size)}
        layer, rank, after = {}, {}, {i: [c for c in range(size) if i in deps[c]] for i in range(size)}
        for i in range(size):
            layer[i] = max((layer[d] + 1 for d in deps[i]), default=0)
        for i in reversed(range(size)):
            rank[i] = cost[i] + max((rank[c] for c in after[i]), default=0.0) + (2.0 if after[i] else 0.0)
        rows += [(f"r{r}", f"t{i:02d}", [f"t{d:02d}" for d in deps[i]], cost[i], 2_000_000) for i in range(size)]
        at, path = min(rank, key=lambda i: (-rank[i], i)), []
        while at is not None:
            path.append(f"t{at:02d}")
            at = min(after[at], key=lambda c: (-rank[c], c), default=None)
        want[f"r{r}"] = ({f"t{i:02d}": layer[i] for i in layer}, {f"t{i:02d}": rank[i] for i in rank}, path)
    tasks = spark.createDataFrame(rows, "run string, task string, deps array<string>, runtime double, bytes long")
    got = {(r.run, r.task): r.layer for r in rf.dag_layers(tasks).collect()}
    ranks = {(r.run, r.task): r["rank"] for r in rf.upward_rank(tasks, 1e6).collect()}
    length, steps = rf.critical_path(tasks, 1e6)
    for run, (layer, rank, path) in want.items():
        assert {t: x for (r, t), x in got.items() if r == run} == layer
        assert {t: x for (r, t), x in ranks.items() if r == run} == pytest.approx(rank)
        assert [s.task for s in sorted((s for s in steps.collect() if s.run == run), key=lambda s: s.pos)] == path
    assert {r.run: r.tasks for r in length.collect()} == {run: 24 for run in want}
    cyclic = spark.createDataFrame([("r", "a", []), ("r", "b", ["a", "c"]), ("r", "c", ["b"]), ("r", "d", ["c"])], "run string, task string, deps array<string>")
    with pytest.raises(ValueError, match="cycle"):
        rf.dag_layers(cyclic)
