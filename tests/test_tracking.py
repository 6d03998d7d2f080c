"""Suppression, tracking, assignment and identities against brute force on small inputs."""

import itertools
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import runframe as rf
from checks import catalog_data, catalog_windows
from runframe.functions.assignment import cheapest_allowed, min_cost_assignment, most_similar
from runframe.operators.tracking import bid_assignment


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    cost = np.round(np.random.default_rng(seed).random((n, m)), 2)
    rows, cols = min_cost_assignment(cost)
    small = cost if n <= m else cost.T
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    assert cost[rows, cols].sum() == pytest.approx(best)
    assert len(set(rows)) == len(set(cols)) == min(n, m)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10_000))
def test_forbidden_pairs(n, m, seed):
    rng = np.random.default_rng(seed)
    cost = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)), np.inf)
    best = (0, 0.0)
    small = cost if n <= m else cost.T
    for p in itertools.permutations(range(small.shape[1]), len(small)):
        used = [small[i, p[i]] for i in range(len(small)) if np.isfinite(small[i, p[i]])]
        best = min(best, (-len(used), sum(used)))
    for limit in (64, 0):  # whole, and block by block
        pairs = cheapest_allowed(cost, split_above=limit)
        assert len(pairs) == -best[0]
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best[1])


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(0, 4), st.integers(1, 6), st.booleans(), st.integers(0, 10_000))
def test_most_similar_is_optimal(n, m, rounds, near, ties, seed):
    rng = np.random.default_rng(seed)
    left, right = (np.round(rng.normal(size=(k, 5)), 0 if ties else 9) for k in (n, m))
    rows, cols = most_similar(left, right, rounds, near, cells=50)
    sim = left @ right.T
    best = sim[min_cost_assignment(1.0 - sim)].sum()
    assert sim[rows, cols].sum() == pytest.approx(best)
    assert len(set(rows)) == len(set(cols)) == min(n, m)


def test_matching_holds_no_matrix():
    """Two cameras of 1,000 tracklets: 8 MB of similarities, which one task must not hold."""
    left, right = np.random.default_rng(1).normal(size=(2, 1_000, 64)) / 8
    tracemalloc.start()
    rows, cols = most_similar(left, right, near=16, cells=20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(cols)) == 1_000 and peak < 4e6


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def boxes(seed, frames=12, per_frame=9):
    rng = random.Random(seed)
    out, n = [], 0
    for camera in ("a", "b"):
        for frame in range(frames):
            for _ in range(rng.randrange(1, per_frame)):
                x, y = rng.randrange(0, 60), rng.randrange(0, 30)
                vec = [rng.random(), rng.random()]
                size = sum(v * v for v in vec) ** 0.5
                out.append((camera, f"{frame:03d}", frame, n, float(x), float(y), x + rng.randrange(5, 20) + 0.0,
                            y + rng.randrange(5, 20) + 0.0, rng.random(), "k", [v / size for v in vec]))
                n += 1
    return out


SCHEMA = ("camera string, frame string, frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double, "
          "score double, class string, embedding array<double>")


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[8], r[3])):
        if all(iou(r[4:8], k[4:8]) <= 0.5 for k in kept):
            kept.append(r)
    return {r[3] for r in kept}


@pytest.mark.parametrize("limit", [20_000, 0])
def test_nms_equals_greedy(spark, limit):
    data = boxes(5, frames=6, per_frame=25)
    data += [(*r[:3], r[3] + 10_000, *r[4:]) for r in data[::3]]  # exact copies with equal scores
    df = spark.createDataFrame(data, SCHEMA)
    expected = set().union(*(greedy([r for r in data if r[:2] == key]) for key in {r[:2] for r in data}))
    assert {r.det_id for r in rf.nms(df, ["camera", "frame"], frame_rows=limit).select("det_id").collect()} == expected


def reference_tracks(rows, iou_min=0.3, w=0.3, max_age=5):
    """Small cases by exhaustive assignment per frame."""
    out, active = {}, []
    for frame in sorted({r[2] for r in rows}):
        dets = sorted((r for r in rows if r[2] == frame), key=lambda r: r[3])
        active = [t for t in active if frame - t["frame"] <= max_age + 1]
        cost = np.full((len(active), len(dets)), np.inf)
        for i, t in enumerate(active):
            for j, d in enumerate(dets):
                near = iou(t["box"], d[4:8])
                if near >= iou_min:
                    cost[i, j] = (1 - near) * (1 - w) + (1 - np.dot(t["vec"], d[10])) * w
        taken = dict()
        if len(active):
            padded = np.where(np.isfinite(cost), cost, 1e6)
            taken = {j: i for i, j in zip(*min_cost_assignment(padded)) if np.isfinite(cost[i, j])}
        for j, d in enumerate(dets):
            if j in taken:
                t = active[taken[j]]
            else:
                t = {"id": d[3]}
                active.append(t)
            t.update(frame=frame, box=d[4:8], vec=d[10])
            out[d[3]] = t["id"]
    return out


def tracks_of(df, **options):
    return {r.det_id: r.track_id for r in rf.track(df, **options).collect()}


def test_tracker(spark):
    data = boxes(7)
    df = spark.createDataFrame(data, SCHEMA)
    expected = {}
    for camera in ("a", "b"):
        expected.update(reference_tracks([r for r in data if r[0] == camera]))
    assert tracks_of(df) == expected
    assert tracks_of(df.repartition(5, "score")) == expected
    assert tracks_of(df, hot_rows=0) == expected  # split into independent parts


@pytest.mark.parametrize("warm", [0, 8])
def test_tracker_in_chunks(spark, warm):
    """Cameras cut at frames, with tracks carried over borders; links and components of the whole camera are never made."""
    data = boxes(11, frames=90, per_frame=7)
    still = [("a", f"{f:03d}", f, 5_000 + f, 100.0, 100.0, 110.0, 110.0, 0.5, "k", [1.0, 0.0]) for f in range(90)]
    data += still  # one track over all borders
    df = spark.createDataFrame(data, SCHEMA)
    expected = {}
    for camera in ("a", "b"):
        expected.update(reference_tracks([r for r in data if r[0] == camera]))
    assert {expected[r[3]] for r in still} == {5_000}
    got = rf.track(df, hot_rows=0, warm=warm)
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString()  # the border names
    assert {r.det_id: r.track_id for r in got.collect()} == expected
    assert got.count() == len(data)
    if warm:  # a crowded frame: by parts
        assert {r.det_id: r.track_id for r in rf.track(df, hot_rows=0, frame_rows=1).collect()} == expected


def test_match_and_bids(spark):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(24, 6))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    data = [(f"cam-{i % 3}", i, [float(x) for x in vec[i]]) for i in range(24)]
    df = spark.createDataFrame(data, "camera string, tracklet_id long, embedding array<double>")
    dense = rf.match_cameras(df, sim_min=-1.0)
    total = {(r.cam_i, r.cam_j): r.s for r in dense.groupBy("cam_i", "cam_j").agg(F.sum("sim").alias("s")).collect()}
    for (a, b), value in total.items():
        sim = vec[int(a[-1])::3] @ vec[int(b[-1])::3].T
        rows, cols = min_cost_assignment(1 - sim)
        assert value == pytest.approx(sim[rows, cols].sum())
    sides = [df.where(F.col("camera") == c).selectExpr("tracklet_id AS id", "embedding AS vec") for c in ("cam-0", "cam-1")]
    bids = bid_assignment(*sides, tolerance=5e-3, block=3).collect()
    assert len({r.a for r in bids}) == len({r.b for r in bids}) == 8
    assert sum(r.sim for r in bids) >= total[("cam-0", "cam-1")] - 8 * 5e-3


def test_whole_camera_pairs(spark):
    """Both methods, and the queries over whole pairs, against every permutation; partners are far apart by number."""
    rng = np.random.default_rng(8)
    n = 5
    vec = rng.normal(size=(3 * n, 4))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    numbers = rng.permutation(200)[:3 * n].tolist()
    data = [(f"cam-{i % 3 + 1}", numbers[i], "class1", [float(x) for x in vec[i]], 2, "0", "5") for i in range(3 * n)]
    df = spark.createDataFrame(data, "camera string, tracklet_id long, class string, embedding array<double>, det_count long, "
                                     "frame_first string, frame_last string")
    want = set()
    for a, b in itertools.combinations(range(3), 2):
        sim = vec[a::3] @ vec[b::3].T
        best = max(itertools.permutations(range(n)), key=lambda p: sum(sim[i, j] for i, j in enumerate(p)))
        want |= {(numbers[a::3][i], numbers[b::3][j]) for i, j in enumerate(best) if sim[i, j] >= 0.3}
    views = SimpleNamespace(tracklets=df)
    assert {(r.id_i, r.id_j) for r in catalog_data.match_cameras_whole(views).collect()} == want
    assert {(r.id_i, r.id_j) for r in rf.match_cameras(df, sim_min=0.3, method="auction").collect()} == want
    assert any(i // 12 != j // 12 for i, j in want)
    root = {m: m for m in numbers}
    for _ in numbers:
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j], key=lambda m: (numbers.index(m) % 3, m))
    members = catalog_data.identities_whole(views).collect()
    assert {r.tracklet_id: r.root_tracklet for r in members} == root
    sizes = sorted(Counter(root.values()).values())
    assert sorted(r.hop_count for r in catalog_data.global_tracks_whole(views).collect()) == sizes
    assert sorted(r.det_count_total for r in catalog_data.identity_report_whole(views).collect()) == [2 * x for x in sizes]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    nodes = spark.range(80)
    got = rf.connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {n: find(n) for n in range(80)}


def test_components_of_all_line_items(spark):
    """Every line item links, whatever its date and quantity; against repeated minima."""
    rng = random.Random(6)
    lines = [(rng.randrange(60), rng.randrange(70), rng.choice(["1994-03-01", "2000-05-01"]), rng.randrange(1, 51)) for _ in range(75)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate string, l_quantity int")
    got = catalog_windows.connected_components_whole(SimpleNamespace(table=lambda name: df)).collect()
    label = {x: x for o, p, _, _ in lines for x in (o, p + 10 ** 9)}
    for _ in lines:
        for o, p, _, _ in lines:
            label[o] = label[p + 10 ** 9] = min(label[o], label[p + 10 ** 9])
    assert {r["id"]: r["component"] for r in got} == label and len(got) == len(label)


def test_hot_component_star(spark):
    """One node touches a third of all edges; a long chain needs several rounds."""
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 500)]
    got = rf.connected_components(spark.range(600), spark.createDataFrame(edges, "a long, b long")).collect()
    found = {r.id: r.component for r in got}
    assert {found[i] for i in range(200)} == {0} and {found[i] for i in range(300, 501)} == {300} and found[550] == 550


def test_cycle_is_reported(spark):
    tasks = spark.createDataFrame([("r", "a", ["b"]), ("r", "b", ["a"])], "run string, task string, deps array<string>")
    with pytest.raises(ValueError, match="cycle"):
        rf.dag_layers(tasks)


def test_unknown_dependency_is_a_root(spark):
    tasks = spark.createDataFrame([("r", "a", ["x"]), ("r", "b", ["a"]), ("r", "c", [])],
                                  "run string, task string, deps array<string>")
    assert {r.task: r.layer for r in rf.dag_layers(tasks).collect()} == {"a": 1, "b": 2, "c": 0}


def test_decode_and_summaries(spark):
    row = (10.0, 20.0, 4.0, 6.0, [0.1, 0.0, 0.9, 0.2, 0.0, 0.1, 0.0, 0.3])
    df = spark.createDataFrame([row, (*row[:4], [0.9] + [0.0] * 7), (*row[:4], [0.3] * 8)],
                               "cx double, cy double, w double, h double, scores array<double>")
    got = rf.decode_anchors(df).collect()
    assert [(r["class"], r.x1, r.y2) for r in got] == [("car", 8.0, 23.0)]


def test_nms_keeps_boxes_without_corners_at_any_size(spark):
    rows = [(1, 0.0, 0.0, 2.0, 2.0, 0.9), (2, None, 0.0, 2.0, 2.0, 0.8), (3, 0.0, 0.0, 2.0, 2.0, 0.7), (4, 9.0, 9.0, 8.0, 8.0, 0.6)]
    df = spark.createDataFrame([(0, *r) for r in rows], "frame int, det_id long, x1 double, y1 double, x2 double, y2 double, score double")
    kept = [sorted(r["det_id"] for r in rf.nms(df, "frame", frame_rows=n).collect()) for n in (20_000, 0)]
    assert kept[0] == kept[1] == [1, 2, 4]


def test_components_of_larger_graphs_take_more_tasks(spark, monkeypatch):
    from runframe.operators import graph

    parts, cut = [], graph.cut
    monkeypatch.setattr(graph, "TASK_EDGES", 20)
    monkeypatch.setattr(graph, "cut", lambda df: parts.append(spark.conf.get("spark.sql.shuffle.partitions")) or cut(df))
    edges = [(i, i + 1) for i in range(0, 199) if i % 10 != 9] * 2
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    out = graph.connected_components(spark.range(202), spark.createDataFrame(edges, "a long, b long"))
    assert set(parts[1:]) == {str(-(-len(edges) // 20))}
    assert {r.id: r.component for r in out.collect()} == {i: i - i % 10 if i < 200 else i for i in range(202)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual


def test_pairs_of_many_frames_at_once():
    """Sparse matching equals the dense one, ties included; the tracker gives the same frame by frame, at once and in small steps."""
    from runframe.functions.assignment import cheapest_allowed, matched
    from runframe.operators.tracking import TrackState
    rng = np.random.default_rng(7)
    for _ in range(300):
        n, m = rng.integers(1, 9, 2)
        cost = np.where(rng.random((n, m)) < 0.6, rng.integers(0, 6, (n, m)) / 4, np.inf)
        columns = [{int(i): float(cost[i, j]) for i in np.flatnonzero(np.isfinite(cost[:, j]))} for j in range(m)]
        used = [j for j in range(m) if columns[j]]
        if used:
            found = matched([columns[j] for j in used])
            assert sorted((i, j) for j, i in zip(used, found) if i >= 0) == sorted(cheapest_allowed(cost))
    frames = np.sort(rng.integers(0, 120, 700))
    corner = rng.integers(0, 30, (700, 2)).astype(float)
    boxes, vectors, ids = np.hstack([corner, corner + 10]), rng.normal(size=(700, 3)), [f"d{i}" for i in range(700)]
    opens = rng.random(700) < 0.05

    def state():
        out = TrackState(0.3, 0.3, 5)
        out.ended = []
        return out

    whole, single, small = state(), state(), state()
    got = whole.run(frames, boxes, vectors, ids, opens)
    cuts = np.append(np.flatnonzero(np.append(True, frames[1:] != frames[:-1])), len(frames))
    one = [t for a, b in zip(cuts[:-1], cuts[1:]) for t in single.run(frames[a:b], boxes[a:b], vectors[a:b], ids[a:b], opens[a:b])]
    assert got == one == small.run(frames, boxes, vectors, ids, opens, rows=20)
    assert whole.ids == single.ids == small.ids and sorted(whole.ended) == sorted(single.ended) == sorted(small.ended)
    assert len(set(got)) == len(whole.ended) + len(whole.ids)


def test_bids_use_the_columns_known():
    """A row's products with all columns are made once and where its floor is reached, not for each bid."""
    made = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            made.append(len(self))
            return np.asarray(self) @ other

    rng = np.random.default_rng(2)
    left, right = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 400, 8)) + 1)
    rows, cols = most_similar(left.view(Counted), right)
    assert len(set(cols.tolist())) == 400
    want = min_cost_assignment(1 - left @ right.T)
    assert (left[rows] * right[cols]).sum() == pytest.approx((left[want[0]] * right[want[1]]).sum())
    assert sum(made) < 3 * 400
