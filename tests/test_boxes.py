"""Boxes of very different sizes in the grid of levels, against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import runframe as rf
from runframe.functions.geometry import met_cells, own_cells
from runframe.operators.tracking import _kept_boxes, nms

SCHEMA = "camera string, frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double, score double"


def mixed(seed, n=160, frames=4):
    """Boxes from a hundredth of a pixel to a million pixels, crowded in one corner, with copies, ties, empty and null boxes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        side = 10.0 ** rng.uniform(-2, 3 if i % 20 else 6)
        x, y = (rng.uniform(-50, 50, 2) if i % 3 else rng.uniform(0, 0.1, 2)).tolist()
        rows.append(("c" if i % 4 else "d", int(rng.integers(0, frames)), i, x, y, x + side, y + side * rng.uniform(0.3, 3), float(rng.integers(0, 9))))
    rows += [(r[0], r[1], n + k, *r[3:7], r[7]) for k, r in enumerate(rows[:9])]
    return rows + [("c", 0, 900, 1.0, 1.0, 1.0, 5.0, 3.0), ("c", 0, 901, 5.0, 1.0, 2.0, 5.0, 9.0), ("c", 0, 902, None, 1.0, 2.0, 5.0, 1.0)]


def iou(a, b):
    if None in a[3:7] or None in b[3:7]:
        return 0.0
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    shared = max(w, 0.0) * max(h, 0.0)
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    union = area(a) + area(b) - shared
    return shared / union if shared > 0 and union > 0 else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_pairs(spark, seed):
    rows = mixed(seed)
    got = {(r["a_det_id"], r["b_det_id"]): r["iou"] for r in rf.iou_pairs(spark.createDataFrame(rows, SCHEMA), ["camera", "frame_index"]).collect()}
    want = {(a[2], b[2]): iou(a, b) for a in rows for b in rows if a[2] < b[2] and a[:2] == b[:2] and iou(a, b) > 0}
    assert got == pytest.approx(want)
    assert len(want) > 200


@pytest.mark.parametrize("iou_min,gap", [(0.3, 1), (0.05, 3), (0.9, 2)])
def test_links(spark, iou_min, gap):
    rows = mixed(3, 200, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    found = rf.links(df, "camera", iou_min, gap, extra=["score"]).collect()
    got = {(r["a_det_id"], r["b_det_id"]) for r in found}
    want = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and 1 <= b[1] - a[1] <= gap and iou(a, b) >= iou_min}
    assert got == want and len(found) == len(want)
    by_id = {r[2]: r for r in rows}
    assert all(r["a_score"] == by_id[r["a_det_id"]][7] and r["b_frame_index"] == by_id[r["b_det_id"]][1] for r in found)


@pytest.mark.parametrize("frame_rows", [0, 28, 1_000])
@pytest.mark.parametrize("iou_min", [0.3, 0.05])
def test_associations(spark, iou_min, frame_rows):
    """Frames that meet whole, by cells, and some of both."""
    rows = mixed(4, 200, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    vector = {r[2]: [r[2] / 100, 1.0 - r[2] / 300] for r in rows if r[2] % 7}
    embs = spark.createDataFrame([(r[0], r[2], vector[r[2]]) for r in rows if r[2] in vector], "camera string, det_id long, embedding array<double>")
    found = rf.assoc_candidates(df, embs, iou_min, frame_rows=frame_rows).collect()
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and b[1] == a[1] + 1 and iou(a, b) >= iou_min and a[2] in vector and b[2] in vector:
                want[a[0], a[1], a[2], b[2]] = (1 - iou(a, b)) * 0.7 + (1 - np.dot(vector[a[2]], vector[b[2]])) * 0.3
    assert len(found) == len(want) > 40
    assert {tuple(r)[:4]: r.cost for r in found} == pytest.approx(want)


def test_frames_meet_whole_without_cells(spark):
    """A box of a frame that is not crowded is no row per cell and level: two shuffles carry it, one for each neighbour."""
    df = spark.createDataFrame(mixed(4, 200, 8), SCHEMA)
    embs = df.selectExpr("camera", "det_id", "array(score, 1D) AS embedding")
    plan = rf.assoc_candidates(df, embs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 3


@pytest.mark.parametrize("frame_rows", [9, 1_000])
def test_frames_of_a_block_meet_in_one_place(spark, frame_rows):
    """Pairs over the borders of blocks are found, below zero as well, and both sides of the join read one shuffle."""
    rng = np.random.default_rng(3)
    frames = np.repeat(np.arange(-20, 40), rng.integers(5, 13, 60))
    rows = [("c", int(f), i, float(x), float(y), float(x) + 10, float(y) + 10, 0.5) for i, (f, x, y) in
            enumerate(zip(frames, rng.integers(0, 15, len(frames)), rng.integers(0, 15, len(frames))))]
    df = spark.createDataFrame(rows, SCHEMA)
    found = rf.assoc_candidates(df, df.selectExpr("camera", "det_id", "array(score, 1D) AS embedding"), 0.3, frame_rows=frame_rows)
    want = {(a[2], b[2]) for a in rows for b in rows if b[1] == a[1] + 1 and iou(a, b) >= 0.3}
    got = [(r.a_det_id, r.b_det_id) for r in found.collect()]
    assert sorted(got) == sorted(want) and any(frames[b] % 16 == 0 for _, b in want)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    places = re.findall(r"- Exchange hashpartitioning\([^)]*_block#", plan)
    assert frame_rows == 9 or len(places) == 1
    assert "ReusedExchange" in plan and "_block" in plan


def test_a_box_of_any_size_makes_few_rows(spark):
    df = spark.createDataFrame([("c", 0, i, 0.3, -7.7, 0.3 + s, -7.7 + s / 3, 1.0) for i, s in enumerate([1e-3, 1.0, 640.0, 1e6, 1e12])], SCHEMA)
    assert own_cells(df).groupBy("det_id").count().agg(F.max("count")).first()[0] <= 4
    assert met_cells(df).groupBy("det_id", "_level").count().agg(F.max("count")).first()[0] <= 4
    assert met_cells(df, 0).count() == own_cells(df).count()


def greedy(rows, iou_max):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        if all(iou(k, r) <= iou_max for k in kept if k[:2] == r[:2]):
            kept.append(r)
    return {r[2] for r in kept}


@pytest.mark.parametrize("iou_max", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("frame_rows", [20_000, 0])
def test_suppression(spark, iou_max, frame_rows):
    rows = mixed(5, 120, 3)
    got = nms(spark.createDataFrame(rows, SCHEMA), ["camera", "frame_index"], iou_max, frame_rows=frame_rows)
    assert {r["det_id"] for r in got.collect()} == greedy(rows, iou_max)


def test_suppression_of_many_frames_at_once():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 12, 30)
        at = rng.uniform(0, 20, (sizes.sum(), 2))
        boxes = np.hstack([at, at + rng.uniform(1, 15, at.shape)])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        alive = _kept_boxes(boxes, cuts, 0.3)
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = [("c", 0, i, *boxes[i].tolist(), float(-i)) for i in range(a, b)]
            assert set(np.flatnonzero(alive[a:b]) + a) == greedy(rows, 0.3)
    assert _kept_boxes(np.zeros((0, 4)), np.array([0]), 0.5).tolist() == []
