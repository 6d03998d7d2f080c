"""Detections to tracks to cross-camera identities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.assignment import matched, most_similar
from runframe.functions.geometry import BOX, center_to_corners, grid_levels, iou, links, met_cells, own_cells, solid
from runframe.functions.runtime import HOT_GROUP_CONF, HOT_GROUP_ROWS, cut, int_conf, names, work_folder
from runframe.functions.streams import map_sorted, whole_runs
from runframe.functions.vectors import normalize_vectors
from runframe.operators.aggregates import majority_class
from runframe.operators.graph import connected_components
from runframe.operators.scan import has_hot_group, scan

# fixed values: detector class numbers kept, with their names
VEHICLE_CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}


def decode_anchors(anchors: DataFrame, conf: float = 0.35, classes: dict[int, str] | None = None) -> DataFrame:
    """Best class per anchor, kept above ``conf`` and inside ``classes``, as corner boxes.

    Input: ``cx cy w h`` and ``scores`` (array, one per class).
    """
    wanted = classes or VEHICLE_CLASSES
    best = anchors.withColumn("score", F.array_max("scores"))
    best = best.withColumn("class_id", (F.array_position("scores", F.col("score")) - 1).cast("int"))
    label = F.create_map(*[F.lit(v) for pair in wanted.items() for v in pair])
    kept = best.where((F.col("score") >= conf) & F.col("class_id").isin(*wanted))
    return center_to_corners(kept.withColumn("class", F.try_element_at(label, F.col("class_id")))).drop("scores")


def frame_index(dets: DataFrame, by: str | Sequence[str] = "camera", frame: str = "frame") -> DataFrame:
    """Number (from 0) of each frame that holds detections, in frame order per camera."""
    keys = names(by)
    numbered = scan(dets.select(*keys, frame).distinct(), keys, frame, {"frame_index": ("row_number",)})
    return dets.join(numbered.withColumn("frame_index", F.col("frame_index") - 1), [*keys, frame])


# --- suppression -----------------------------------------------------------------------------

def nms(dets: DataFrame, by: str | Sequence[str], iou_max: float = 0.5, score: str = "score", id: str = "det_id",
        frame_rows: int = 20_000) -> DataFrame:
    """Greedy non-maximum suppression per frame: best score first (ties to the lower id).

    Frames are small groups of one task each. When a frame holds more than ``frame_rows`` boxes
    the same result is found in rounds over grid cells instead, which never gathers a frame.
    """
    keys = names(by)
    if has_hot_group(dets, keys, frame_rows):
        return dets.join(_nms_rounds(dets, keys, iou_max, score, id), [*keys, id], "left_semi")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begins in whole_runs(batches, keys):
            alive = _kept_boxes(rows[list(BOX)].to_numpy(float), np.append(begins, len(rows)), iou_max)
            yield rows[alive]

    return map_sorted(dets, keys, [f"-{score}", id], keep, dets.schema)


def _kept_boxes(boxes: np.ndarray, cuts: np.ndarray, iou_max: float) -> np.ndarray:
    """Boxes that stay, for frames sorted by rank between ``cuts``. Turn k compares the k-th box of all frames with those after it."""
    alive, area = np.ones(len(boxes), bool), (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    begins, ends = cuts[:-1], cuts[1:]
    for k in range(int((ends - begins).max(initial=1)) - 1):
        lead = begins + k
        going = lead + 1 < ends
        begins, ends = begins[going], ends[going]
        own = alive[lead[going]]
        lead, last = lead[going][own], ends[own]
        after = last - lead - 1
        one = np.repeat(lead, after)
        other = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after) + one + 1
        w = np.minimum(boxes[one, 2], boxes[other, 2]) - np.maximum(boxes[one, 0], boxes[other, 0])
        h = np.minimum(boxes[one, 3], boxes[other, 3]) - np.maximum(boxes[one, 1], boxes[other, 1])
        shared = np.clip(w, 0, None) * np.clip(h, 0, None)
        union = area[one] + area[other] - shared
        met = np.divide(shared, union, out=np.zeros_like(shared), where=(union > 0) & (shared > 0))
        alive[other[met > iou_max]] = False
    return alive


def _nms_rounds(dets: DataFrame, keys: list[str], iou_max: float, score: str, id: str) -> DataFrame:
    """Ids kept by greedy suppression, all frames at once.

    Of equal boxes only the best can stay (if ``iou_max`` < 1). Boxes lie in the grid of their own level and also look at higher
    ones, so any two that overlap share a cell of the larger one's level. In each round a box stays that is the best undecided one of all that
    it shares such a cell with; the boxes it covers too far go. A cell has one best box, so each round is one aggregate and joins of
    cell rows, without box pairs.
    """
    flat = dets.select(*keys, F.col(id).alias("_id"), F.col(score).alias("_score"), *BOX)
    covers = F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))  # null corners cover nothing
    empty = flat.where(~covers).select(*keys, "_id")
    best_copy = F.min_by(F.struct("_id", "_score"), F.struct(-F.col("_score"), F.col("_id")))
    boxes = solid(flat)
    if iou_max < 1:
        boxes = boxes.groupBy(*keys, *BOX).agg(best_copy.alias("_b")).select(*keys, *BOX, "_b.*")
    on, kept = [*keys, "_level", "_cx", "_cy"], [empty]
    open_ = cut(boxes)
    levels = grid_levels(open_)
    place = F.struct((-F.col("_score")).alias("s"), F.col("_id").alias("i"))
    at_home = F.col("_own") == F.col("_level")

    def sides(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in ("_id", *BOX)])

    while not open_.isEmpty():
        cells = met_cells(open_, levels=levels)
        first = cells.groupBy(*on).agg(F.min(place).alias("_all"), F.min(F.when(at_home, place)).alias("_home"))
        ahead = F.when(at_home, place <= F.col("_all")).otherwise(F.col("_home").isNull() | (place < F.col("_home")))
        won = cells.join(first, on).groupBy(*keys, "_id").agg(F.bool_and(ahead).alias("_ahead")).where("_ahead").select(*keys, "_id")
        won = cut(open_.join(won, [*keys, "_id"], "left_semi"))
        kept.append(won.select(*keys, "_id"))
        above = met_cells(won, levels=levels).where(F.col("_own") < F.col("_level"))
        near = (sides(cells, "o_").join(sides(own_cells(won), "w_"), on)
                .unionByName(sides(own_cells(open_), "o_").join(sides(above, "w_"), on)))
        gone = (near.where((F.col("o__id") == F.col("w__id")) | (iou("o_", "w_") > iou_max))
                .select(*keys, F.col("o__id").alias("_id")).distinct())
        open_ = cut(open_.join(gone, [*keys, "_id"], "left_anti"))
    return reduce(DataFrame.unionByName, kept).withColumnRenamed("_id", id)


# --- tracking inside one camera --------------------------------------------------------------

class TrackState:
    """Open tracks of one camera: last box, last embedding, last frame, track id.

    An open track is as its last detection was, so whether two detections may follow each other and at what cost does not depend on the
    tracking: ``run`` computes that for the pairs of many frames at once and walks through the frames with the allowed pairs only.
    """

    def __init__(self, iou_min: float, w: float, max_age: int):
        self.iou_min, self.w, self.max_age = iou_min, w, max_age
        self.boxes, self.vectors = np.empty((0, 4)), None
        self.frames, self.ids = np.empty(0, np.int64), []
        self.ended: list[tuple] | None = None  # (last frame, track id) of closed tracks, where somebody asks

    def run(self, frames: np.ndarray, boxes: np.ndarray, vectors: np.ndarray, ids: list, opens: np.ndarray, own_names: bool = False,
            rows: int = 2_000) -> list:
        """Match the detections of each frame in turn; returns their track ids (a new track takes its first id).

        Frames are whole and follow each other. Detections marked in ``opens`` start a track whatever is near. With
        ``own_names`` an open track goes by its last detection from then on.
        """
        begins = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])) if len(frames) else np.empty(0, np.int64)
        cuts, out, at = np.append(begins, len(frames)), [], 0
        while at < len(begins):
            stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + rows, "right")) - 1)
            own = slice(cuts[at], cuts[stop])
            out += self._frames(cuts[at:stop + 1] - cuts[at], frames[own].astype(np.int64), boxes[own], vectors[own], ids[own], opens[own], own_names)
            at = stop
        return out

    def _pairs(self, cuts: np.ndarray, frames: np.ndarray, boxes: np.ndarray, vectors: np.ndarray, known: int,
               most: int = 1_000_000) -> tuple[list, list, list]:
        """Allowed pairs of the detections after the first ``known`` with those before their frame: begin by detection, earlier one, cost."""
        begin = known + np.repeat(cuts[:-1], np.diff(cuts))
        since = frames[known:] - self.max_age - 1
        low = np.minimum(np.searchsorted(np.maximum.accumulate(frames), since), begin)
        sizes = np.append(0, np.cumsum(begin - low))
        area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        starts, earlier, costs, at = [0], [], [], 0
        while at < len(low):
            stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            one = np.repeat(np.arange(at, stop), (begin - low)[at:stop])
            other = np.arange(len(one)) + sizes[at] - sizes[one] + low[one]
            late = known + one
            w = np.minimum(boxes[other, 2], boxes[late, 2]) - np.maximum(boxes[other, 0], boxes[late, 0])
            h = np.minimum(boxes[other, 3], boxes[late, 3]) - np.maximum(boxes[other, 1], boxes[late, 1])
            shared = np.clip(w, 0, None) * np.clip(h, 0, None)
            union = area[other] + area[late] - shared
            near = np.divide(shared, union, out=np.zeros_like(shared), where=(union > 0) & (shared > 0))
            met = ~(near < self.iou_min) & (frames[other] >= since[one])
            one, other, late, near = one[met], other[met], late[met], near[met]
            cost = (1 - near) * (1 - self.w) + (1 - np.einsum("ij,ij->i", vectors[other], vectors[late])) * self.w
            fine = np.isfinite(cost)
            starts += (len(earlier) + np.cumsum(np.bincount(one[fine] - at, minlength=stop - at))).tolist()
            earlier += other[fine].tolist()
            costs += cost[fine].tolist()
            at = stop
        return starts, earlier, costs

    def _frames(self, cuts: np.ndarray, frames: np.ndarray, boxes: np.ndarray, vectors: np.ndarray, ids: list, opens: np.ndarray,
                own_names: bool) -> list:
        known, at = len(self.ids), cuts.tolist()
        boxes = np.vstack([self.boxes, boxes])
        vectors = vectors if self.vectors is None else np.vstack([self.vectors, vectors])
        every = np.concatenate([self.frames, frames])
        starts, earlier, costs = self._pairs(cuts, every, boxes, vectors, known)
        opens, names, out, newest = opens.tolist(), self.ids + ids, [], None
        followed = bytearray(len(names))
        for begin, end in zip(at[:-1], at[1:]):
            frame = int(frames[begin])
            wanted, near = [], []
            for j in range(begin, end):
                if starts[j] == starts[j + 1] or opens[j]:
                    continue
                own = {q: c for q, c in zip(earlier[starts[j]:starts[j + 1]], costs[starts[j]:starts[j + 1]]) if not followed[q]}
                if newest is not None and frame <= newest:  # an earlier frame that comes late: some tracks have ended since
                    own = {q: c for q, c in own.items() if newest - every[q] <= self.max_age}
                if own:
                    wanted.append(j)
                    near.append(own)
            if near:
                for j, q in zip(wanted, matched(near)):
                    if q >= 0:
                        names[known + j] = names[q]
                        followed[q] = 1
            out += names[known + begin:known + end]
            if own_names:
                names[known + begin:known + end] = ids[begin:end]
            newest = frame if newest is None else max(newest, frame)
        # what is open after the last frame: not followed, and no frame since was too far away
        later = np.append(np.maximum.accumulate(frames[::-1])[::-1], np.iinfo(np.int64).min // 2)
        since = np.concatenate([np.full(known, later[0]), later[np.repeat(cuts[1:], np.diff(cuts))]])
        free = np.frombuffer(followed, np.uint8) == 0
        alive = np.flatnonzero(free & (since - every <= self.max_age))
        if self.ended is not None:
            self.ended += [(int(every[q]), names[q]) for q in np.flatnonzero(free & (since - every > self.max_age))]
        self.boxes, self.vectors, self.frames, self.ids = boxes[alive], vectors[alive], every[alive], [names[q] for q in alive]
        return out


def track(dets: DataFrame, by: str | Sequence[str] = "camera", iou_min: float = 0.3, w: float = 0.3,
          max_age: int = 5, id: str = "det_id", embedding: str = "embedding",
          hot_rows: int | None = None, opened: str | None = None, frame_rows: int = 20_000, warm: int = 64) -> DataFrame:
    """Assign each detection a ``track_id`` (the id of the track's first detection).

    Needs ``frame_index`` (see ``frame_index``), corner columns and an embedding. A camera is one
    sorted stream through a task that remembers open tracks only. A camera too large for one task is cut into chunks of
    frames, see ``_track_chunks``; the result is the same. If a frame of it has more than ``frame_rows`` boxes, it is
    split into its independent parts instead: detections linked, directly or through others, by
    an allowed association can share a track, all others never compete, so each connected part is
    tracked alone with the same result. ``opened`` names a flag of rows that stand for tracks already open.
    """
    keys = names(by)
    group, rows = keys, dets
    if has_hot_group(dets, keys, hot_rows):
        counts = cut(dets.groupBy(*keys, "frame_index").agg(F.count(F.lit(1)).alias("n")))
        if (counts.agg(F.max("n")).first()[0] or 0) <= frame_rows:
            return _track_chunks(dets, counts, keys, iou_min, w, max_age, id, embedding, hot_rows, opened, max(warm, max_age + 2))
        near = links(dets, keys, iou_min, max_age + 1, id)
        part = connected_components(dets.select(F.col(id).alias("id")),
                                    near.select(F.col(f"a_{id}").alias("a"), F.col(f"b_{id}").alias("b")))
        rows = dets.join(part.select(F.col("id").alias(id), F.col("component").alias("_part")), id)
        group = [*keys, "_part"]
    schema = T.StructType([*dets.schema.fields, T.StructField("track_id", dets.schema[id].dataType)])
    columns = dets.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, previous = TrackState(iou_min, w, max_age), None
        for rows, begins in whole_runs(batches, [*group, "frame_index"]):
            boxes, ids = rows[list(BOX)].to_numpy(float), rows[id].tolist()
            vectors = np.stack(rows[embedding].to_numpy()).astype(float)
            frames, owners = rows["frame_index"].to_numpy(), list(zip(*[rows[c] for c in group]))
            opens = rows[opened].to_numpy(bool) if opened else np.zeros(len(rows), bool)
            tracks: list = []
            for begin, end in _stretches(owners, begins):
                if owners[begin] != previous:
                    state, previous = TrackState(iou_min, w, max_age), owners[begin]
                tracks += state.run(frames[begin:end], boxes[begin:end], vectors[begin:end], ids[begin:end], opens[begin:end])
            yield rows[columns].assign(track_id=tracks)

    return map_sorted(rows, group, ["frame_index", id], run, schema)


def _stretches(owners: list, begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows from a frame to the one where the owner changes; ``begins`` are the first rows of the frames."""
    first = 0
    for begin in begins.tolist():
        if owners[begin] != owners[first]:
            yield first, begin
            first = begin
    if len(owners):
        yield first, len(owners)


def _frame_borders(counts: DataFrame, keys: list[str], hot_rows: int | None, span: int) -> dict[tuple, list[int]]:
    """First frames of the chunks after the first, per camera: about equal rows, at least ``span`` frames, 1,000 chunks at most."""
    limit = int_conf(counts.sparkSession, HOT_GROUP_CONF, HOT_GROUP_ROWS) if hot_rows is None else hot_rows
    step = max(limit / 4, counts.agg(F.sum("n")).first()[0] / 1_000, 1)
    upto = scan(counts, keys, "frame_index", {"_upto": ("sum", F.col("n"))})
    found = upto.where(F.floor(F.col("_upto") / step) > F.floor((F.col("_upto") - F.col("n")) / step)).select(*keys, "frame_index").collect()
    lows = {tuple(r[:-1]): r[-1] for r in counts.groupBy(*keys).agg(F.min("frame_index")).join(
        F.broadcast(counts.sparkSession.createDataFrame(found, upto.select(*keys, "frame_index").schema).select(*keys).distinct()), keys, "left_semi").collect()} if found else {}
    borders: dict[tuple, list[int]] = {}
    for row in sorted(found, key=lambda r: r[-1]):
        camera = tuple(row[:-1])
        if camera in lows and row[-1] - borders.get(camera, [lows[camera]])[-1] >= span:
            borders.setdefault(camera, []).append(row[-1])
    return borders


def _track_chunks(dets: DataFrame, counts: DataFrame, keys: list[str], iou_min: float, w: float, max_age: int, id: str,
                  embedding: str, hot_rows: int | None, opened: str | None, warm: int) -> DataFrame:
    """``track`` with each camera in chunks of frames.

    What comes next depends on the open tracks only, and those are known by the detections they end in. A chunk also gets the ``warm``
    frames before it and starts tracking there from nothing. If at its first frame it has the same open tracks that the chunk before
    ends with, all its associations are those of the whole camera; only tracks carried over the border still need their
    first detection's name, which is followed back through the chunks. A border where the open tracks differ is taken out and
    the tracking repeated, then without any border in such a camera.
    """
    spark, columns, kind = dets.sparkSession, dets.columns, dets.schema[id].dataType
    fields = [T.StructField(f.name, f.dataType) for f in dets.schema.fields]
    schema = T.StructType([*fields, T.StructField("track_id", kind), T.StructField("_chunk", T.IntegerType()),
                           T.StructField("_carried", T.BooleanType()), T.StructField("_mark", T.IntegerType())])
    key_fields = [T.StructField(f"_k{i}", dets.schema[c].dataType) for i, c in enumerate(keys)]
    group = [*keys, "_chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, previous, begun, carried, last, after = None, None, True, set(), {}, None

        def open_rows(owner: tuple, border: int, mark: int) -> pd.DataFrame:
            live = [t for t, f in zip(state.ids, state.frames) if border - f <= max_age + 1]
            out = pd.DataFrame({**{c: [v] * len(live) for c, v in zip(group, owner)}, id: [last.get(t, t) for t in live],
                                "track_id": live, "_carried": [t in carried for t in live], "_mark": [mark] * len(live)})
            out = out.reindex(columns=schema.names).astype(object)
            return out.where(out.notna(), None)

        for rows, begins in whole_runs(batches, [*group, "frame_index"]):
            boxes, ids = rows[list(BOX)].to_numpy(float), rows[id].tolist()
            vectors = np.stack(rows[embedding].to_numpy()).astype(float)
            frames, owners = rows["frame_index"].to_numpy(), list(zip(*[rows[c] for c in group]))
            early, ends = rows["_early"].to_numpy(bool), rows["_after"].to_numpy()
            opens = rows[opened].to_numpy(bool) if opened else np.zeros(len(rows), bool)
            tracks: list = []
            for begin, end in _stretches(list(zip(owners, early.tolist())), begins):
                if owners[begin] != previous:
                    if previous is not None and after >= 0:
                        yield open_rows(previous, after, 2)
                    state, previous, carried, last = TrackState(iou_min, w, max_age), owners[begin], set(), {}
                    begun, after = not early[begin], int(ends[begin])
                if not begun and not early[begin]:
                    begun, carried, last = True, set(state.ids), {}
                    yield open_rows(previous, int(frames[begin]), 1)
                # until the chunk has begun an open track goes by its last detection
                found = state.run(frames[begin:end], boxes[begin:end], vectors[begin:end], ids[begin:end], opens[begin:end], not begun)
                tracks += found
                if begun:
                    last.update(zip(found, ids[begin:end]))
                    if len(last) > 4 * len(state.ids) + 1_000:
                        last = {t: last[t] for t in state.ids if t in last}
            yield rows[columns].assign(track_id=tracks, _chunk=rows["_chunk"], _carried=None, _mark=0)[~early]
        if previous is not None and after >= 0:
            yield open_rows(previous, after, 2)

    borders = _frame_borders(counts, keys, hot_rows, 2 * warm)
    for attempt in (1, 2, 3):
        table = spark.createDataFrame([(*k, b) for k, b in borders.items()],
                                      T.StructType([*key_fields, T.StructField("_borders", T.ArrayType(T.LongType()))]))
        match = F.lit(True)
        for i, c in enumerate(keys):
            match = match & dets[c].eqNullSafe(table[f"_k{i}"])
        met = dets.join(F.broadcast(table), match, "left").withColumn("_borders", F.coalesce("_borders", F.array().cast("array<bigint>")))
        met = met.withColumn("_chunk", F.size(F.filter("_borders", lambda b: F.col("frame_index") >= b)))
        met = met.withColumn("_after", F.coalesce(F.get("_borders", F.col("_chunk")), F.lit(-1)))
        own = F.struct(F.col("_chunk").alias("c"), F.lit(False).alias("e"), F.col("_after").alias("a"))
        next_ = F.struct((F.col("_chunk") + 1).alias("c"), F.lit(True).alias("e"), F.coalesce(F.get("_borders", F.col("_chunk") + 1), F.lit(-1)).alias("a"))
        twice = (F.col("_after") >= 0) & (F.col("frame_index") >= F.col("_after") - warm)
        dealt = (met.withColumn("_at", F.explode(F.when(twice, F.array(own, next_)).otherwise(F.array(own))))
                 .select(*columns, F.col("_at.c").alias("_chunk"), F.col("_at.e").alias("_early"), F.col("_at.a").alias("_after")))
        folder = f"{work_folder(spark)}/tracked"
        map_sorted(dealt, group, ["frame_index", id], run, schema).write.parquet(folder)
        done = spark.read.schema(schema).parquet(folder)
        camera = F.struct(F.lit(0).alias("_"), *keys).alias("_key")
        open_ = cut(done.where("_mark > 0").select(camera, "_chunk", F.col(id).alias("_head"), F.col("track_id").alias("_label"), "_carried", "_mark"))
        begun = open_.where("_mark = 1").select("_key", "_chunk", "_head")
        ended = open_.where("_mark = 2").select("_key", (F.col("_chunk") + 1).alias("_chunk"), "_head")
        wrong = begun.subtract(ended).unionByName(ended.subtract(begun)).select("_key", "_chunk").distinct().collect()
        if not wrong:
            break
        out = {(tuple(row["_key"])[1:], row["_chunk"]) for row in wrong}
        for place in {place for place, _ in out}:
            borders[place] = [b for i, b in enumerate(borders[place]) if attempt == 1 and (place, i + 1) not in out]
    return _named(done.where("_mark = 0"), open_.where("_mark = 2"), keys, columns)


def _named(rows: DataFrame, ended: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the first detection of tracks carried over borders, found back by doubling; a few rows a border."""
    known = cut(ended.select("_key", "_chunk", "_head", "_label", "_carried", F.when(F.col("_carried"), F.col("_chunk") - 1).alias("_to")))
    while not known.where("_carried").isEmpty():
        ahead = known.select("_key", F.col("_chunk").alias("_to"), F.col("_head").alias("_label"), F.col("_label").alias("_l"),
                             F.col("_carried").alias("_c"), F.col("_to").alias("_t"))
        met = known.join(ahead, ["_key", "_to", "_label"], "left")
        known = cut(met.select("_key", "_chunk", "_head", F.coalesce("_l", "_label").alias("_label"),
                               (F.col("_carried") & F.coalesce("_c", F.lit(False))).alias("_carried"), F.col("_t").alias("_to")))
    table = known.select(F.col("_key").alias("_k"), (F.col("_chunk") + 1).alias("_c"), "_head", "_label")
    if table.count() <= 1_000_000:
        table = F.broadcast(table)
    match = (F.struct(F.lit(0).alias("_"), *keys) == F.col("_k")) & (F.col("_chunk") == F.col("_c")) & (F.col("track_id") == F.col("_head"))
    met = rows.join(table, match, "left")
    return met.select(*columns, F.coalesce("_label", "track_id").alias("track_id"))


def summarize_tracks(assigned: DataFrame, embs: DataFrame | None = None, min_hits: int = 2,
                     by: str | Sequence[str] = "camera", id: str = "det_id", embedding: str = "embedding") -> DataFrame:
    """Tracklets with at least ``min_hits`` detections and their re-normalised mean embedding.

    The class is that of the first detection.
    """
    keys = [*names(by), "track_id"]
    full = assigned if embs is None else assigned.join(embs.select(*names(by), id, embedding), [*names(by), id])
    at = F.struct("frame_index", F.col(id))
    full = full.repartition(*keys)  # rows are smaller than the aggregates' buffers, and the join needs no further shuffle
    facts = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("det_count"), F.min_by("class", at).alias("class"),
        F.min_by("frame", at).alias("frame_first"), F.max_by("frame", at).alias("frame_last"),
    ).where(F.col("det_count") >= min_hits)
    mean = (full.where(F.col(embedding).isNotNull()).withColumn("_vector", array_to_vector(embedding)).groupBy(*keys)
            .agg(vector_to_array(Summarizer.mean(F.col("_vector"))).alias(embedding)))  # combined per task, vectors stay whole
    return normalize_vectors(facts.join(mean, keys), embedding)


# --- identities across cameras ---------------------------------------------------------------

def match_cameras(tracklets: DataFrame, sim_min: float = 0.55, by: str | Sequence[str] = (), camera: str = "camera",
                  id: str = "tracklet_id", embedding: str = "embedding", method: str = "exact") -> DataFrame:
    """One-to-one assignment per camera pair over all similarities, then those >= ``sim_min``.

    ``method`` is the caller's choice and holds at every size. ``exact``: the optimum, each camera pair in one
    task, which holds the pair's vectors but never all its similarities. ``auction``: bidding rounds over blocks, near the
    optimum, for pairs beyond one task's memory; see ``bid_assignment``.
    """
    if method not in ("exact", "auction"):
        raise ValueError(f"unknown matching method {method!r}")
    keys = names(by)
    cams = tracklets.groupBy(*keys).agg(F.sort_array(F.collect_set(camera)).alias("_c"))  # a key's cameras are few
    later = F.expr("slice(_c, _i + 2, size(_c))")
    pairs = (cams.select(*keys, "_c", F.posexplode("_c").alias("_i", "cam_i"))
             .select(*keys, "cam_i", F.explode(later).alias("cam_j")))
    if method == "exact":
        return _match_dense(tracklets, pairs, keys, camera, id, embedding).where(F.col("sim") >= sim_min)
    out = _match_dense(tracklets, pairs.limit(0), keys, camera, id, embedding)
    for row in pairs.toLocalIterator():  # camera pairs, few and far below the tracklets
        one = tracklets
        for key in keys:
            one = one.where(F.col(key).eqNullSafe(F.lit(row[key])))
        sides = [one.where(F.col(camera) == row[c]).select(F.col(id).alias("id"), F.col(embedding).alias("vec"))
                 for c in ("cam_i", "cam_j")]
        bids = bid_assignment(*sides)
        out = out.unionByName(bids.select(
            *[F.lit(row[k]).alias(k) for k in keys], F.lit(row["cam_i"]).alias("cam_i"),
            F.lit(row["cam_j"]).alias("cam_j"), F.col("a").alias("id_i"), F.col("b").alias("id_j"), "sim"))
    return out.where(F.col("sim") >= sim_min)


def _match_dense(tracklets, pairs, keys, camera, id, embedding) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in tracklets.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], f"cam_i {fields[camera]}", f"cam_j {fields[camera]}",
                        f"id_i {fields[id]}", f"id_j {fields[id]}", "sim double"])
    on = [*keys, "cam_i", "cam_j"]

    def side(which: str) -> DataFrame:
        own = tracklets.select(*keys, F.col(camera).alias(which), F.col(id).alias("_id"), F.col(embedding).alias("_v"))
        met = own.join(pairs.select(*on), [*keys, which])
        return met.select(*[F.col(c).alias(c) for c in (*on, "_id", "_v")])  # columns of its own: both sides share a source

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*on, "id_i", "id_j", "sim"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        left, right = left.sort_values("_id"), right.sort_values("_id")
        one, other = (np.stack(side["_v"].to_numpy()).astype(float) for side in (left, right))
        rows, cols = most_similar(one, other)
        out = pd.DataFrame({"id_i": left["_id"].to_numpy()[rows], "id_j": right["_id"].to_numpy()[cols],
                            "sim": np.einsum("ij,ij->i", one[rows], other[cols])})
        for name, value in zip(on, key):
            out[name] = value
        return out[columns]

    # a fixed partition count keeps small inputs with long solves from being merged into one task
    n = int(tracklets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = side("cam_i").repartition(n, *on), side("cam_j").repartition(n, *on)
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(solve, schema)


def identities(tracklets: DataFrame, pairs: DataFrame, camera: str = "camera", id: str = "tracklet_id") -> DataFrame:
    """Component of each tracklet under the accepted pairs; the label is the smallest member.

    Members are named ``camera/tracklet`` so that equal numbers of two cameras stay apart.
    """
    def member(cam: str, number: str):
        return F.struct(F.col(cam).alias("camera"), F.col(number).alias("tracklet_id"))

    nodes = tracklets.select(member(camera, id).alias("id"))
    edges = pairs.select(member("cam_i", "id_i").alias("a"), member("cam_j", "id_j").alias("b"))
    parts = connected_components(nodes, edges)
    return parts.select("id.camera", "id.tracklet_id", F.col("component.camera").alias("root_camera"),
                        F.col("component.tracklet_id").alias("root_tracklet"))


def global_tracks(members: DataFrame, tracklets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks (global id, class, cameras, hops) and their hop rows; ids follow the smallest member."""
    roots = scan(members.select("root_camera", "root_tracklet").distinct(), None, ["root_camera", "root_tracklet"],
                 {"global_id": ("row_number",)})
    hops = (members.join(roots, ["root_camera", "root_tracklet"])
            .join(tracklets.drop("embedding"), ["camera", "tracklet_id"])
            .select("global_id", "camera", "tracklet_id", "class", "frame_first", "frame_last", "det_count"))
    best = majority_class(hops.withColumn("pos", F.struct("camera", "tracklet_id")), "global_id").drop("class_weight")
    facts = hops.groupBy("global_id").agg(
        F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"),
        F.count(F.lit(1)).alias("hop_count"), F.sum("det_count").alias("det_count_total"))
    return best.join(facts, "global_id"), hops


def bid_assignment(a: DataFrame, b: DataFrame, tolerance: float = 1e-6, block: int = 4_000) -> DataFrame:
    """One-to-one assignment of the smaller side that maximises total similarity, by auction.

    Rows without a partner bid for their best column: the price rises by the gap to the second best
    plus ``tolerance``. Similarities are made block by block inside tasks and only the two best columns per
    row and block leave a task, so the full matrix never exists. The total is within
    ``tolerance`` per row of the optimum. Inputs: id, vec. Output: a, b, sim.
    """
    na, nb = a.count(), b.count()
    if na > nb:
        return bid_assignment(b, a, tolerance, block).select(
            F.col("b").alias("a"), F.col("a").alias("b"), "sim")

    def blocks(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("_blk", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // block)))).cast("int"))

    rows, cols = cut(blocks(a, na)), cut(blocks(b, nb))
    row_type = a.schema["id"].dataType.simpleString()
    col_type = b.schema["id"].dataType.simpleString()
    prices = cut(cols.select("id", "_blk", F.lit(0.0).alias("price")))
    owned = cut(a.sparkSession.createDataFrame([], f"a {row_type}, b {col_type}, sim double"))
    n_blocks = max(1, -(-nb // block))
    while True:
        waiting = rows.join(owned.select(F.col("a").alias("id")), "id", "left_anti")
        if waiting.isEmpty():
            return owned
        left = (waiting.withColumnRenamed("_blk", "_rb")
                .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
        right = (cols.join(prices.select("id", "price"), "id").withColumnRenamed("_blk", "_cb")
                 .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-na // block)) - 1)))))

        def two_best(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if l.empty or r.empty:
                return pd.DataFrame({"a": [], "b": [], "sim": [], "net": []})
            sim = np.stack(l["vec"].to_numpy()).astype(float) @ np.stack(r["vec"].to_numpy()).astype(float).T
            net = sim - r["price"].to_numpy()[None, :]
            take = min(2, net.shape[1])
            top = np.argsort(-net, axis=1, kind="stable")[:, :take]
            line = np.repeat(np.arange(len(l)), take)
            pick = top.ravel()
            return pd.DataFrame({"a": l["id"].to_numpy()[line], "b": r["id"].to_numpy()[pick],
                                 "sim": sim[line, pick], "net": net[line, pick]})

        offers = (left.groupBy("_rb", "_cb").cogroup(right.groupBy("_rb", "_cb"))
                  .applyInPandas(two_best, f"a {row_type}, b {col_type}, sim double, net double"))
        wish = offers.groupBy("a").agg(F.max(F.struct("net", "b", "sim")).alias("_1"),
                                       F.slice(F.sort_array(F.collect_list("net"), asc=False), 2, 1).alias("_2"))
        second = F.coalesce(F.try_element_at("_2", F.lit(1)), F.col("_1.net"))
        bid = wish.select("a", "_1.b", "_1.sim", (F.col("_1.net") - second + tolerance).alias("raise"))
        won = cut(bid.groupBy("b").agg(F.max(F.struct("raise", "a", "sim")).alias("_w"))
                  .select("_w.a", "b", "_w.sim", "_w.raise"))
        prices = cut(prices.join(won.select(F.col("b").alias("id"), "raise"), "id", "left")
                     .select("id", "_blk", (F.col("price") + F.coalesce("raise", F.lit(0.0))).alias("price")))
        owned = cut(owned.join(won.select("b"), "b", "left_anti").select("a", "b", "sim")
                    .unionByName(won.select("a", "b", "sim")))
