"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells. A query visits all cells in which the least
distance that it can have to a vector there does not exclude a link, so every link is found, from both ends. Neighbouring
cells with few rows are stored as one tile, to which a query travels once.
Everything found is verified by its cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.runtime import cut
from runframe.operators.graph import connected_components


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from a seeded start; an empty cluster keeps its centre."""
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = squares(points, centres).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1))


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.apart = [np.sqrt(squares(b, b)) for b in self.books]

    @classmethod
    def fit(cls, vectors: np.ndarray, codes: int) -> Grid:
        half = vectors.shape[1] // 2
        return cls(kmeans(vectors[:, :half], codes), kmeans(vectors[:, half:], codes))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of each vector, and for each half the least squared distance to every code's region."""
        half, cell, least = self.books[0].shape[1], 0, []
        for book, apart, part in zip(self.books, self.apart, (x[:, :half], x[:, half:])):
            d = squares(part, book)
            near = d.argmin(1)
            gap = d - d[np.arange(len(d)), near][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                to_plane = np.where(apart[near] > 0, gap / (2 * apart[near]), 0)
            least.append(to_plane ** 2)
            cell = cell * len(book) + near
        return cell, least

    def visits(self, least: list[np.ndarray], reach: float) -> Iterator[np.ndarray]:
        """Cells of each query by rising sum over both halves, as far as ``reach``."""
        first, second = least
        columns = len(self.books[1])
        order_a, order_b = first.argsort(1), second.argsort(1)
        for q in range(len(first)):
            a, b = first[q, order_a[q]], second[q, order_b[q]]
            i = np.repeat(np.arange(len(a)), np.searchsorted(b, reach - a, "right"))
            j = np.concatenate([np.arange(n) for n in np.searchsorted(b, reach - a, "right")])
            rank = (a[i] + b[j]).argsort(kind="stable")
            yield order_a[q, i[rank]] * columns + order_b[q, j[rank]]


def _local_links(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray,
                 threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of each query, and (member, smallest member) of the parts that the links of this block form."""
    linked = queries @ rows.T >= threshold
    linked &= q_ids[:, None] != ids[None, :]
    count = linked @ weights
    if not linked.any():
        return count, q_ids[:0], q_ids[:0]
    top = np.iinfo(np.int64).max
    labels, before = ids.copy(), None
    while before is None or (labels != before).any():
        before = labels
        of_query = np.minimum(np.where(linked, labels[None, :], top).min(1), q_ids)
        labels = np.minimum(labels, np.where(linked, of_query[:, None], top).min(0))
    some_q, some_r = linked.any(1), linked.any(0)
    return count, np.concatenate([q_ids[some_q], ids[some_r]]), np.concatenate([of_query[some_q], labels[some_r]])


def _matched(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (block key, role, id, weight, vector as ``kind``): one matrix product per block."""
    def finish(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(parts)
        ids = block.column("id").to_numpy()
        if not len(ids):
            return
        x = unit(np.frombuffer(b"".join(block.column("raw").to_pylist()), kind).reshape(len(ids), -1))
        query = block.column("query").to_numpy(zero_copy_only=False)
        weights = block.column("m").to_numpy()[~query]
        count, member, root = _local_links(x[query], ids[query], x[~query], ids[~query], weights, threshold)
        some = count > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[query][some], member])),
             pa.array(np.concatenate([count[some], np.zeros(len(member), np.int64)])),
             pa.array(np.concatenate([ids[query][some], root]))], ["id", "links", "root"])

    open_key, parts = None, []
    for batch in batches:
        keys = batch.column("block").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if parts and keys[a] != open_key:
                yield from finish(parts)
                parts = []
            open_key = keys[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield from finish(parts)


def near_vectors(df: DataFrame, threshold: float = 0.98, id: str = "vec_id", vector: str = "embedding",
                 label: str = "label", codes: int = 16, sample: int = 8_000, block: int = 2_000) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows link when labels are equal and the cosine reaches ``threshold``.

    Codebooks are fitted on at most ``sample`` vectors taken in the order of a hash; every vector is indexed, and the sample
    only changes the work, not the links. Equal vectors are compared once and counted as often as they occur.
    Cells are stored in tiles of about ``block`` rows. A tile with many rows or queries is cut into
    squares of about ``block`` by ``block``, whatever its size; a square passes on one row per linked vector.
    Vectors that are null, zero or hold null or non-finite components, and rows with a null label or id, link
    with nothing; vectors of unequal length don't link. A null id has a null component and is not kept.
    """
    v = F.col(vector).cast("array<double>")
    sound = (F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
             & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    sound = F.coalesce(sound, F.lit(False))
    rows = df.select(F.col(id).cast("long").alias("id"), F.when(sound, F.xxhash64(label, F.size(vector))).alias("g"),
                     F.when(sound, F.xxhash64(vector)).alias("f"), F.when(sound, F.xxhash64(F.lit(1), vector)).alias("h"),
                     F.when(sound, v).alias("v"))
    distinct = cut(rows.where("g IS NOT NULL").groupBy("g", "f", "h").agg(
        F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
        .withColumn("id", F.monotonically_increasing_id()))  # one row per distinct vector, fixed by the checkpoint
    dims = [r[0] for r in distinct.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(64).collect()]
    grids = {}
    for n in dims:
        drawn = distinct.where(F.size("v") == n).orderBy(F.xxhash64("f", "h"), "id").select("v").limit(sample).collect()
        x = unit(np.array([r[0] for r in drawn]))
        grids[n] = Grid.fit(x, codes)
    reach = 2 - 2 * threshold + 1e-9  # the squared distance of unit vectors beyond which nothing links
    element = df.schema[vector].dataType.elementType
    kind = "f4" if isinstance(element, T.FloatType) else "f8"  # as given: nothing is rounded on the way
    shared = df.sparkSession.sparkContext.broadcast(grids)
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _by_length(batch):
                ids, g, m, given = row
                x, grid = unit(given), shared.value.get(given.shape[1])
                raw = [r.tobytes() for r in given.astype(kind)]
                if grid is None:  # a rare length: one cell
                    cell, visits = np.zeros(len(x), np.int64), [np.zeros(1, np.int64)] * len(x)
                else:
                    cell, least = grid.place(x)
                    visits = list(grid.visits(least, reach))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(g), pa.array(m), pa.array(raw, pa.binary()), pa.array(cell.astype(np.int64)),
                     pa.array([c.tolist() for c in visits], pa.list_(pa.int64()))], ["id", "g", "m", "raw", "cell", "visits"])

    placed = cut(distinct.select("id", "g", "m", "v").mapInArrow(
        place, "id long, g long, m long, raw binary, cell long, visits array<long>"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("cell")) - F.col("n")  # a group has codes * codes cells at most
    tiles = cut(placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"))
                .withColumn("tile", F.floor(before / block)))
    asked = cut(placed.select("g", F.explode("visits").alias("cell"), "id").join(tiles.drop("n"), ["g", "cell"])
                .select("g", "tile", "id").distinct())
    stored_n = tiles.groupBy("g", "tile").agg(F.sum("n").alias("n"))
    asked_n = asked.groupBy("g", "tile").agg(F.count(F.lit(1)).alias("nq"))
    split = stored_n.join(asked_n, ["g", "tile"]).select(
        "g", "tile", F.ceil(F.col("n") / block).cast("int").alias("bs"), F.ceil(F.col("nq") / block).cast("int").alias("bq"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["g", "tile", "a", "b", "query", "id", "m", "raw"]
    stored = (placed.join(tiles.drop("n"), ["g", "cell"]).join(split, ["g", "tile"]).withColumn("a", part("bs")).withColumn("query", F.lit(False))
              .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("bq") - 1))).select(columns))
    asking = (asked.join(split, ["g", "tile"]).join(placed.select("id", "m", "raw"), "id").withColumn("b", part("bq")).withColumn("query", F.lit(True))
              .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("bs") - 1))).select(columns))
    blocks = (stored.unionByName(asking).withColumn("block", F.xxhash64("g", "tile", "a", "b"))
              .select("block", "query", "id", "m", "raw").repartition("block").sortWithinPartitions("block"))
    found = cut(blocks.mapInArrow(lambda it: _matched(it, threshold, kind), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(distinct.select("id"), found.where("id <> root").selectExpr("id AS a", "root AS b"))
    known = distinct.select("id", "g", "f", "h", "rep", "m").join(links, "id", "left").join(parts, "id")
    smallest = known.groupBy("component").agg(F.min("rep").alias("root"))
    facts = known.join(smallest, "component").select(
        "g", "f", "h", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), "root")
    out = rows.drop("v").join(facts, ["g", "f", "h"], "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple]:
    vectors = batch.column("v").to_pylist()
    sizes = np.array([len(v) for v in vectors])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield (batch.column("id").to_numpy()[at], batch.column("g").to_numpy()[at], batch.column("m").to_numpy()[at],
               np.array([vectors[i] for i in at], np.float64))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, cast(coalesce(n, 0) AS bigint) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
