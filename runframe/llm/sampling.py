"""Distinct sampled SentencePiece segmentations by Gumbel top-k, and decoding.

A text's lattice has a node at every character and an edge for every piece. Piece weights give every segmentation a
probability; summed backwards, they turn into a choice of the next piece at each node. The ``k`` segmentations with the
largest perturbed log probabilities are a sample without replacement. The search is A-star over subtrees: a node
"these pieces, then anything" has as its key the maximum of its Gumbels, drawn top-down. Opening the best node
follows its best path to the end, and leaves for each step one node "same pieces so far, but another one here".
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.llm.common import free_name, groups, lengths_to_starts, mixed, ranges, schema_with, with_column

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Pieces:
    """Pieces of a model file with log weights, and lattices of units (a word with the blanks before it)."""

    def __init__(self, path: str, temperature: float = 1.0, limit: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(len(self.model)) if not (self.model.is_control(i) or self.model.is_unknown(i)
                                                          or self.model.is_byte(i) or self.model.is_unused(i))]
        # merge order as a rank: a piece weighs as the inverse of its rank, scaled by the temperature
        rank = {i: r + 1 for r, i in enumerate(sorted(usable, key=lambda i: (-self.model.get_score(i), i)))}
        self.piece = {self.model.id_to_piece(i): (i, -np.log(rank[i] + 1.0) / temperature) for i in usable}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_weight = -np.log(len(rank) + 2.0) / temperature
        self.longest = max(map(len, self.piece))
        # an open hash table of pieces (their ids) and of mere beginnings of pieces (-1)
        self.slots = np.zeros(1 << 20, np.uint64)
        self.slot_id, self.slot_weight = np.zeros(1 << 20, np.int32), np.zeros(1 << 20)
        for text, (i, w) in self.piece.items():
            h = 0
            for n, c in enumerate(text, 1):
                h = (h * int(BASE) + ord(c)) % (1 << 64)
                at = int(self.find(np.array([h], np.uint64))[0])
                if not self.slots[at]:
                    self.slots[at], self.slot_id[at] = h, -1
                if n == len(text):
                    self.slot_id[at], self.slot_weight[at] = i, w
        surface = {i: text.replace(SPACE, " ").encode() for text, (i, _) in self.piece.items()}
        surface |= {i: bytes([b]) for b, i in enumerate(self.bytes)}
        each = [surface.get(i, b"") for i in range(len(self.model))]
        self.surface, self.surface_size = np.frombuffer(b"".join(each), np.uint8), np.array([len(x) for x in each])
        self.surface_start = lengths_to_starts(self.surface_size)[:-1]
        self.limit = limit
        self.clear()

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot that holds each hash, or the free one where it would go."""
        slot = (mixed(h) >> np.uint64(44)).astype(np.int64)
        while True:
            other = np.flatnonzero((self.slots[slot] != h) & (self.slots[slot] != 0))
            if not len(other):
                return slot
            slot[other] = (slot[other] + 1) % len(self.slots)

    def clear(self) -> None:
        """Lattices of units in flat arrays: edges of a node lie together, with cumulated probabilities."""
        self.unit: dict[str, int] = {}
        self.first = _Column(np.int32)   # first node of a unit
        self.edges = _Column(np.int32)   # first edge of a node, or -1 at a unit's end
        self.count = _Column(np.int32)   # edges of a node
        self.to = _Column(np.int32)      # node an edge leads to
        self.token = _Column(np.int32)   # token of an edge: id, or -1 - index of a byte run
        self.p = _Column(np.float64)     # probability of an edge at its node
        self.cumulated = _Column(np.float32)  # probability of a node's edges up to this one
        self.runs: list[list[int]] = []

    def learn(self, units: list[str]) -> None:
        """Adds the lattices of new units, all at once."""
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes)
        unit_end = np.repeat(np.cumsum(sizes), sizes)
        number = np.repeat(np.arange(len(units)), sizes)
        node = np.arange(n) + number  # every unit has one node more than characters
        # pieces at every character, longer and longer while any piece begins so
        rows, steps, ids, weights = [], [], [], []
        at, h, k = np.arange(n), np.zeros(n, np.uint64), 0
        while len(at):
            h = h * BASE + codes[at + k]
            slot = self.find(h)
            state = self.slot_id[slot]
            known = self.slots[slot] == h
            hit = known & (state >= 0)
            if k == 0:  # no piece for this character: its bytes
                for i in np.flatnonzero(~hit).tolist():
                    run = [self.bytes[x] for x in chr(int(codes[i])).encode()]
                    if len(run) > 1:
                        self.runs.append(run)
                    rows.append(np.array([i]))
                    steps.append(np.array([1]))
                    ids.append(np.array([-len(self.runs) if len(run) > 1 else run[0]]))
                    weights.append(np.array([len(run) * self.byte_weight]))
            rows.append(at[hit])
            steps.append(np.full(int(hit.sum()), k + 1))
            ids.append(state[hit])
            weights.append(self.slot_weight[slot[hit]])
            k += 1
            more = known & (at + k < unit_end[at])
            at, h = at[more], h[more]
        row, step, token, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, steps, ids, weights))
        order = np.lexsort((step, row))
        row, step, token, weight = row[order], step[order], token[order], weight[order]
        target = node[row] + step
        # log weight of all ways from each character to its unit's end, the last characters first
        rest = np.zeros(n + len(units))
        to_end = (unit_end - np.arange(n))[row]
        late = np.lexsort((row, to_end))
        cuts = np.searchsorted(to_end[late], np.arange(1, int(to_end.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = late[a:b]
            ways = weight[own] + rest[target[own]]
            begin = np.flatnonzero(np.diff(row[own], prepend=-1))
            top = np.maximum.reduceat(ways, begin)
            total = np.add.reduceat(np.exp(ways - np.repeat(top, np.diff(begin, append=len(own)))), begin)
            rest[node[row[own[begin]]]] = top + np.log(total)
        p = np.minimum(np.exp(weight + rest[target] - rest[node[row]]), 1.0)
        per_node = np.bincount(row, minlength=n)
        ends = np.cumsum(per_node)
        running = np.cumsum(p)
        running -= np.repeat(running[ends - per_node] - p[ends - per_node], per_node)
        running[ends - 1] = 1.0
        base, first_edge = self.edges.size, self.to.size
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        first = np.full(n + len(units), -1, np.int64)
        count = np.zeros(n + len(units), np.int32)
        first[node], count[node] = first_edge + ends - per_node, per_node
        for u in units:
            self.unit[u] = len(self.unit)
        self.first.add(base + starts)
        self.edges.add(first)
        self.count.add(count)
        self.to.add(base + target)
        self.token.add(token)
        self.p.add(p)
        self.cumulated.add(running)

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Units of some texts, with what is new learnt; forgets older units when there are too many."""
        if len(self.unit) > self.limit or self.to.size > 60 * self.limit:
            self.clear()
        units = [self.units(t) for t in texts]
        new = sorted(set().union(*units).difference(self.unit))
        for i in range(0, len(new), 20_000):
            self.learn(new[i:i + 20_000])
        return units

    def units(self, text: str) -> list[str]:
        """The model's own view of a text: a blank before it, blanks marked."""
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class _Column:
    """A growing array."""

    def __init__(self, kind):
        self.values, self.size = np.zeros(1024, kind), 0

    def add(self, new) -> None:
        need = self.size + len(new)
        if need > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(self.values), len(new)), self.values.dtype)])
        self.values[self.size:need] = new
        self.size = need


@lru_cache(maxsize=2)
def pieces(path: str, temperature: float) -> Pieces:
    return Pieces(path, temperature)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) by hashing: the same for a row on any cluster and in any batch."""
    return ((mixed(mixed(x)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _streams(seed: np.ndarray | int, opening: int, kind: int, n: int | np.ndarray) -> np.ndarray:
    """Starts of ``n`` streams of numbers of a row, for one opening and purpose."""
    at = np.arange(n, dtype=np.uint64) if np.isscalar(n) else n.astype(np.uint64)
    return mixed(np.asarray(seed, np.uint64) + np.uint64(4 * opening + kind)) + at * BASE


def _walk(own: Pieces, node: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws the pieces from every node to the end of its unit; (edges in text order, edges of each unit)."""
    first, count, cumulated, to = own.edges.values, own.count.values, own.cumulated.values, own.to.values
    unit, now, step = np.arange(len(node)), node, 0
    edges, units = [], []
    while len(now):
        begin, n = first[now], count[now]
        u = uniform(streams[unit] + np.uint64(step * 0xD1342543DE82EF95 % (1 << 64)))
        pick = begin.copy()
        open_ = np.flatnonzero((n > 1) & (cumulated[begin] <= u))
        while len(open_):
            pick[open_] += 1
            open_ = open_[(pick[open_] < begin[open_] + n[open_] - 1) & (cumulated[pick[open_]] <= u[open_])]
        edges.append(pick)
        units.append(unit)
        now = to[pick]
        going = first[now] >= 0
        now, unit, step = now[going], unit[going], step + 1
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = np.concatenate(units)
    rank = unit.argsort(kind="stable")
    return np.concatenate(edges)[rank], np.bincount(unit, minlength=len(node))


def _lower(top: float, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of subtrees with these log masses, given that each stays below ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(u)) - log_mass)


class Search:
    """The A-star search of one text. ``open`` names the nodes to walk from, ``close`` takes the walk's edges."""

    def __init__(self, own: Pieces, nodes: np.ndarray, seed: int, k: int):
        self.own, self.nodes, self.seed, self.k = own, nodes, seed, k
        key = float(-np.log(-np.log(uniform(_streams(seed, 0, 0, 1))[0])))
        # (minus key, order of making, log mass, edges so far, (unit, node, barred edges) or None)
        self.heap: list[tuple] = [(-key, 0, 0.0, np.zeros(0, np.int64), None)]
        self.found: list[tuple[np.ndarray, float, float]] = []
        self.made, self.after = 1, None

    def _push(self, key: float, mass: float, done: np.ndarray, choice: tuple) -> None:
        heapq.heappush(self.heap, (-key, self.made, mass, done, choice))
        self.made += 1

    def open(self) -> np.ndarray | None:
        """Nodes from which the best subtree's best segmentation goes on; None when the search is over."""
        if not self.heap or len(self.found) == self.k:
            self.after = -self.heap[0][0] if self.heap else None
            return None
        minus, _, mass, done, choice = heapq.heappop(self.heap)
        self.key, self.begin, self.unit, rest = -minus, mass, -1, self.nodes
        if choice is not None:  # another piece than those barred, by its share of the rest
            unit, node, barred = choice
            own = self.own
            options = np.arange(own.edges.values[node], own.edges.values[node] + own.count.values[node])
            options = options[~np.isin(options, barred)]
            share = own.p.values[options]
            u = uniform(_streams(self.seed, len(self.found), 1, 2))
            at = min(int(np.searchsorted(np.cumsum(share), u[0] * share.sum(), "right")), len(options) - 1)
            before, left = mass - np.log(share.sum()), share.sum() - share[at]
            if len(options) > 1 and left > 0:
                lump = before + np.log(left)
                self._push(float(_lower(self.key, lump, u[1:])[0]), lump, done, (unit, node, np.append(barred, options[at])))
            self.begin = before + np.log(share[at])
            done = np.append(done, options[at])
            inside = own.to.values[options[at]]
            rest, self.unit = self.nodes[unit + 1:], unit
            if own.edges.values[inside] >= 0:
                rest, self.unit = np.concatenate([[inside], rest]), unit - 1
        self.done, self.rest = done, rest
        return rest

    def close(self, edges: np.ndarray, per_unit: np.ndarray) -> None:
        own = self.own
        q = own.p.values[edges]
        mass = self.begin + np.concatenate([[0.0], np.cumsum(np.log(q))])
        self.found.append((np.concatenate([self.done, edges]), float(mass[-1]), float(self.key)))
        # what is left behind: at each step, any other piece
        left = np.flatnonzero(q < 1 - 1e-15)
        if not len(left):
            return
        masses = mass[left] + np.log1p(-q[left])
        keys = _lower(self.key, masses, uniform(_streams(self.seed, len(self.found), 2, len(left))))
        need = self.k + 1 - len(self.found)  # no more of them can be reached
        ends = np.cumsum(per_unit)
        for _ in range(min(need, len(left))):
            i = int(keys.argmax())
            e = int(left[i])
            which = int(np.searchsorted(ends, e, "right"))
            start = int(ends[which] - per_unit[which])
            node = int(self.rest[which] if e == start else own.to.values[edges[e - 1]])
            self._push(float(keys[i]), float(masses[i]), np.concatenate([self.done, edges[:e]]),
                       (self.unit + 1 + which, node, edges[e:e + 1]))
            keys[i] = -np.inf

    def result(self) -> list[tuple[np.ndarray, float, float, float]]:
        chance = lambda log_p: 1.0 if self.after is None else float(-np.expm1(-np.exp(min(log_p - self.after, 700.0))))
        return [(edges, log_p, key, chance(log_p)) for edges, log_p, key in self.found]


def sample(own: Pieces, texts: list[str], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For every text up to ``k`` distinct segmentations by falling key: (edges, log probability, key, inclusion score).

    The inclusion score is the probability that a segmentation's key passes the next key after the sample; it is 1 when
    there are no others. The texts are searched side by side, each by its own numbers.
    """
    units = own.prepare(texts)
    which = np.fromiter(map(own.unit.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
    nodes, cuts = own.first.values[which], lengths_to_starts(np.array([len(us) for us in units], np.int64))
    searches = [Search(own, nodes[a:b], s, k) for a, b, s in zip(cuts[:-1], cuts[1:], seeds)]
    going = searches
    while going:
        opened = [(s, rest) for s in going if (rest := s.open()) is not None]
        if not opened:
            break
        sizes = np.array([len(rest) for _, rest in opened], np.int64)
        streams = [_streams(s.seed, len(s.found), 3, len(rest)) for s, rest in opened]
        edges, per_unit = _walk(own, np.concatenate([rest for _, rest in opened]), np.concatenate(streams))
        unit_cuts = lengths_to_starts(sizes)
        edge_cuts = lengths_to_starts(per_unit)[unit_cuts]
        for i, (s, _) in enumerate(opened):
            s.close(edges[edge_cuts[i]:edge_cuts[i + 1]], per_unit[unit_cuts[i]:unit_cuts[i + 1]])
        going = [s for s, _ in opened]
    return [s.result() for s in searches]


def ids_of(own: Pieces, edges: np.ndarray) -> np.ndarray:
    tokens = own.token.values[edges]
    if (tokens >= 0).all():
        return tokens
    return np.array([x for t in tokens.tolist() for x in ([t] if t >= 0 else own.runs[-1 - t])], np.int32)


SAMPLE = T.ArrayType(T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()),
    T.StructField("key", T.DoubleType()), T.StructField("inclusion", T.DoubleType())]))
SAMPLE_ARROW = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("key", pa.float64()),
                                   ("inclusion", pa.float64())]))
DIGEST = T.ArrayType(T.StructType([
    T.StructField("n_pieces", T.IntegerType()), T.StructField("ids_crc32", T.LongType()), T.StructField("log_prob", T.DoubleType()),
    T.StructField("key", T.DoubleType()), T.StructField("inclusion", T.DoubleType()), T.StructField("same_text", T.BooleanType())]))
DIGEST_ARROW = pa.list_(pa.struct([("n_pieces", pa.int32()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()),
                                   ("key", pa.float64()), ("inclusion", pa.float64()), ("same_text", pa.bool_())]))


def seed_of(id: object, seed: int) -> int:
    return zlib.crc32(repr(id).encode()) << 32 | zlib.crc32(repr((seed, id)).encode())


def sample_segmentations(docs: DataFrame, path: str, k: int = 2, temperature: float = 1.0, seed: int = 0,
                         id: str = "doc_id", text: str = "text", out: str = "samples", digest: bool = False,
                         chars: int = 400_000) -> DataFrame:
    """``docs`` with an array ``out`` of up to ``k`` distinct segmentations of the whole text, largest key first.

    Each has its ids, log probability, perturbed key and inclusion score; with ``digest`` the number and crc32 of the
    ids instead, and whether decoding them gives the text back. A null or empty text has one segmentation, without
    ids. Rows of equal id and text are alike. A column named ``out`` is replaced.
    """
    kind, arrow = (DIGEST, DIGEST_ARROW) if digest else (SAMPLE, SAMPLE_ARROW)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path, temperature)
        for batch in batches:
            rows, values = [], [t or "" for t in batch.column(text).to_pylist()]
            keys = batch.column(id).to_pylist()
            for a, b in groups(values, chars):
                for value, found in zip(values[a:b], sample(own, values[a:b], [seed_of(x, seed) for x in keys[a:b]], k)):
                    row = []
                    for edges, log_p, perturbed, score in found:
                        ids = ids_of(own, edges)
                        facts = {"log_prob": log_p, "key": perturbed, "inclusion": score}
                        if digest:
                            row.append(facts | {"n_pieces": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                                                "same_text": decode(own, ids) == value})
                        else:
                            row.append(facts | {"ids": ids})
                    rows.append(row)
            yield with_column(batch, out, pa.array(rows, arrow))

    return docs.mapInArrow(add, schema_with(docs, out, kind))


def decode(own: Pieces, ids: np.ndarray | list[int]) -> str:
    """The text of some ids: surfaces in a row, without the blank put before the text."""
    ids = np.asarray(ids, np.int64)
    raw = own.surface[ranges(own.surface_start[ids], own.surface_size[ids])].tobytes()
    return raw.removeprefix(b" ").decode()


def decode_segmentations(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text that a column of id arrays stands for; null for null."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path, 1.0)
        for batch in batches:
            values = [None if x is None else decode(own, x) for x in batch.column(ids).to_pylist()]
            yield with_column(batch, out, pa.array(values, pa.string()))

    return df.mapInArrow(add, schema_with(df, out, T.StringType()))


def segmentation_report(docs: DataFrame, path: str, k: int = 2) -> DataFrame:
    """One row per document and sampled segmentation."""
    name = free_name(docs, "samples")
    found = sample_segmentations(docs.select("doc_id", "text"), path, k, out=name, digest=True)
    return found.select("doc_id", F.posexplode(name).alias("sample", "s")).select("doc_id", "sample", "s.*")
