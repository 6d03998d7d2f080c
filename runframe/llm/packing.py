"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Documents are encoded once and cut into pieces of at most one sequence; the pieces are a written table. Only (key, length)
rows are packed: pieces are dealt into groups by hash, each group is packed best-fit by falling length, and
its bins that stay underfull are improved by moves and by exchanges of one or two pieces for one, each of which raises the sum of
squared fills, until no exchange helps; bins that lose all their pieces go. Full bins are final. The pieces of all underfull
bins meet again in fewer groups, round after round, until one group holds the rest, so the number of groups costs
no sequences and no task ever holds more than a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runframe.functions.runtime import cut, work_folder
from runframe.llm.common import lengths_to_starts
from runframe.llm.wordpieces import word_encoder

PIECE = "piece_key long, doc_id long, piece int, start long, length long, ids binary"
KEYS_PER_TASK = 1 << 36
GROUP = 16_384


def encode_pieces(docs: DataFrame, folder: str, path: str, size: int = 2048, end: int | None = 0, id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Write and read back the pieces of every document: ids (little-endian, 4 bytes each) of its ``start``-th id and on.

    A document's ids are those of the tokenizer file ``path``, then ``end``. Only documents of more than ``size`` ids are
    cut. A null text is empty; without an end id an empty document has one piece of length 0. ``piece_key`` numbers the
    rows, so repeated rows and null ids stay apart.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, key = word_encoder(path), TaskContext.get().partitionId() * KEYS_PER_TASK
        for batch in batches:
            ids, values = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b, flat, counts in own.encode_all(values):
                if end is not None:
                    flat = np.insert(flat, np.cumsum(counts), end)
                    counts = counts + 1
                pieces = np.maximum(-(-counts // size), 1)
                doc = np.repeat(np.arange(b - a), pieces)
                number = np.arange(len(doc)) - lengths_to_starts(pieces)[doc]
                first = lengths_to_starts(counts)[doc] + number * size
                length = np.minimum(counts[doc] - number * size, size)
                edges = np.append(first, len(flat)).astype(np.int32) * 4
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(doc))), ids.slice(a, b - a).take(pa.array(doc)), pa.array(number.astype(np.int32)),
                     pa.array(number * size), pa.array(length), raw], ["piece_key", "doc_id", "piece", "start", "length", "ids"])
                key += len(doc)

    docs.select(F.col(id).cast("long"), text).mapInArrow(encode, PIECE).write.parquet(folder)
    return docs.sparkSession.read.schema(PIECE).parquet(folder)


def best_fit(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Places of ``lengths`` in bins of ``size``: by falling length, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        room -= n
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


class LocalSearch:
    """Moves and exchanges between underfull bins, each of which raises the sum of squared fills.

    The emptiest bin gives: one piece to another bin, or one or two pieces for one smaller piece of a fuller bin.
    """

    def __init__(self, bins: list[list[int]], lengths: Sequence[int], size: int):
        self.size = size
        self.length = np.asarray(lengths, np.int64)
        self.items = np.array([i for b in bins for i in b], np.int64)
        self.bin = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        self.own = self.length[self.items]
        self.fill = np.bincount(self.bin, self.own, len(bins)).astype(np.int64)

    def _sums(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every room: the largest piece, and the largest sum of two pieces, that it takes (0: none)."""
        one, two = (np.zeros(self.size + 1, np.int64) for _ in range(2))
        one[lengths] = lengths
        kinds, times = np.unique(lengths, return_counts=True)
        pairs = (kinds[:, None] + kinds)[np.triu(np.ones((len(kinds),) * 2, bool), 1)]
        pairs = np.concatenate([pairs, 2 * kinds[times > 1]])
        pairs = pairs[pairs <= self.size]
        two[pairs] = pairs
        return np.maximum.accumulate(one), np.maximum.accumulate(two)

    def _give(self, giver: int) -> bool:
        """The best move or exchange out of ``giver``; False when none raises the sum."""
        mine = np.flatnonzero(self.bin == giver)
        one, two = self._sums(self.own[mine])
        room = self.size - self.fill
        taker = (room > 0) & (self.fill >= self.fill[giver])
        taker[giver] = False
        alone = np.where(taker, one[np.maximum(room, 0)], 0)
        target = np.where(taker[self.bin], np.minimum(self.own + room[self.bin], self.size), 0)
        for_one, for_two = one[target] - self.own, two[target] - self.own
        gains = [np.where(d > 0, d * (f - self.fill[giver] + d), 0)
                 for d, f in ((alone, self.fill), (for_one, self.fill[self.bin]), (for_two, self.fill[self.bin]))]
        best = [int(g.argmax()) if len(g) else 0 for g in gains]
        kind = max(range(3), key=lambda k: gains[k][best[k]] if len(gains[k]) else 0)
        if not len(gains[kind]) or gains[kind][best[kind]] <= 0:
            return False
        at = best[kind]
        if kind == 0:
            given, back, other = [mine[self.own[mine] == alone[at]][0]], None, at
        else:
            back, other = at, self.bin[at]
            if kind == 1:
                given = [mine[self.own[mine] == self.own[at] + for_one[at]][0]]
            else:
                wanted, seen = self.own[at] + for_two[at], {}
                for m in mine:
                    if wanted - self.own[m] in seen:
                        given = [seen[wanted - self.own[m]], m]
                        break
                    seen.setdefault(self.own[m], m)
        gain = self.own[given].sum() - (0 if back is None else self.own[back])
        self.bin[given] = other
        if back is not None:
            self.bin[back] = giver
        self.fill[other] += gain
        self.fill[giver] -= gain
        return True

    def run(self) -> list[list[int]]:
        """Exchanges until a turn over all bins, the emptiest first, changes nothing."""
        changed = True
        while changed:
            changed = False
            for giver in np.argsort(self.fill, kind="stable"):
                while 0 < self.fill[giver] < self.size and self._give(giver):
                    changed = True
        order = np.argsort(self.bin, kind="stable")
        edges = lengths_to_starts(np.bincount(self.bin, minlength=len(self.fill)))
        return [self.items[order[a:b]].tolist() for a, b in zip(edges[:-1], edges[1:]) if a < b]


def pack_lengths(lengths: Sequence[int], size: int) -> list[list[int]]:
    """Bins of places: best fit, then the local search over the underfull ones."""
    bins = best_fit(lengths, size)
    fill = [sum(lengths[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, fill) if f >= size]
    open_ = [b for b, f in zip(bins, fill) if f < size]
    return full + (LocalSearch(open_, lengths, size).run() if len(open_) > 1 else open_)


PLACED = "piece_key long, sequence_id long, offset long"


def pack(pieces: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """(piece_key, sequence_id, offset) of every row of ``pieces`` (piece_key, length of at most ``size``).

    After a round that leaves more than half of its pieces in underfull bins, the next one also closes the fuller half of
    such bins, so every other round at least halves what is left.
    """
    whole = pieces.where(F.col("length") >= size).select("piece_key", F.col("piece_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < size).select("piece_key", "length")
    done, n, turn, last, closing = [whole], left.count(), 0, False, False
    while n and not last:
        turn, parts = turn + 1, -(-n // group)

        def place(table: pa.Table) -> pa.Table:
            table = table.sort_by([("length", "descending"), ("piece_key", "ascending")])
            lengths, keys = table["length"].to_pylist(), table["piece_key"].to_numpy()
            bins = pack_lengths(lengths, size)
            flat = np.array([i for b in bins for i in b], np.int64)
            sizes = np.array([len(b) for b in bins])
            own = np.array(lengths, np.int64)[flat]
            starts, firsts = lengths_to_starts(own)[:-1], lengths_to_starts(sizes)[:-1]
            fill = np.add.reduceat(own, firsts)
            final = fill >= (np.median(fill) if closing else size)
            number = table["_group"][0].as_py() * 2 * group + np.arange(len(bins)) + (turn << 57)
            return pa.table({"piece_key": keys[flat], "sequence_id": np.repeat(number, sizes),
                             "offset": starts - np.repeat(starts[firsts], sizes), "length": own, "final": np.repeat(final, sizes)})

        dealt = left.withColumn("_group", F.pmod(F.xxhash64("piece_key", F.lit(turn)), F.lit(parts)))
        placed = cut(dealt.groupBy("_group").applyInArrow(place, f"{PLACED}, length long, final boolean"))
        last = parts == 1
        done.append((placed if last else placed.where("final")).select("piece_key", "sequence_id", "offset"))
        left, before = placed.where("NOT final").select("piece_key", "length"), n
        n = left.count()
        closing = 2 * n > before
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end: int | None = 0, id: str = "doc_id", text: str = "text",
                   group: int = GROUP) -> DataFrame:
    """Pieces of every document with their place: piece_key, doc_id, piece, start, length, ids, sequence_id, offset."""
    pieces = encode_pieces(docs, f"{work_folder(docs.sparkSession)}/pieces", path, size, end, id, text)
    return pieces.join(pack(pieces, size, group), "piece_key")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, pieces): the ids of every sequence in order (little-endian), and its pieces' documents and places."""
    return (placed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("_p"))
            .select("sequence_id", F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("length"),
                    F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
                    F.transform("_p", lambda p: F.struct(*[p[c].alias(c) for c in ("offset", "doc_id", "piece", "start", "length")])).alias("pieces")))


def packing_report(docs: DataFrame, path: str) -> DataFrame:
    pieces = encode_pieces(docs, f"{work_folder(docs.sparkSession)}/pieces", path)
    crc = F.crc32("ids").alias("ids_crc32")
    return (pieces.select("piece_key", "doc_id", "piece", "start", "length", crc).join(pack(pieces), "piece_key")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
