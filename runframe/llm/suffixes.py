"""Removal of long byte strings that occur more than once, by a distributed merge sort of sampled suffixes.

Every window of ``length`` bytes is settled at its anchor: the position in it whose following ``GRAM`` bytes hash lowest.
Equal windows have equal anchors at equal places, so only anchors whose gram occurs twice go on. An anchor's
suffix (with the bytes before it that its windows reach) stands for all windows settled there. Tasks sort the
suffixes of their documents into runs, front-code them (length of the prefix shared with the suffix before, then the rest)
and exchange the runs by gram. A loser tree combines the runs of a bucket; it compares two suffixes only from the prefix on
that both are known to share with the last one put out. Equal suffixes have all windows in common; the different
suffixes of one gram are compared window by window.

Grams that occur very often take another way, since one of them could fill a task: their windows are counted by a
128-bit hash over the cluster.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.runtime import cut
from runframe.llm.common import (
    RESULT, apart, groups, lengths_to_starts, mixed, packed_texts, row_key, schema_with, texts, unpacked, with_column)

GRAM = 64
FIELD_BITS = 12  # of a distance inside a window
LAST = (1 << FIELD_BITS) - 1
POSITION_BITS = 24  # a batch is worked on in stretches of less than 2 ** 24 bytes; longer texts in parts of one each


def _gram_hashes(flat: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on, by doubling the length six times."""
    h = mixed(flat.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < GRAM:
        ahead = np.concatenate([h[size:], np.zeros(min(size, len(h)), np.uint64)])
        h = h * np.uint64(0x9E3779B97F4A7C15 ^ (size << 20)) + ahead
        size *= 2
    return mixed(h)


def anchors(docs: list[bytes], length: int, bits: int = POSITION_BITS,
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram hash, anchor, first and last window start) of every anchor, positions counted in the document."""
    flat = np.frombuffer(b"".join(docs), np.uint8)
    starts = lengths_to_starts(np.array([len(d) for d in docs], np.int64))
    none = np.zeros(0, np.int64)
    if len(flat) < length:
        return none, none.astype(np.uint64), none, none, none
    h = _gram_hashes(flat)
    at = np.arange(len(flat), dtype=np.uint64)
    value = (h >> np.uint64(bits) << np.uint64(bits)) | at
    span, size = length - GRAM + 1, 1
    while size * 2 <= span:  # least value of the next `size` positions
        value[:-size] = np.minimum(value[:-size], value[size:])
        size *= 2
    least = value[:len(flat) - length + 1]
    if span > size:
        least = np.minimum(least, value[span - size:][:len(least)])
    sizes = np.diff(starts)
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(docs)), windows)
    p = starts[owner] + np.arange(len(owner)) - lengths_to_starts(windows)[owner]
    a = (least[p] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])])) if len(a) else none
    last = np.append(new[1:], len(a)) - 1 if len(a) else none
    doc = owner[new]
    return doc, h[a[new]], a[new] - starts[doc], p[new] - starts[doc], p[last] - starts[doc]


def _anchor_rows(docs: DataFrame, key: str, text: str, length: int, bits: int) -> DataFrame:
    """(h, key, at) of every anchor; ``at`` packs the first window start and the distances of anchor and last start."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(key).to_numpy(), texts(batch, text)
            for a, b in groups(values, 1 << 22):
                for c, stretch, at in _stretches(values, a, b, length, bits):
                    doc, h, anchor, first, last = anchors(stretch, length, bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(keys[c + doc]),
                         pa.array(first + at << 2 * FIELD_BITS | (anchor - first) << FIELD_BITS | (last - first))], ["h", "key", "at"])

    return docs.select(key, text).mapInArrow(emit, "h long, key long, at long")


def _stretches(values: list[bytes], a: int, b: int, length: int, bits: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(first document, texts, their start in it) of stretches that the position bits can count.

    A longer text goes in parts that overlap by ``length`` - 1 bytes: every window lies in exactly one of them.
    """
    if sum(len(values[i]) for i in range(a, b)) < 1 << bits:
        yield a, values[a:b], 0
        return
    size = (1 << min(bits, 22)) - 1
    for i in range(a, b):
        if len(values[i]) < 1 << bits:
            yield i, [values[i]], 0
            continue
        for at in range(0, len(values[i]) - length + 1, size - length + 1):
            yield i, [values[i][at:at + size]], at


# --- runs

def _front_coded(entries: list[tuple[bytes, list[tuple[int, int, int]]]]) -> bytes:
    """A sorted run: shared prefix, rest, and owners (key, first window start, windows - 1) of each distinct suffix."""
    parts, before = [struct.pack("<I", len(entries))], b""
    for suffix, owners in entries:
        shared = common_prefix(before, suffix, 0)
        parts.append(struct.pack("<HHI", shared, len(suffix) - shared, len(owners)))
        parts.append(suffix[shared:])
        parts += [struct.pack("<qqH", *o) for o in owners]
        before = suffix
    return b"".join(parts)


def _read_run(blob: bytes) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(prefix shared with the suffix before, suffix, owners) in order."""
    n, at, before = struct.unpack_from("<I", blob)[0], 4, b""
    for _ in range(n):
        shared, rest, owners = struct.unpack_from("<HHI", blob, at)
        at += 8
        before = before[:shared] + blob[at:at + rest]
        at += rest
        yield shared, before, list(struct.iter_unpack("<qqH", blob[at:at + 18 * owners]))
        at += 18 * owners


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that are known to share ``known`` bytes."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    step = 16
    while a[known:known + step] == b[known:known + step]:
        known += step
    low, high = known, min(known + step, most)
    while low < high:
        middle = (low + high + 1) // 2
        if a[known:middle] == b[known:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class LoserTree:
    """Merges sorted runs. A run's head carries the prefix it shares with the last suffix put out: the longer one is
    smaller, and only heads that share equally much are compared, from that prefix on."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        n = 1
        while n < len(runs):
            n *= 2
        self.size = n
        self.shared = [h[0] if h else -1 for h in self.heads] + [-1] * (n - len(runs))
        self.heads += [None] * (n - len(runs))
        self.shared = [0 if h else -1 for h in self.heads]
        self.losers = [0] * n
        winners = list(range(n))
        level = n
        while level > 1:
            level //= 2
            nxt = []
            for i in range(level):
                w, lost = self.play(winners[2 * i], winners[2 * i + 1])
                self.losers[level + i] = lost
                nxt.append(w)
            winners = nxt
        self.winner = winners[0]

    def play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then the one it shares with the winner."""
        sa, sb = self.shared[a], self.shared[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        if sa < 0:
            return a, b
        x, y = self.heads[a][1], self.heads[b][1]
        same = common_prefix(x, y, sa)
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            self.shared[b] = same
            return a, b
        self.shared[a] = same
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, list]]:
        """(prefix shared with the suffix before, suffix, owners) over all runs in order."""
        while self.heads[self.winner] is not None:
            w = self.winner
            _, suffix, owners = self.heads[w]
            yield self.shared[w], suffix, owners
            self.heads[w] = head = next(self.runs[w], None) if w < len(self.runs) else None
            self.shared[w] = head[0] if head else -1
            at = (w + self.size) // 2
            while at >= 1:
                w, self.losers[at] = self.play(w, self.losers[at])
                at //= 2
            self.winner = w


def _suffix(raw: bytes, at: int, length: int) -> tuple[bytes, int, int]:
    """(bytes from the anchor to the last window's end, then those before it, and their number in two bytes; first start; windows - 1)."""
    first, before, more = at >> 2 * FIELD_BITS, at >> FIELD_BITS & LAST, at & LAST
    return raw[first + before:first + more + length] + raw[first:first + before] + before.to_bytes(2, "big"), first, more


def _run_rows(joined: DataFrame, key: str, text: str, lists: str, length: int, buckets: int, flush: int = 40_000) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, tuple]] = []

        def runs() -> pa.RecordBatch:
            held.sort()
            rows: dict[int, list] = {}
            for bucket, suffix, owner in held:
                run = rows.setdefault(bucket, [])
                if run and run[-1][0] == suffix:
                    run[-1][1].append(owner)
                else:
                    run.append((suffix, [owner]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()),
                                               pa.array([_front_coded(r) for r in rows.values()], pa.binary())], ["bucket", "run"])

        for batch in batches:
            for k, raw, at in zip(batch.column(key).to_pylist(), unpacked(batch, text), batch.column(lists).to_pylist()):
                for x in at or ():
                    suffix, first, more = _suffix(raw, x, length)
                    held.append((zlib.crc32(suffix[:GRAM]) % buckets, suffix, (k, first, more)))
                if len(held) >= flush:
                    yield runs()
        if held:
            yield runs()

    return joined.select(key, text, lists).mapInArrow(emit, "bucket int, run binary")


def _ahead(suffix: bytes) -> int:
    """Bytes before the anchor, as a suffix ends with."""
    return suffix[-2] << 8 | suffix[-1]


def _windows(suffix: bytes, more: int) -> list[bytes]:
    """The windows settled at an anchor, the first start first."""
    before = _ahead(suffix)
    end = len(suffix) - 2
    whole = suffix[end - before:end] + suffix[:end - before]
    size = len(whole) - more
    return [whole[i:i + size] for i in range(more + 1)]


def _repeated(group: list[tuple[bytes, list]], out: list) -> None:
    """Adds (key, first start, last start) of repeated windows among the suffixes of one gram.

    Equal windows lie at equal places before their anchors, so they are compared place by place: memory follows
    the number of suffixes, not of windows.
    """
    places: dict[int, list[int]] = {}
    for at, (suffix, owners) in enumerate(group):
        if len(owners) > 1:
            out += [(k, first, first + more) for k, first, more in owners]
        if len(group) > 1:
            for before in range(_ahead(suffix) - owners[0][2], _ahead(suffix) + 1):
                places.setdefault(before, []).append(at)
    for before, members in places.items():
        times: dict[bytes, list[int]] = {}
        for at in members:
            suffix, owners = group[at]
            end = len(suffix) - 2
            size = end - owners[0][2]
            window = suffix[end - before:end] + suffix[:size - before] if before else suffix[:size]
            times.setdefault(window, []).append(at)
        for same in times.values():
            if len(same) > 1:
                for at in same:
                    suffix, owners = group[at]
                    if len(owners) == 1:
                        k, first, _ = owners[0]
                        out.append((k, first + _ahead(suffix) - before, first + _ahead(suffix) - before))


def _merged(runs: DataFrame) -> DataFrame:
    """(key, first, last) of window starts whose windows occur again, from all runs of each bucket."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for b, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket and blobs:
                    yield from combine(blobs)
                    blobs = []
                bucket = b
                blobs.append(run)
        if blobs:
            yield from combine(blobs)

    def combine(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        group: list[tuple[bytes, list]] = []
        for shared, suffix, owners in LoserTree([_read_run(b) for b in blobs]):
            if group and shared == len(suffix) == len(group[-1][0]):
                group[-1][1].extend(owners)
                continue
            if group and shared < GRAM:
                _repeated(group, out)
                group = []
            group.append((suffix, owners))
        _repeated(group, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["key", "first", "last"])

    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "key long, first long, last long")


def _hot_rows(joined: DataFrame, key: str, text: str, lists: str, length: int, flush: int = 2_000) -> DataFrame:
    """Windows of very frequent grams: (w1, w2, weight, key, at), equal suffixes of a stretch of documents put together.

    A suffix that occurs again in its stretch has weight 2, and rows with null hash that say so for its documents.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def rows() -> pa.RecordBatch:
            w1, w2, weight, keys, first, last = [], [], [], [], [], []
            for suffix, owners in held.items():
                k, f, more = owners[0]
                for i, w in enumerate(_windows(suffix, more)):
                    a, b = struct.unpack("<qq", hashlib.blake2b(w, digest_size=16).digest())
                    for col, v in zip((w1, w2, weight, keys, first, last), (a, b, min(2, len(owners)), k, f + i, f + i)):
                        col.append(v)
                if len(owners) > 1:
                    for k, f, more in owners:
                        for col, v in zip((w1, w2, weight, keys, first, last), (None, None, 0, k, f, f + more)):
                            col.append(v)
            held.clear()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((w1, w2, weight, keys, first, last), kinds)],
                                              ["w1", "w2", "weight", "key", "first", "last"])

        for batch in batches:
            for k, raw, at in zip(batch.column(key).to_pylist(), unpacked(batch, text), batch.column(lists).to_pylist()):
                for x in at or ():
                    suffix, first, more = _suffix(raw, x, length)
                    held.setdefault(suffix, []).append((k, first, more))
                if len(held) >= flush:
                    yield rows()
        if held:
            yield rows()

    return joined.select(key, text, lists).mapInArrow(
        emit, "w1 long, w2 long, weight int, key long, first long, last long")


def repeated_windows(docs: DataFrame, key: str, text: str = "text", length: int = 200, hot: int = 20_000,
                     bits: int = POSITION_BITS) -> DataFrame:
    """(key, first, last): stretches of starts of ``length``-byte windows that occur again in any document.

    ``docs``: a key column (long) and texts, nulls counting as empty. Rows may share a key if they share the text.
    """
    if not GRAM <= length <= GRAM + LAST:
        raise ValueError(f"a window has {GRAM} to {GRAM + LAST} bytes")
    found = _anchor_rows(docs, key, text, length, bits)
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pick = lambda c: F.collect_set(F.when(c, F.col("at")))
    lists = cut(found.join(often, "h").groupBy(F.col("key").alias("_k")).agg(
        pick(F.col("n") <= hot).alias("_runs"), pick(F.col("n") > hot).alias("_hot")))
    total = lists.agg(F.sum(F.size("_runs"))).first()[0] or 0
    # both ways below read the texts that hold a repeated gram, fetched once
    joined = cut(packed_texts(docs, key, text).join(lists, F.col(key) == F.col("_k")))
    normal = _merged(_run_rows(joined, key, text, "_runs", length, max(1, int(total) // 50_000)))
    windows = cut(_hot_rows(joined.where(F.size("_hot") > 0), key, text, "_hot", length))
    again = windows.where("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1")
    hot_found = windows.where("weight = 1").join(again, ["w1", "w2"], "left_semi").unionByName(windows.where("w1 IS NULL"))
    return normal.unionByName(hot_found.select("key", "first", "last"))


def remove_repeats(docs: DataFrame, length: int = 200, id: str = "doc_id", text: str = "text", out: str = "repeats") -> DataFrame:
    """``docs`` with a struct ``out``: n_bytes, n_removed, n_spans, kept (the remaining bytes, in a row).

    Every byte inside a window of ``length`` bytes that also starts elsewhere, in any document, is removed; windows are
    judged on the input; ``length`` is 64 to 4,159. A text may have any length. Null and empty texts have no bytes. Repeated rows are copies of each other. The remaining
    bytes need not be UTF-8. A column named ``out`` is replaced.
    """
    return apart(docs, id, text, out, lambda own: _without_repeats(own, length))


def _without_repeats(docs: DataFrame, length: int) -> DataFrame:
    id, text, out, key = "doc_id", "text", RESULT, "_key"
    base = docs
    keyed = base.withColumn(key, row_key(id, text))
    starts = repeated_windows(keyed.select(key, text), key, text, length)
    spans = starts.groupBy(F.col("key").alias("_k")).agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    packed = "_packed"
    joined = _packed(keyed, text, packed).join(spans, F.col(key) == F.col("_k"), "left")
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"
    arrow = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            raws = list(unpacked(batch, packed))
            for raw, found in zip(raws, batch.column("_spans").to_pylist()):
                end, spans_, left = 0, 0, []
                for first, last in sorted((x["first"], x["last"]) for x in found or ()):
                    if first > end or not spans_:
                        left.append(raw[end:first])
                        spans_ += 1
                    end = max(end, last + length)
                kept = b"".join([*left, raw[end:]])
                rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": spans_, "kept": kept})
            there = batch.column("_there").to_pylist()
            back = pa.array([r.decode() if x else None for r, x in zip(raws, there)], pa.string())
            yield pa.RecordBatch.from_arrays([back if c == text else batch.column(c) for c in names] + [pa.array(rows, arrow)],
                                             [*names, out])

    schema = base.limit(0).withColumn(out, F.lit(None).cast(kind)).schema
    names = base.columns
    others = [F.lit(None).cast("string").alias(c) if c == text else F.col(c) for c in names]
    return joined.select(*others, packed, "_there", "_spans").mapInArrow(remove, schema)


def _packed(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the text column compressed as ``out``, and ``_there``: whether the text is not null."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            column = pa.array([own.compress(t) for t in texts(batch, text)], pa.binary())
            nulls = pa.array([None] * batch.num_rows, pa.string())
            yield with_column(pa.RecordBatch.from_arrays([nulls if c == text else batch.column(c) for c in batch.schema.names],
                                                         batch.schema.names), out, column)

    return df.withColumn("_there", F.col(text).isNotNull()).mapInArrow(pack, schema_with(
        df.withColumn("_there", F.col(text).isNotNull()), out, T.BinaryType()))


def repeat_report(docs: DataFrame) -> DataFrame:
    r = F.col("repeats")
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", r["n_bytes"].alias("n_bytes"), r["n_removed"].alias("n_removed"), r["n_spans"].alias("n_spans"),
        F.sha2(r["kept"], 256).alias("kept_sha256"))
