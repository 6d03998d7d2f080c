"""Benchmark decontamination: training texts against the word windows of benchmark items.

The windows of all items form a set. It is broadcast while the benchmark text stays below a stated size; beyond it
windows of both sides meet in a join. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.llm.common import RESULT as WHOLE
from runframe.llm.common import apart, free_name, lengths_to_starts, row_key, schema_with, texts, with_column

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()),
                                                     T.StructField("last", T.LongType())])))])
RESULT_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
#: Bytes of a word after lower-casing A-Z: digits, a-z and all above ASCII; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    """Every run of ``n`` words; a shorter, non-empty text is one window."""
    if len(words) < n:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]


class WindowSet:
    """Item windows as rows of word numbers: candidates by a rolling hash, then compared whole."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            for window in windows_of(words_of(text), n):
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window], np.uint64)
                found[len(window)][ids.tobytes()].add(item)
        self.windows = {length: dict(rows) for length, rows in found.items()}
        self.hashes = {length: np.unique(self.rolled(np.frombuffer(b"".join(rows), np.uint64).reshape(-1, length).T))
                       for length, rows in self.windows.items()}

    def rolled(self, columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            total = total * self.BASE + c
        return total

    def occurrences(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, set]]:
        """(first word counted over the batch, words, items) of every window that occurs in a document."""
        starts = lengths_to_starts(np.array([len(d) for d in docs]))
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for d in docs for w in d), np.uint64, starts[-1])
        unknown = lengths_to_starts((ids == 0).astype(np.int64))
        ends = np.repeat(starts[1:], np.diff(starts))
        for length, rows in self.windows.items():
            if len(ids) < length:
                continue
            at = np.arange(len(ids) - length + 1)
            at = at[(unknown[length:] == unknown[:-length]) & (at + length <= ends[:len(at)])]
            hashes = self.rolled([ids[at + k] for k in range(length)])
            for p in at[np.isin(hashes, self.hashes[length])]:
                items = rows.get(ids[p:p + length].tobytes())
                if items is not None:
                    yield int(p), length, items


def _runs(marks: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)]


def _broadcast_hits(docs: DataFrame, windows: WindowSet, text: str, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            words = [words_of(t) for t in texts(batch, text)]
            starts = lengths_to_starts(np.array([len(w) for w in words]))
            change = np.zeros(starts[-1] + 1, np.int64)
            items: dict[int, set] = defaultdict(set)
            for p, length, of in known.occurrences(words):
                change[p] += 1
                change[p + length] -= 1
                items[int(np.searchsorted(starts, p, "right")) - 1] |= of
            hit = np.cumsum(change)[:-1] > 0
            rows = []
            for i in range(len(words)):
                own = hit[starts[i]:starts[i + 1]] if i in items else ()
                rows.append({"n_words": len(words[i]), "n_hit": int(np.sum(own)),
                             "items": sorted(x for x in items.get(i, ()) if x is not None),
                             "spans": _runs(own) if i in items else []})
            yield with_column(batch, out, pa.array(rows, RESULT_ARROW))

    return docs.mapInArrow(mark, schema_with(docs, out, RESULT))


def _window_rows(df: DataFrame, n: int, keep: list[str], text: str, lengths: list[int] | None) -> DataFrame:
    """One row per window: the kept columns, first word, number of words, and a digest of the words."""
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField("_at", T.LongType()), T.StructField("_n", T.IntegerType()), T.StructField("_h", T.BinaryType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(texts(batch, text)):
                words = words_of(t)
                sizes = lengths if lengths is not None else [min(n, len(words))]
                found = [(p, k, hashlib.md5(b" ".join(words[p:p + k])).digest())
                         for k in sizes if k for p in range(len(words) - k + 1)]
                if found:
                    own = [batch.column(c).take(pa.array([i] * len(found))) for c in keep]
                    at, sizes_, digests = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        own + [pa.array(at, pa.int64()), pa.array(sizes_, pa.int32()), pa.array(digests, pa.binary())],
                        [*keep, "_at", "_n", "_h"])

    return df.select(*keep, text).mapInArrow(emit, schema)


def _joined_hits(docs: DataFrame, items: DataFrame, n: int, id: str, text: str, item: str, item_text: str,
                 out: str) -> DataFrame:
    key = "_key"
    docs = docs.withColumn(key, row_key(id, text))
    known = _window_rows(items.select(F.col(item).cast("string").alias("_item"), item_text), n, ["_item"], item_text, None)
    known = known.select("_n", "_h", "_item").distinct()
    lengths = [r[0] for r in known.select("_n").distinct().collect()]  # at most n of them
    found = _window_rows(docs.dropDuplicates([key]), n, [key], text, lengths).join(known, ["_n", "_h"])
    hits = found.groupBy(F.col(key).alias("_k")).agg(
        F.array_sort(F.collect_set("_item")).alias("_items"),
        F.array_sort(F.collect_set(F.struct("_at", (F.col("_at") + F.col("_n")).alias("_end")))).alias("_w"))
    # windows in order of their first word: merged one by one into runs
    merge = F.aggregate("_w", F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"), lambda runs, w: F.when(
        (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["last"] + 1 >= w["_at"]),
        F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(
            F.try_element_at(runs, F.lit(-1))["first"].alias("first"),
            F.greatest(F.try_element_at(runs, F.lit(-1))["last"], w["_end"] - 1).alias("last"))))).otherwise(
        F.concat(runs, F.array(F.struct(w["_at"].alias("first"), (w["_end"] - 1).alias("last"))))))
    hits = hits.select("_k", "_items", merge.alias("_spans"))
    count = _broadcast_hits(docs, WindowSet([], n), text, out)
    both = count.join(hits, F.col(key) == F.col("_k"), "left")
    none = F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")
    spans = F.coalesce("_spans", none)
    result = F.struct(F.col(out)["n_words"].alias("n_words"),
                      F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1).alias("n_hit"),
                      F.coalesce("_items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"))
    return both.withColumn(out, result).drop(key, "_k", "_items", "_spans")


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 13, id: str = "doc_id", text: str = "text",
                       item: str = "item_id", item_text: str = "text", out: str = "contamination",
                       broadcast_chars: int = 16_000_000) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit (words inside an occurring window), items, spans of hit words.

    A null or empty text has no words; an empty benchmark hits nothing; an item without an id still marks words but is
    not listed; repeated items count once, repeated documents each get their result. A column named ``out`` is replaced.
    """
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    if size > broadcast_chars:
        return apart(docs, id, text, out, lambda own: _joined_hits(own, items, n, "doc_id", "text", item, item_text, WHOLE))
    rows = items.select(F.col(item).cast("string"), F.col(item_text).cast("string")).collect()
    return _broadcast_hits(docs, WindowSet([(r[0], (r[1] or "").encode()) for r in rows], n), text, out)


def is_contaminated(out: str = "contamination"):
    """Any hit, and hit words make up at least a twentieth of the words."""
    return (F.col(out)["n_hit"] > 0) & (F.col(out)["n_hit"] * 20 >= F.col(out)["n_words"])


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words cut out of every text (``remove="spans"``).

    Cut texts keep the bytes outside the hit words; a text that is not hit stays as it is, a null one too.
    """
    out = free_name(docs, "contamination")
    found = find_contamination(docs, items, text=text, out=out, **options)
    if remove == "documents":
        return found.where(~is_contaminated(out)).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            kept = []
            for value, runs in zip(batch.column(text).to_pylist(), batch.column(out).field("spans").to_pylist()):
                if value is None or not runs:
                    kept.append(value)
                    continue
                raw = value.encode()
                at = [m.span() for m in word.finditer(raw)]
                parts, last = [], 0
                for r in runs:
                    parts.append(raw[last:at[r["first"]][0]])
                    last = at[r["last"]][1]
                kept.append((b"".join(parts) + raw[last:]).decode())
            names = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.string()) if c == text else batch.column(c) for c in names], names)

    return found.mapInArrow(cut, docs.schema).select(*docs.columns)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    c = F.col("contamination")
    return find_contamination(docs, items).select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
       FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""
