"""Target-distribution importance resampling over hashed word n-grams.

Every run of 1 to ``n`` consecutive words is a feature and falls into one of ``buckets`` by its crc32. A bucket's gain
tells how much more frequent its features are in the target texts than in the corpus; a document weighs the mean gain of
its features, and the highest weights with seeded Gumbel noise are drawn.

Inside a task the n-grams of a stretch of text are interned in an open-addressed table held in NumPy arrays: xxhash64 keys
choose the slot, bytes are compared before a slot is shared, and every slot stores its bucket and count. Occurrences are
slot numbers, so counts and gains are gathered by index. Texts never leave their task; one number per bucket and
task is shuffled for the counts, and only (id, score) rows for the draw.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.functions.runtime import cut
from runframe.llm.common import free_name, lengths_to_starts, schema_with, texts, with_column

#: Upper-case letters become lower-case, other ASCII bytes that are no letters or digits become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
STRETCH = 1 << 18


class GramTable:
    """Byte strings of one stretch, interned by open addressing with linear probing."""

    def __init__(self, grams: Sequence[bytes], buckets: int, keys: np.ndarray | None = None):
        import xxhash

        n = len(grams)
        strings = np.empty(n, object)
        strings[:] = grams
        if keys is None:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, n)
        size = 1 << max(2 * n, 2).bit_length()
        first = np.full(size, -1, np.int64)  # the occurrence that claimed a slot
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        slot, open_ = np.empty(n, np.int64), np.arange(n)
        while len(open_):
            here = at[open_]
            free = first[here] < 0
            first[here[free]] = open_[free]
            owner = first[here]
            found = keys[owner] == keys[open_]
            found[found] = strings[owner[found]] == strings[open_[found]]
            slot[open_[found]] = here[found]
            open_ = open_[~found]
            at[open_] = (at[open_] + 1) & (size - 1)
        used = np.flatnonzero(first >= 0)
        number = np.empty(size, np.int64)
        number[used] = np.arange(len(used))
        #: Slot of every occurrence, in order; bucket and count of every slot.
        self.slots = number[slot]
        self.bucket = np.fromiter(map(zlib.crc32, strings[first[used]]), np.int64, len(used)) % buckets
        self.count = np.bincount(self.slots, minlength=len(used))


def stretches(texts: Sequence[bytes], n: int, size: int = STRETCH) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Features of stretches of about ``size`` bytes, with (text, words, features) of each text's part.

    A longer text goes in several stretches; the last words of one are carried to the next, so no run is lost.
    """
    grams: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    room = size
    for i, text in enumerate(texts):
        clean, begin, tail = text.translate(WORD_BYTES), 0, []
        while True:
            end = clean.find(b" ", begin + room) if len(clean) - begin > room else -1
            words = (clean[begin:end] if end >= 0 else clean[begin:]).split()
            before = len(grams)
            grams += words
            known = tail + words
            for k in range(2, n + 1):
                own = known[max(len(tail) - k + 1, 0):]
                grams += map(b" ".join, zip(*(own[j:] for j in range(k))))
            parts.append((i, len(words), len(grams) - before))
            room -= (end if end >= 0 else len(clean)) - begin
            if room <= 0:
                yield grams, parts
                grams, parts, room = [], [], size
            if end < 0:
                break
            begin, tail = end, known[max(len(known) - n + 1, 0):]
    if parts:
        yield grams, parts


def bucket_counts(docs: DataFrame, text: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts in each bucket. Tasks hand on one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for grams, _ in stretches(texts(batch, text), n):
                table = GramTable(grams, buckets)
                np.add.at(total, table.bucket, table.count)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)  # at most ``buckets`` rows, whatever the corpus
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the smoothed share in the target over that in the corpus, rounded down."""
    b = len(corpus)
    ratio = (target + 1) * float(corpus.sum() + b) / ((corpus + 1) * float(target.sum() + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


PARTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", n: int = 2, out: str = "importance") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_features, weight (floored mean gain of the features, 0 without any)."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for grams, parts in stretches(texts(batch, text), n):
                table = GramTable(grams, buckets)
                sums = lengths_to_starts(gain[table.bucket][table.slots])
                which, n_words, n_features = np.array(parts).T
                edges = lengths_to_starts(n_features)
                np.add.at(words, which, n_words)
                np.add.at(features, which, n_features)
                np.add.at(total, which, sums[edges[1:]] - sums[edges[:-1]])
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield with_column(batch, out, pa.StructArray.from_arrays([pa.array(words), pa.array(features), pa.array(weight)],
                                                                     PARTS.names))

    return docs.mapInArrow(add, schema_with(docs, out, PARTS))


def noise(id: str, seed: int) -> Column:
    """Seeded Gumbel noise of a row id in thousandths, rounded down; a null id counts as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def draw(scored: DataFrame, eligible: Column, percent: int, id: str = "doc_id", score: str = "score", out: str = "rank") -> DataFrame:
    """``scored`` with a long ``out``: 1, 2, 3… for the highest scores of ``percent`` percent of the eligible rows, else null.

    Equal scores go by ascending id (null ids first); equal rows take consecutive ranks. Rows are range-partitioned by
    their order with a running number last, so equal scores or ids are split as well, and
    only one count per partition is carried over.
    """
    place = free_name(scored, "_place")
    part, row, base = (free_name(scored, c) for c in ("_part", "_row", "_base"))
    fixed = cut(scored.withColumn(place, eligible)).withColumn(row, F.monotonically_increasing_id())
    order = [F.col(score).desc(), F.col(id).asc_nulls_first(), F.col(row)]
    chosen = cut(fixed.where(place).repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    sizes = chosen.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).orderBy(part).collect()
    starts, total = [], 0
    for r in sizes:  # one row per partition
        starts.append((r[part], total - r["first"] + 1))
        total += r["n"]
    offsets = chosen.sparkSession.createDataFrame(starts, f"`{part}` int, `{base}` long")
    rank = F.col(place) + F.col(base)
    ranked = chosen.join(F.broadcast(offsets), part).withColumn(out, F.when(rank <= percent * total // 100, rank))
    rest = fixed.where(~F.coalesce(F.col(place), F.lit(False))).withColumn(out, F.lit(None).cast("long"))
    columns = [c for c in scored.columns if c.lower() != out.lower()] + [out]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def importance(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2,
               buckets: int = 10_000, seed: int = 7, out: str = "importance") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_features, weight and score (weight with seeded noise).

    Null and empty texts have no features and weigh 0; an empty target or corpus gives every bucket the gain of the smoothing.
    Repeated rows get the same numbers. A column named ``out`` is replaced, all others stay.
    """
    gains = bucket_gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    c = F.col(out)
    weighed = weigh(docs, gains, text, n, out)
    return weighed.withColumn(out, F.struct(*[c[f].alias(f) for f in PARTS.names], (c["weight"] + noise(id, seed)).alias("score")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, id: str = "doc_id",
             **options) -> DataFrame:
    """The documents drawn: the best ``percent`` percent of those with ``min_words`` words or more, in no order.

    Rows equal to the last one drawn in score and id are all drawn.
    """
    out = free_name(docs, "importance")
    found = importance(docs, target, id=id, out=out, **options)
    narrow = found.select(F.col(id).alias("doc_id"), F.col(out)["score"].alias("score"), F.col(out)["n_words"].alias("n_words"))
    ranked = draw(narrow, F.col("n_words") >= min_words, percent)
    last = ranked.where("rank IS NOT NULL").agg(F.max_by(F.struct("score", "doc_id"), "rank")).first()[0]
    if last is None:
        return docs.limit(0)
    score, own = F.col(out)["score"], F.col(id)
    tied = own.isNull() if last["doc_id"] is None else own.isNull() | (own <= last["doc_id"])
    return found.where((F.col(out)["n_words"] >= min_words) & ((score > last["score"]) | ((score == last["score"]) & tied))).select(*docs.columns)


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    found = importance(docs.select("doc_id", "text"), target)
    flat = found.select("doc_id", "importance.*")
    return draw(flat, F.col("n_words") >= 20, 25).select("doc_id", "n_features", "weight", "score", "rank")


# crc32 byte by byte with a table made by its rule (the fixed value is its polynomial)
SQL = r"""
WITH lookup AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
           FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i))),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY ALL),
every AS (SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM df UNION SELECT f FROM bf)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM every, lookup),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
c AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () AS able FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM o
"""
