"""Documents to chunks to hashed vectors to exact top-k retrieval."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.operators.stats import percentiles
from runframe.operators.windows import shard_offsets, top_k

QUERY_BLOCK = 4096
CHUNK_BLOCK = 50_000
KNOWN_TOKENS = 1_000_000


def chunk(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """Sliding character windows; the last one is the first that reaches the end of the text."""
    step = size - overlap
    n = F.char_length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    # windows are cut inside the row, so the whole text is not copied once per chunk
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col(text), i * step + 1, F.lit(size)))
    return (docs.where(n > 0).select(id, F.posexplode(windows).alias("chunk_no", "chunk_text"))
            .select(F.concat(F.col(id).cast("string"), F.lit("-c"), F.col("chunk_no").cast("string")).alias("chunk_id"),
                    id, "chunk_no", F.col("chunk_text").alias("text")))


def feature_hash(df: DataFrame, id: str = "chunk_id", text: str = "text", dim: int = 128) -> DataFrame:
    """Signed token counts per hashed dimension in long form ``(id, idx, count, n2, w)``.

    ``n2`` is the squared length of the row's vector and ``w`` the L2-normalised weight. Ids are unique. The vectors are those of
    ``embed``, laid out in rows: texts stay where they are, and nothing is shuffled.
    """
    vectors = embed(df, id, text, dim).select(id, "n2", F.explode(F.arrays_zip("idx", "cnt")).alias("_e"))
    return vectors.select(id, F.col("_e.idx").alias("idx"), F.col("_e.cnt").cast("long").alias("count"), "n2",
                          (F.col("_e.cnt") / F.sqrt(F.col("n2").cast("double"))).alias("w"))


def embed(df: DataFrame, id: str = "chunk_id", text: str = "text", dim: int = 128) -> DataFrame:
    """Hashed vector of every row of ``df`` as sparse arrays ``idx``, ``cnt`` and squared length ``n2``.

    The first four digest bytes of a token give the dimension, the low bit of the fifth the sign. A row's tokens are counted where
    the row is, per Arrow batch, so no text is shuffled; each distinct token is hashed once per task. A text without tokens gets empty
    arrays (the zero vector).
    """
    schema = T.StructType([df.schema[id], T.StructField("idx", T.ArrayType(T.IntegerType())),
                           T.StructField("cnt", T.ArrayType(T.IntegerType())), T.StructField("n2", T.LongType())])

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}

        def code(token: str) -> tuple[int, int]:
            digest = hashlib.sha256(token.encode()).digest()
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            known[token] = int.from_bytes(digest[:4], "big") % dim, 1 if digest[4] & 1 else -1
            return known[token]

        for batch in batches:
            rows, codes = [], []
            for line in batch.column(text).to_pylist():
                found = [known.get(token) or code(token) for token in (line or "").lower().split()]
                rows.append(len(found))
                codes += found
            at = np.repeat(np.arange(len(rows)), rows)
            pairs = np.array(codes, dtype=np.int64).reshape(-1, 2)
            counts = np.bincount(at * dim + pairs[:, 0], weights=pairs[:, 1], minlength=len(rows) * dim)
            counts = counts.astype(np.int64).reshape(len(rows), dim)
            used, idx = np.nonzero(counts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(used, minlength=len(rows)))]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(id), pa.ListArray.from_arrays(offsets, pa.array(idx, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts[used, idx], pa.int32())),
                pa.array((counts * counts).sum(axis=1), pa.int64())], names=schema.names)

    return df.select(id, text).mapInArrow(hash_batches, schema)


def to_dense(vectors: DataFrame, dim: int = 128) -> DataFrame:
    """Add ``vec``, the ``dim`` counts of a sparse vector, built as runs of zeros between its entries."""
    before = F.concat(F.array(F.lit(-1)), F.col("idx"))
    after = F.concat(F.col("idx"), F.array(F.lit(dim)))
    values = F.concat(F.col("cnt"), F.array(F.lit(None).cast("int")))
    runs = F.transform(F.arrays_zip(before.alias("b"), after.alias("a"), values.alias("v")), lambda s: F.concat(
        F.array_repeat(F.lit(0), s["a"] - s["b"] - 1), F.when(s["a"] < dim, F.array(s["v"])).otherwise(
            F.array().cast("array<int>"))))
    return vectors.withColumn("vec", F.flatten(runs))


def bucket_index(df: DataFrame, id: str = "chunk_id", pos: str = "pos", buckets: int = 256,
                 segment: int = 65_536) -> DataFrame:
    """Positions per hash bucket of the id (first md5 byte), in segments of at most ``segment`` positions.

    A bucket of any size stays a set of bounded rows; segment s covers positions
    ``[s * segment, (s + 1) * segment)``.
    """
    byte = F.conv(F.substring(F.md5(F.col(id)), 1, 2), 16, 10).cast("int")
    return (df.select((byte % buckets).alias("bucket"), F.floor(F.col(pos) / segment).cast("long").alias("segment"), pos)
            .groupBy("bucket", "segment")
            .agg(F.sort_array(F.collect_list(pos)).alias("positions"), F.count(F.lit(1)).alias("size")))


def merge_index(shards: DataFrame, shard: str = "shard", order: str | Sequence[str] = ("doc_id", "chunk_no")) -> DataFrame:
    """Rows of all shards with their global position (shards by name, then ``order``)."""
    return shard_offsets(shards, shard, order)


def index_summary(merged: DataFrame, shard: str = "shard", dim: int = 128) -> DataFrame:
    """Offset and size of each shard and the vector dimension."""
    return merged.groupBy(shard).agg(F.min("shard_offset").alias("shard_offset"),
                                     F.count(F.lit(1)).alias("shard_size")).withColumn("dim", F.lit(dim))


def _best(scores: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best scores, ties to the lower position."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((pos[near], -scores[near]))[:k]]


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _matrix(batch, dim: int) -> np.ndarray:
    """Dense rows of a batch holding sparse ``idx``/``cnt`` columns or a dense ``vec`` column."""
    if "vec" in batch.schema.names:
        return _flat(batch.column("vec"))[0].astype(np.float64).reshape(batch.num_rows, -1)
    at, sizes = _flat(batch.column("idx"))
    out = np.zeros((batch.num_rows, dim))
    out[np.repeat(np.arange(batch.num_rows), sizes), at] = _flat(batch.column("cnt"))[0]
    return out


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _scores(q: np.ndarray, q2: np.ndarray, v: np.ndarray, v2: np.ndarray) -> np.ndarray:
    scale = np.sqrt(q2[:, None] * v2[None, :])
    return np.divide(q @ v.T, scale, out=np.zeros_like(scale), where=scale > 0)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 5, query: str = "query_id", id: str = "chunk_id",
             pos: str = "pos", dim: int = 128) -> DataFrame:
    """Exact cosine top-``k`` chunks per query; ties go to the lower position.

    Both sides carry ``n2`` (squared length) and either sparse ``idx``/``cnt`` or dense ``vec``. Every task
    scores its own chunks against all queries with one matrix product per Arrow batch and hands on only
    its ``k`` best per query, so neither score pairs nor vectors are shuffled. The queries go to the
    tasks as a constant when a bounded count shows at most one block of them; beyond that, blocks of
    queries meet blocks of chunks.
    """
    columns = ["vec", "n2"] if "vec" in chunks.columns else ["idx", "cnt", "n2"]
    queries = queries.select(query, *columns)
    chunks = chunks.select(id, F.col(pos).cast("long").alias(pos), *columns)
    fields = {f.name: f.dataType for f in [*queries.schema.fields, *chunks.schema.fields]}
    schema = T.StructType([T.StructField(n, fields[n]) for n in (query, id, pos)] + [T.StructField("score", T.DoubleType())])
    few = queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    local = (_retrieve_small if few else _retrieve_blocked)(queries, chunks, k, schema, dim)
    return top_k(local, query, k, ["-score", pos])


def _retrieve_small(queries: DataFrame, chunks: DataFrame, k: int, schema: T.StructType, dim: int) -> DataFrame:
    query, id, pos, _ = schema.names
    table = queries.toArrow().combine_chunks()  # at most QUERY_BLOCK rows, checked by the caller
    query_ids = table.column(query).to_pylist()
    q, q2 = _matrix(table, dim), _numbers(table.column("n2")).astype(np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=object))
        kept: list[tuple] = [empty] * len(query_ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = _scores(q, q2, _matrix(batch, dim), _numbers(batch.column("n2")).astype(np.float64))
            at = _numbers(batch.column(pos))
            ids = np.array(batch.column(id).to_pylist(), dtype=object)
            for n, old in enumerate(kept):
                best = _best(scores[n], at, k)
                s, p, i = (np.concatenate(pair) for pair in zip(old, (scores[n][best], at[best], ids[best])))
                top = _best(s, p, k)
                kept[n] = (s[top], p[top], i[top])
        rows = [(query_ids[n], i, int(p), float(s)) for n, part in enumerate(kept) for s, p, i in zip(*part)]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip((query, id, pos, "score"), r)) for r in rows])

    return chunks.mapInArrow(score, schema)


def _retrieve_blocked(queries: DataFrame, chunks: DataFrame, k: int, schema: T.StructType, dim: int) -> DataFrame:
    query, id, pos, _ = schema.names
    n_query = -(-queries.count() // QUERY_BLOCK)
    n_chunk = -(-chunks.count() // CHUNK_BLOCK)

    def block(col: str, n: int):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("_q", block(query, n_query)).withColumn("_c", spread(n_chunk))
    right = chunks.withColumn("_c", block(id, n_chunk)).withColumn("_q", spread(n_query))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {query: [], id: [], pos: [], "score": []}
        if a.num_rows and b.num_rows:
            at, ids = _numbers(b[pos]), b[id].to_pylist()
            scores = _scores(_matrix(a, dim), _numbers(a["n2"]).astype(float), _matrix(b, dim),
                             _numbers(b["n2"]).astype(float))
            for n, name in enumerate(a[query].to_pylist()):
                for j in _best(scores[n], at, k):
                    for key, value in zip(out, (name, ids[j], int(at[j]), float(scores[n, j]))):
                        out[key].append(value)
        types = {query: a.schema.field(query).type, id: b.schema.field(id).type, pos: pa.int64(), "score": pa.float64()}
        return pa.table({key: pa.array(value, types[key]) for key, value in out.items()})

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(score, schema)


def retrieval_report(hits: DataFrame, latencies: DataFrame, query: str = "query_id", id: str = "chunk_id",
                     latency: str = "latency_s") -> tuple[DataFrame, DataFrame]:
    """Hits of each query as one ordered list (scores 4 dp), and latency p50 and p95 (truncated rank)."""
    entry = F.struct("rank", F.col(id).alias("chunk_id"), F.round("score", 4).alias("score"))
    per_query = hits.groupBy(query).agg(F.sort_array(F.collect_list(entry)).alias("hits"))  # k entries each
    return per_query, percentiles(latencies, None, latency, {"latency_p50": (0.5, "trunc"), "latency_p95": (0.95, "trunc")})
